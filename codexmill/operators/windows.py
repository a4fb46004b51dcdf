"""Token windows, the paragraphs that they touch, and contiguous numbering of input rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_windows(n: Column, width: int, overlap: int) -> Column:
    """array<struct<start, stop>>: half-open windows of `width` tokens over n, each `overlap` (under width) into the next.
    The last one may be short; no window lies wholly in the one before; no tokens, no windows."""
    step = width - min(overlap, width - 1)
    count = F.when(n <= 0, 0).when(n <= width, 1).otherwise(F.ceil((n - width) / step) + 1).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct((i * step).alias("start"), F.least(i * step + width, n.cast("int")).alias("stop")))


def token_intervals(counts: Column) -> Column:
    """array<struct<start, stop>>: running half-open token offsets of paragraphs, given the tokens of each."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def step(acc: Column, n: Column) -> Column:
        at = F.coalesce(F.element_at(acc, -1)["stop"], F.lit(0))
        return F.concat(acc, F.array(F.struct(at.alias("start"), (at + n.cast("int")).alias("stop"))))

    return F.aggregate(counts, empty, lambda acc, n: F.when(F.size(acc) == 0, F.array(F.struct(F.lit(0).alias("start"), n.cast("int").alias("stop")))).otherwise(step(acc, n)))


def touched(intervals: Column, window: Column) -> Column:
    """Places (from 0) of the intervals that share a token with the window; empty intervals touch nothing."""
    hit = lambda x: (x["start"] < window["stop"]) & (x["stop"] > window["start"]) & (x["start"] < x["stop"])
    marked = F.transform(intervals, lambda x, i: F.when(hit(x), i))
    return F.filter(marked, lambda i: i.isNotNull())


def numbered(rows: DataFrame, key: str, place: str, out: str = "row_index", span: int = 4096) -> DataFrame:
    """rows plus their index from 0 on in the order of (key, place), without one task that gets them all.

    key is an integer. Rows are counted by key, keys by ranges of `span`; only the range counts are summed in one place."""
    counts = rows.groupBy(key).agg(F.count("*").alias("__n")).withColumn("__range", F.floor(F.col(key) / span))
    heads = counts.groupBy("__range").agg(F.sum("__n").alias("__total"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__head"))
    inside = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(heads, "__range").select(key, (F.col("__head") + F.col("__in")).alias("__start"))
    own = F.row_number().over(Window.partitionBy(key).orderBy(place)) - 1
    return rows.withColumn("__own", own).join(starts, key).withColumn(out, F.col("__start") + F.col("__own")).drop("__own", "__start")


def embedding_inputs(texts: DataFrame, key: str, width: int, overlap: int) -> DataFrame:
    """(row_index, embedding_input_id, key, window, n_tokens, overflow, text, sha256) of texts(key, tokens array<string>).

    A text over `width` tokens is repaired into windows, never cut off; ids are ein_ and six digits or more."""
    n = F.size("tokens")
    part = lambda w: F.array_join(F.slice("tokens", w["start"] + 1, w["stop"] - w["start"]), " ")
    windows = F.transform(token_windows(n, width, overlap), lambda w: F.struct((w["stop"] - w["start"]).alias("n_tokens"), part(w).alias("text")))
    # what is shuffled are the windows, never a text's tokens beside each of them
    cut = texts.select(key, (n > width).alias("overflow"), F.posexplode(windows).alias("window", "w"))
    cut = cut.select(key, "window", "w.n_tokens", "overflow", "w.text", F.sha2("w.text", 256).alias("sha256"))
    rows = numbered(cut, key, "window")
    return rows.select("row_index", F.format_string("ein_%06d", "row_index").alias("embedding_input_id"), key, "window", "n_tokens", "overflow", "text", "sha256")
