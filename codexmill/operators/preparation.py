"""Embedding inputs with paragraph anchors, by an injected tokenizer, and profiles of their lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

from codexmill.operators.windows import numbered, token_windows, touched

#: Views: enriched chunk texts, raw chunk texts, whole parents (fixed values).
VIEWS = ("J1", "J2", "C1")


def located(parents: Column, lines: Column, cursor: Column) -> Column:
    """The place (from 0) of `lines` as a run of the array `parents`: the first one from cursor on, or else the first at all;
    null if there is none or no line."""
    n = F.size(lines)
    last = F.size(parents) - n
    starts = F.when((n > 0) & (last >= 0), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(parents, i + 1, F.greatest(n, F.lit(1))) == lines))
    return F.coalesce(F.get(F.filter(starts, lambda i: i >= cursor), F.lit(0)), F.get(starts, F.lit(0)))


def chunk_anchors(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent_id, place, first, last) of chunks(parent_id, place, text) in parents(parent_id, paragraphs array<string>): the
    paragraphs (from 1) that a chunk's lines are. Lines that repeat are told apart by a cursor: a chunk begins at the last
    paragraph of the one before or later. A chunk that is no run of its parent has nulls."""
    line = F.filter(F.split("text", "\n"), lambda x: x != "")
    lists = chunks.select("parent_id", F.struct("place", line.alias("lines")).alias("c")).groupBy("parent_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    both = lists.join(parents.select("parent_id", "paragraphs"), "parent_id", "left")
    row = "array<struct<place:int,first:int,last:int>>"
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast(row).alias("rows"))

    def step(acc: Column, c: Column) -> Column:
        at = located(F.col("paragraphs"), c["lines"], acc["cursor"])
        end = at + F.size(c["lines"])
        made = F.struct(c["place"].cast("int").alias("place"), (at + 1).cast("int").alias("first"), end.cast("int").alias("last"))
        return F.struct(F.coalesce(end - 1, acc["cursor"]).cast("int").alias("cursor"), F.concat(acc["rows"], F.array(made)).alias("rows"))

    return both.select("parent_id", F.inline(F.aggregate("cs", start, step, lambda acc: acc["rows"])))


def counted(rows: DataFrame, column: str, tokenize: Callable[[str], list], name: str = "n_tokens") -> DataFrame:
    """rows plus the number of tokens of a text column, counted where the rows lie."""

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: len(tokenize(t or "")))

    return rows.withColumn(name, count(F.col(column)))


def paragraph_tokens(paragraphs: DataFrame, tokenize: Callable[[str], list], gap: str = "\n") -> DataFrame:
    """(parent_id, intervals array<struct<start, stop>>, total) of paragraphs(parent_id, paragraphs array<string>): running token
    offsets, tokens of the gaps between counted, the first from 0 on and the last up to the total."""
    kind = ArrayType(LongType())

    @F.pandas_udf(kind)
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield lists.map(lambda ps: [len(tokenize(p or "")) for p in ps] if ps is not None else [])

    between = len(tokenize(gap))
    counts = paragraphs.withColumn("__n", sizes(F.col("paragraphs")))
    stop = lambda i: F.aggregate(F.slice("__n", 1, i + 1), F.lit(0).cast("long"), lambda a, n: a + n) + i * between
    spans = F.transform("__n", lambda n, i: F.struct((F.when(i == 0, F.lit(0)).otherwise(stop(i) - n)).cast("int").alias("start"), stop(i).cast("int").alias("stop")))
    total = F.aggregate("__n", F.lit(0).cast("long"), lambda a, n: a + n) + F.greatest(F.size("__n") - 1, F.lit(0)) * between
    return counts.select("parent_id", spans.alias("intervals"), total.alias("total"))


def prefix_offsets(text: str, paragraphs: list[tuple[int, str]], tokenize: Callable[[str], list], settled: Callable[[str, int], int] | None = None) -> tuple[list[tuple[int, int, int]], str | None]:
    """([(order, start, stop)], error): token offsets of paragraphs in text, start and stop being the tokens of the exact prefixes
    that end where a paragraph begins and ends.

    A cursor moves on from each paragraph to the next. settled(text, at) names a place up to `at` before which no later
    character changes the tokens (0 if not known): tokens up to there are counted once, and only what is open behind it is
    tokenised for each prefix. Tokenizers that merge over a gap so get the right offsets; sums of counts would not give them."""
    found, cursor, base, counted = [], 0, 0, 0

    def tokens(at: int) -> int:
        nonlocal base, counted
        safe = max(settled(text, at), base) if settled else 0
        if safe > base:
            counted += len(tokenize(text[base:safe]))
            base = safe
        return counted + len(tokenize(text[base:at]))

    for order, paragraph in paragraphs:
        if not paragraph:
            return found, f"paragraph {order} is empty"
        first = text.find(paragraph, cursor)
        if first < 0:
            return found, f"paragraph {order} is not in the text"
        cursor = first + len(paragraph)
        start = tokens(first)
        found.append((order, start, tokens(cursor)))
    return found, None


def text_offsets(texts: DataFrame, tokenize: Callable[[str], list], settled: Callable[[str, int], int] | None = None) -> DataFrame:
    """(unit_id, intervals array<struct<order, start, stop>>, error) of texts(unit_id, text, paragraphs array<struct<order, text>>):
    `prefix_offsets` of each row. A paragraph that is empty, or not found behind the one before, is an error, not a failure of
    the job; intervals then end before it. Null texts and lists count as empty."""
    kind = "struct<intervals:array<struct<order:int,start:int,stop:int>>,error:string>"

    @F.pandas_udf(kind)
    def offsets(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for bodies, lists in batches:
            rows = [prefix_offsets(t or "", [(p["order"], p["text"]) for p in (ps if ps is not None else [])], tokenize, settled) for t, ps in zip(bodies, lists)]
            yield pd.DataFrame({"intervals": [[{"order": o, "start": a, "stop": b} for o, a, b in r[0]] for r in rows], "error": [r[1] for r in rows]})

    return texts.withColumn("__o", offsets("text", "paragraphs")).select("unit_id", "__o.intervals", "__o.error")


def prepare_inputs(texts: DataFrame, tokenize: Callable[[str], list], join: Callable[[list], str], limit: int, overlap: int, reserved: int = 0) -> DataFrame:
    """(row_index, embedding_input_id, key, window, n_tokens, overflow, text, first, last, sha256) of texts(key long, text,
    paragraphs array<string>, first): one row a text that fits limit - reserved tokens, else windows of it, never cut off.
    first is the number of the text's first paragraph in its parent; a window's anchor are the paragraphs it touches."""
    width = limit - reserved
    if width <= 0:
        raise ValueError("no room for text beside what is reserved")
    schema = StructType([*texts.select("key", "first").schema.fields, *StructType.fromDDL("window int, n_tokens int, overflow boolean, text string, lo int, hi int").fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = width - min(overlap, width - 1)
        for frame in frames:
            rows = []
            for key, first, text, paragraphs in zip(frame["key"], frame["first"], frame["text"], frame["paragraphs"]):
                tokens = tokenize(text or "")
                n = len(tokens)
                at, spans = 0, []
                for k, p in enumerate(paragraphs):
                    size = len(tokenize(p)) + (len(tokenize("\n")) if k else 0)
                    spans.append((at, at + size))
                    at += size
                if spans:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], n))
                starts = range(0, max(1, n - width + step), step) if n > width else [0]
                for w, s in enumerate(starts):
                    e = min(s + width, n)
                    hit = [k for k, (a, b) in enumerate(spans) if a < e and b > s]
                    rows.append((key, first, w, e - s, n > width, text if n <= width else join(tokens[s:e]), hit[0] if hit else None, hit[-1] if hit else None))
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields]).astype({"lo": "Int32", "hi": "Int32"})

    made = texts.select("key", "first", "text", "paragraphs").mapInPandas(run, schema)
    rows = numbered(made, "key", "window")
    return rows.select(
        "row_index", F.format_string("ein_%06d", "row_index").alias("embedding_input_id"), "key", "window", "n_tokens", "overflow", "text", (F.col("first") + F.col("lo")).alias("first"),
        (F.col("first") + F.col("hi")).alias("last"), F.sha2("text", 256).alias("sha256"),
    )


def length_summary(profiles: DataFrame, limit: int, *cuts: str, value: str = "n_tokens") -> DataFrame:
    """Number, truncated, their share (2 digits), longest and interpolated percentiles (1 digit, after the noise of interpolation
    is rounded off at 6) overall and by each cut."""
    p = F.percentile(value, F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))))
    made = profiles.groupingSets([[], *[[c] for c in cuts]], *cuts).agg(F.count("*").alias("n"), F.count_if(F.col(value) > limit).alias("n_truncated"), F.max(value).alias("longest"), p.alias("__p"))
    share = F.round(100.0 * F.col("n_truncated") / F.nullif(F.col("n"), F.lit(0)), 2)
    return made.select(*cuts, "n", "n_truncated", share.alias("pct_truncated"), "longest", *[F.round(F.round(F.get("__p", F.lit(i)), 6), 1).alias(x) for i, x in enumerate(("p50", "p90", "p95", "p99"))])


def window_touches(intervals: Column, n: Column, width: int, overlap: int) -> Column:
    """For each window over n tokens, the places of the paragraphs that it touches."""
    return F.transform(token_windows(n, width, overlap), lambda w: touched(intervals, w))


def encoded(rows: DataFrame, column: str, model: Callable[[list[str]], list], dim: int, template: str = "{text}", normalise: bool = True) -> DataFrame:
    """rows plus vector array<float>: the template filled with the text, encoded a batch at a time where the rows lie. A vector
    of another length than dim raises; vectors are scaled to length one unless told not to."""
    kind = StructType([*rows.schema.fields, StructField("vector", ArrayType(FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for frame in frames:
            got = np.asarray(model([template.replace("{text}", t or "") for t in frame[column]]), np.float32).reshape(len(frame), -1) if len(frame) else np.zeros((0, dim), np.float32)
            if got.shape[1] != dim:
                raise ValueError(f"the model gives {got.shape[1]} values, not {dim}")
            if normalise:
                got = got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)
            yield frame.assign(vector=list(got))

    return rows.mapInPandas(run, kind)
