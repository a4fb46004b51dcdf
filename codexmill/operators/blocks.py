"""Versioned blocks: current version, heading state, packing of paragraphs into chunks, overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def resolve_versions(versions: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, current_date) of versions(keys, published) against index(keys, index_date), dates as ISO strings.

    Current is the one version whose date equals the index date and is the latest of all; two on that date are ambiguous.
    The order in which versions come decides nothing."""
    joined = versions.join(index, keys, "left").groupBy(*keys).agg(
        F.max("index_date").alias("index_date"), F.max("published").alias("latest"), F.count_if(F.col("published") == F.col("index_date")).alias("matches")
    )
    status = (
        F.when(F.col("index_date").isNull(), "missing_index_date").when(F.col("matches") == 0, "unresolved")
        .when(F.col("matches") > 1, "ambiguous").when(F.col("index_date") != F.col("latest"), "index_not_max").otherwise("resolved")
    )
    return joined.select(*keys, status.alias("status"), F.when(status == "resolved", F.col("index_date")).alias("current_date"))


def out_of_order(versions: DataFrame, keys: list[str], place: str) -> DataFrame:
    """(keys, n_out_of_order): versions published before the one that stands in front of them."""
    before = F.lag("published").over(Window.partitionBy(*keys).orderBy(place))
    return versions.withColumn("b", before).groupBy(*keys).agg(F.count_if(F.col("published") < F.col("b")).alias("n_out_of_order"))


def heading_state(rows: DataFrame, group: str, order: str, level: str, text: str, levels: list[str]) -> DataFrame:
    """rows plus one column for each level: the last heading of that level, unless a higher one came since.

    The resets of a level are counted along the order; within a stretch the last heading holds."""
    out = rows
    for k, name in enumerate(levels):
        own = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"__r{k}", F.sum(F.col(level).isin(levels[:k]).cast("int")).over(own) if k else F.lit(0))
    for k, name in enumerate(levels):
        stretch = Window.partitionBy(group, f"__r{k}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(name, F.last(F.when(F.col(level) == name, F.col(text)), ignorenulls=True).over(stretch))
    return out.drop(*[f"__r{k}" for k in range(len(levels))])


def pack(paragraphs: Column, max_chars: int, overlap: int = 0) -> Column:
    """array<array<string>>: paragraphs packed in order up to max_chars, line feeds counted; a new group begins with the
    last `overlap` paragraphs of the one before, which is not checked again; a paragraph is never cut; a text that fits,
    or has one paragraph, is one group. Empty paragraphs are left out."""
    kept = F.filter(paragraphs, lambda p: F.length(p) > 0)
    empty = F.array().cast("array<string>")
    zero = F.struct(F.array().cast("array<array<string>>").alias("groups"), empty.alias("current"), F.lit(0).alias("size"))
    length = lambda a: F.aggregate(a, F.lit(-1), lambda n, p: n + F.length(p) + 1)

    def step(acc: Column, p: Column) -> Column:
        fits = (F.size(acc["current"]) == 0) | (acc["size"] + 1 + F.length(p) <= max_chars)
        carried = F.slice(acc["current"], F.greatest(F.size(acc["current"]) - overlap + 1, F.lit(1)), F.lit(overlap)) if overlap else empty
        grown = F.struct(acc["groups"].alias("groups"), F.concat(acc["current"], F.array(p)).alias("current"), (F.when(F.size(acc["current"]) == 0, F.length(p)).otherwise(acc["size"] + 1 + F.length(p))).alias("size"))
        started = F.concat(carried, F.array(p))
        return F.when(fits, grown).otherwise(F.struct(F.concat(acc["groups"], F.array(acc["current"])).alias("groups"), started.alias("current"), length(started).alias("size")))

    packed = F.aggregate(kept, zero, step, lambda acc: F.when(F.size(acc["current"]) > 0, F.concat(acc["groups"], F.array(acc["current"]))).otherwise(acc["groups"]))
    return packed


def chunks(rows: DataFrame, key: str, text: str, max_chars: int = 1500, overlap: int = 1) -> DataFrame:
    """(key, chunk_id, position, count_for_parent, text): paragraphs of a text are its lines; ids are key__cNNN from 1 on."""
    groups = rows.select(F.col(key), pack(F.transform(F.split(text, "\n"), lambda p: F.trim(p)), max_chars, overlap).alias("groups"))
    out = groups.select(key, F.size("groups").alias("count_for_parent"), F.posexplode("groups").alias("p", "g"))
    return out.select(key, F.format_string("%s__c%03d", F.col(key).cast("string"), F.col("p") + 1).alias("chunk_id"), (F.col("p") + 1).alias("position"), "count_for_parent", F.array_join("g", "\n").alias("text"))


def neighbour_overlap(rows: DataFrame, group: str, order: str, text: str, above: float = 0.8) -> DataFrame:
    """(group, order, jaccard, near_duplicate) of each row's words and the next row's."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    w = rows.select(group, order, words.alias("w"))
    nxt = F.lead("w").over(Window.partitionBy(group).orderBy(order))
    pairs = w.withColumn("n", nxt).where(F.col("n").isNotNull())
    union = F.size(F.array_union("w", "n"))
    j = F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("w", "n")) / F.greatest(union, F.lit(1)))
    return pairs.select(group, order, F.round(j, 6).alias("jaccard"), (j > above).alias("near_duplicate"))


@F.pandas_udf(IntegerType())
def _longest_common(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The longest suffix of the first list that begins the second: one fold of the prefix function over both, whatever its length."""

    def one(a, b) -> int:
        if a is None or b is None or not len(a) or not len(b):
            return 0
        a, b = list(a)[-len(b) :], list(b)
        back, at = [0] * len(b), 0
        for i in range(1, len(b)):
            while at and b[i] != b[at]:
                at = back[at - 1]
            at += b[i] == b[at]
            back[i] = at
        at = 0
        for i, word in enumerate(a):
            if at == len(b):  # only possible before the last word, as a is not longer than b
                at = back[at - 1]
            while at and word != b[at]:
                at = back[at - 1]
            at += word == b[at]
        return at

    for firsts, seconds in pairs:
        yield pd.Series([one(a, b) for a, b in zip(firsts, seconds)], dtype="int32")


def boundary_overlaps(chunks: DataFrame, parent: str = "parent_id", place: str = "position", text: str = "text", split: str = "\n", above: float = 0.8) -> DataFrame:
    """(parent, place, n_shared, shared_chars, near_duplicate) of each chunk of a parent and the next one by place: the lines (parts
    between `split`, a pattern) that end the one and begin the other, as many as possible, their characters, and whether the
    Jaccard similarity of both texts' words is over `above` (not if one has none). Null texts are empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    held = chunks.select(F.col(parent), F.col(place), F.split(body, split).alias("a"), F.array_distinct(F.filter(F.split(body, r"\s+"), lambda w: w != "")).alias("w"))
    order = Window.partitionBy(parent).orderBy(place)
    pairs = held.withColumn("b", F.lead("a").over(order)).withColumn("v", F.lead("w").over(order)).where("b IS NOT NULL")
    counted = pairs.withColumn("n_shared", _longest_common("a", "b"))
    chars = F.aggregate(F.slice("b", F.lit(1), F.col("n_shared")), F.lit(0), lambda n, x: n + F.length(x))
    both = F.size(F.array_intersect("w", "v"))
    alike = (F.size("w") > 0) & (F.size("v") > 0) & (both / F.greatest(F.size("w") + F.size("v") - both, F.lit(1)) > above)
    return counted.select(parent, place, "n_shared", chars.alias("shared_chars"), alike.alias("near_duplicate"))


def overlap_by_parent(chunks: DataFrame, parents: DataFrame, lines: int = 1) -> DataFrame:
    """(parent_id, n_chunks, boundaries_ok, order_kept, shared_lines, shared_chars, near_duplicates) of each parent with two chunks
    or more, of chunks(parent_id, position, text) and parents(parent_id, paragraphs array<string>).

    boundaries_ok: every chunk begins with the last `lines` lines of the one before, no more. order_kept: the chunks, each
    without what it shares with the one before, are the parent's paragraphs in their order. A parent that is not there has none."""
    found = boundary_overlaps(chunks).select("parent_id", (F.col("position")).alias("before"), "n_shared", "shared_chars", "near_duplicate")
    order = Window.partitionBy("parent_id").orderBy("position")
    own = chunks.select("parent_id", "position", F.split(F.coalesce("text", F.lit("")), "\n").alias("l")).withColumn("before", F.lag("position").over(order)).withColumn("first", F.row_number().over(order) == 1)
    both = own.join(found, ["parent_id", "before"], "left")
    fresh = F.slice("l", F.coalesce("n_shared", F.lit(0)) + 1, F.size("l"))
    made = both.groupBy("parent_id").agg(
        F.count("*").alias("n_chunks"), F.bool_and(F.col("first") | (F.col("n_shared") == lines)).alias("boundaries_ok"), F.coalesce(F.sum("n_shared"), F.lit(0)).alias("shared_lines"),
        F.coalesce(F.sum("shared_chars"), F.lit(0)).alias("shared_chars"), F.count_if("near_duplicate").alias("near_duplicates"), F.array_sort(F.collect_list(F.struct("position", fresh.alias("l")))).alias("parts"),
    ).where("n_chunks > 1")
    merged = F.flatten(F.transform("parts", lambda p: p["l"]))
    kept = merged.eqNullSafe(F.coalesce("paragraphs", F.array().cast("array<string>")))
    return made.join(parents.select("parent_id", "paragraphs"), "parent_id", "left").select("parent_id", "n_chunks", "boundaries_ok", kept.alias("order_kept"), "shared_lines", "shared_chars", "near_duplicates")
