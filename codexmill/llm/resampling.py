"""Importance resampling towards a target distribution of hashed words, scored without exploding a document."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.llm.common import discard, materialize, reading

BUCKETS = 10_000
#: Longest run of words that is a feature; documents under MIN_WORDS words are never drawn; PERCENT of the others are.
LONGEST, MIN_WORDS, PERCENT, SEED = 1, 20, 10, 2024
#: Capitals and what they become; a word is a run of digits, small letters and characters above ASCII. Naming what
#: is in the class and not what is outside takes a sixth of the time.
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[0-9a-z\x80-\x{10FFFF}]+"
#: Bits of a row's place below those of its partition in monotonically_increasing_id.
_PLACE_BITS = 33


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lowered (lower() would move other letters too)."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL), F.lit(_WORD), 0)


def bucket_array(words: Column, buckets: int = BUCKETS, longest: int = LONGEST) -> Column:
    """array<int>: the bucket of every run of 1 to `longest` consecutive words, repeats included; a run's words are joined by a space."""

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    def runs(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: i + n - 1 <= F.size(words))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))

    return F.concat(F.transform(words, bucket), *map(runs, range(2, longest + 1)))


def bucketed(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, buckets) of every row; null texts have no words."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    return held.select("doc_id", F.size("words").alias("n_words"), bucket_array(F.col("words"), buckets, longest).alias("buckets"))


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features in each bucket over all rows; partial sums are all that is shuffled, `buckets` rows all that is collected."""
    found = [0] * buckets
    for r in rows.select(F.explode("buckets").alias("b")).groupBy("b").count().collect():
        found[r["b"]] = r["count"]
    return found


def bucket_gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln of the ratio of smoothed shares) for each bucket."""
    buckets, total, wanted = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((t + 1) * float(total + buckets) / ((s + 1) * float(wanted + buckets)))) for s, t in zip(source, target)]


def document_weight(buckets: Column, gains: list[int]) -> Column:
    """The floored mean of the gains of a document's buckets, looked up in one literal array; 0 without features."""
    table = F.lit(np.array(gains, np.int64))
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda s, b: s + F.element_at(table, b + 1))
    n = F.greatest(F.size(buckets), F.lit(1)).cast("long")
    return ((total - F.pmod(total, n)) / n).cast("long")  # the division leaves no rest


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * a Gumbel value) drawn by the SHA-256 of seed and id; a null id counts as the empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs(doc_id, text); rank is null for those not drawn.

    Texts become arrays of bucket numbers once, in a stored table; totals of both sides are counted from arrays, gains are a
    literal array, and a document is scored inside its row. Ranks come from a stored global order by score, then doc_id (nulls
    last), then place in the stored table, so no key is hot: a partition's rows before it are added to the place in it.

    Null and empty texts have no features, weight 0, and are not drawn; rows with a null or repeated id are scored and drawn
    each; ties go to the smaller id; without target texts gains follow the source alone; an empty table gives an empty
    result; extra columns are ignored, whatever their names; a text's length is bounded by a row's only."""
    stored = materialize(bucketed(docs, buckets, longest), "bucket-arrays", "zstd")
    gains = bucket_gains(bucket_counts(stored, buckets), bucket_counts(bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, longest), buckets))
    weight = document_weight(F.col("buckets"), gains)
    scored = stored.select("doc_id", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"), (F.col("n_words") >= min_words).alias("able"))
    scored = materialize(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resampling-scores")
    discard(stored)
    placed = scored.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    ordered = placed.orderBy(F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "file", "row").drop("file", "row")
    ordered = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "resampling-order")
    discard(scored)
    part = F.shiftright("at", _PLACE_BITS)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("able_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the order
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    drawn = (sizes.agg(F.sum("able_rows")).first()[0] or 0) * percent // 100
    numbered = ordered.withColumn("part", part).join(starts, "part")
    rank = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1
    return reading(numbered.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (rank <= drawn), rank).alias("rank")), ordered)
