"""Connected components by alternating star contractions over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.llm.common import discard, materialize, reading


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) plus m, the least of u and its v's. The minimum is pre-aggregated; the join back can be split by AQE where a node is hot."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _with_least(both).where(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down)
    moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = linked.select("u", F.col("m").alias("v"))
    return moved.unionAll(own).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v), longs; component is the least node reachable.

    Self-links and repeated links are harmless, rows with a null end are ignored, an empty input gives an empty
    result. Each round is written to shared storage, so lineage stays short, and the round before is deleted; the result
    reads the last one. Raises if max_rounds did not suffice."""
    now = materialize(edges.where("u <> v").select("u", "v").distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark or not row["n"]:
            heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return reading(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(heads), now)
        mark = (row["n"], row["h"])
        before, now = now, materialize(_small_star(_large_star(now)), "links")
        discard(before)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
