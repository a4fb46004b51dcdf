"""Ranking, agreement and threshold metrics as aggregations."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

Z95 = 1.959963984540054
#: Ranges into which an ordered running value is cut: one row of each is carried on, whatever the input's size.
RANGES = 1024


def _ranged(rows: DataFrame, column: str) -> DataFrame:
    """rows with __range, which never falls as the column grows: at most RANGES + 1 of about equal size, NaN in the last.

    Equal values are in one range. The quantiles are approximate and change only the sizes; what is gathered are RANGES numbers."""
    held = rows.withColumn("__value", F.col(column).cast("double"))
    inner = [k / RANGES for k in range(1, RANGES)]
    found = {x for x in held.approxQuantile("__value", inner, 1 / (4 * RANGES)) if abs(x) != float("inf")}
    splits = [float("-inf"), *sorted(found), float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    cut = Bucketizer(splits=splits, inputCol="__value", outputCol="__range", handleInvalid="keep")
    return cut.transform(held).drop("__value")


def unique_parents(hits: DataFrame) -> DataFrame:
    """The best hit of each parent of a query, ranked anew."""
    first = hits.groupBy("query_id", "parent_id").agg(F.min("rank").alias("raw_rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("raw_rank", "parent_id")))


def ranking_metrics(hits: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, hit_at_1, mrr, recall, ndcg) of hits(query_id, parent_id, rank) against judgments(query_id, parent_id,
    relevance) for every judged query. Parents count once; gain 2^relevance - 1, discount log2(rank + 1); the ideal holds
    judged parents that were not found; without relevant parents all are 0."""
    relevant = judgments.where("relevance >= 1").groupBy("query_id", "parent_id").agg(F.max("relevance").alias("relevance"))
    gain, discount = F.pow(F.lit(2.0), F.col("relevance")) - 1, F.log2(F.col("rank") + 1.0)
    ideal = relevant.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "parent_id")))
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("rank") <= k, gain / discount)).alias("ideal"))
    top = unique_parents(hits).where(F.col("rank") <= k).join(relevant, ["query_id", "parent_id"])
    got = top.groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(gain / discount).alias("dcg"))
    every = judgments.select("query_id").distinct()
    r = every.join(ideal, "query_id", "left").join(got, "query_id", "left")
    zero = F.lit(0.0)
    return r.select(
        "query_id", F.coalesce((F.col("first") == 1).cast("double"), zero).alias("hit_at_1"), F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
        F.coalesce(F.col("found") / F.col("n"), zero).alias("recall"), F.coalesce(F.col("dcg") / F.col("ideal"), zero).alias("ndcg"),
    )


def label_metrics(hits: DataFrame, queries: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """What `ranking_metrics` gives if a parent is relevant, at 1, to the queries of its label: of hits(query_id, parent_id, rank),
    queries(query_id, label) and members(parent_id, label). Relevant pairs are never listed: a label's members are counted,
    labels are joined to the hits. Queries of a label without members, or of none, are not judged; repeated members count once."""
    sizes = members.where("label is not null").distinct().groupBy("label").agg(F.count("*").alias("n"))
    ideals = F.lit([0.0]) if k < 1 else F.array(*[sum((1 / F.log2(F.lit(i + 1.0)) for i in range(1, m + 1)), F.lit(0.0)) for m in range(1, k + 1)])
    asked = queries.distinct().join(sizes, "label").select("query_id", "label", "n", F.element_at(ideals, F.least("n", F.lit(max(k, 1))).cast("int")).alias("ideal"))
    top = unique_parents(hits).where(F.col("rank") <= k).join(asked.select("query_id", "label"), "query_id")
    top = top.join(members.distinct(), ["parent_id", "label"], "left_semi")
    got = top.groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    zero = F.lit(0.0)
    return asked.join(got, "query_id", "left").select(
        "query_id", F.coalesce((F.col("first") == 1).cast("double"), zero).alias("hit_at_1"), F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
        F.coalesce(F.col("found") / F.col("n"), zero).alias("recall"), F.coalesce(F.col("dcg") / F.nullif("ideal", zero), zero).alias("ndcg"),
    )


def raw_hit_metrics(hits: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, unique_parents, duplicate_rate) of the first k raw hits; with queries, those without hits have zeros."""
    top = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("parent_id").alias("unique_parents"))
    if queries is not None:
        top = queries.select("query_id").distinct().join(top, "query_id", "left").na.fill(0, ["unique_parents"])
    return top.select("query_id", "unique_parents", F.coalesce(1 - F.col("unique_parents") / F.col("n"), F.lit(0.0)).alias("duplicate_rate"))


def evidence_recall(hits: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    """(query_id, evidence_hit, evidence_recall): evidence(query_id, parent_id, order) that lies between the anchors
    (start, end) of a hit among the first k; a hit without an anchor covers nothing."""
    h = hits.where((F.col("rank") <= k) & F.col("start").isNotNull()).select("query_id", "parent_id", "start", "end")
    e = evidence.select("query_id", "parent_id", "order").distinct()
    covered = e.join(h, ["query_id", "parent_id"]).where("order between start and end").select("query_id", "parent_id", "order").distinct().withColumn("c", F.lit(1))
    return e.join(covered, ["query_id", "parent_id", "order"], "left").groupBy("query_id").agg(F.max(F.coalesce("c", F.lit(0))).cast("double").alias("evidence_hit"), F.avg(F.coalesce("c", F.lit(0))).alias("evidence_recall"))


def pareto_front(points: DataFrame, key: str, quality: str, cost: str) -> DataFrame:
    """Points that no other beats: quality at least as high and cost at most as high, one of them strictly. Equal points
    stay together. One pass over costs: the best quality of each cost, and the best of all lower costs."""
    by_cost = points.groupBy(cost).agg(F.max(quality).alias("__best"))
    # a running maximum over the distinct costs, cut into ranges so that no task gets all of them
    ranged = _ranged(by_cost.where(F.col(cost).isNotNull()), cost)
    inner = Window.partitionBy("__range").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    heads = ranged.groupBy("__range").agg(F.max("__best").alias("__top"))
    before = heads.withColumn("__before", F.max("__top").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).select("__range", "__before")
    cheaper = ranged.withColumn("__inside", F.max("__best").over(inner)).join(F.broadcast(before), "__range").select(cost, "__best", F.greatest("__inside", "__before").alias("__cheaper"))
    kept = cheaper.where(F.col("__cheaper").isNull() | (F.col("__best") > F.col("__cheaper"))).select(cost, "__best")
    return points.join(kept, cost).where(F.col(quality) == F.col("__best")).select(key, quality, cost)


def auc_threshold(scored: DataFrame) -> DataFrame:
    """One row (auc, threshold, balanced_accuracy) of scored(score, positive).

    auc counts pairs, ties as half; the threshold (score >= it is positive) is the lowest of those with the best balanced
    accuracy. Scores are counted first, then cut into ranges whose sums are carried on, so no task gets all of them."""
    by = scored.where("score is not null").groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    ranged = _ranged(by, "score")
    heads = ranged.groupBy("__range").agg(F.sum("p").alias("__p"), F.sum("n").alias("__n"))
    lower = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    before = heads.select("__range", F.coalesce(F.sum("__p").over(lower), F.lit(0)).alias("__p"), F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__n"))
    up = Window.partitionBy("__range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("p_below", F.coalesce(F.sum("p").over(up), F.lit(0))).withColumn("n_below", F.coalesce(F.sum("n").over(up), F.lit(0)))
    steps = inside.join(F.broadcast(before), "__range").select("score", "p", "n", (F.col("p_below") + F.col("__p")).alias("p_below"), (F.col("n_below") + F.col("__n")).alias("n_below"))
    totals = by.agg(F.sum("p").alias("np"), F.sum("n").alias("nn"))
    at = steps.crossJoin(F.broadcast(totals)).withColumn("bal", F.round(((F.col("np") - F.col("p_below")) / F.col("np") + F.col("n_below") / F.col("nn")) / 2, 10))
    return at.agg(
        F.round(F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2)) / (F.max("np") * F.max("nn")), 4).alias("auc"),
        F.max_by("score", F.struct("bal", -F.col("score"))).alias("threshold"), F.round(F.max("bal"), 4).alias("balanced_accuracy"),
    )


def holm(pvalues: DataFrame, key: str, p: str, alpha: float = 0.05) -> DataFrame:
    """(key, p, adjusted, significant): step-down over all rows, a statistic's few comparisons; ties by key."""
    order = Window.orderBy(p, key)
    ranked = pvalues.select(key, p, F.row_number().over(order).alias("i"), F.count("*").over(Window.partitionBy()).alias("m"))
    step = F.max(F.col(p) * (F.col("m") - F.col("i") + 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.select(key, p, F.least(F.lit(1.0), step).alias("adjusted")).withColumn("significant", F.col("adjusted") < alpha)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Ends of the Wilson interval, cut to 0..1; (0, 0) for no trials."""
    p = k / F.nullif(n.cast("double"), F.lit(0.0))
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.coalesce(F.greatest(F.lit(0.0), mid - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), mid + half), F.lit(0.0))


def agreement(pairs: DataFrame, labels: list) -> DataFrame:
    """One row (n, agreement, kappa, weighted_kappa, ac1) of pairs(human, judge) over an ordered list of labels; labels
    outside the list come after it, sorted.

    Only the confusion matrix (one row for each pair of labels) is gathered in one place."""
    seen = pairs.select(F.explode(F.array("human", "judge")).alias("x")).where("x is not null").distinct()
    labels = [*labels, *sorted(r["x"] for r in seen.collect() if r["x"] not in labels)]
    spark, q = pairs.sparkSession, len(labels)
    places = spark.createDataFrame([(x, i) for i, x in enumerate(labels)], StructType([StructField("label", pairs.schema["human"].dataType), StructField("place", IntegerType())]))
    cell = pairs.groupBy("human", "judge").agg(F.count("*").alias("c"))
    h, j = F.broadcast(places.withColumnRenamed("place", "i")), F.broadcast(places.withColumnRenamed("place", "j"))
    cell = cell.join(h.withColumnRenamed("label", "human"), "human").join(j.withColumnRenamed("label", "judge"), "judge")
    lists = cell.agg(F.sum("c").alias("n"), F.collect_list(F.struct("i", "j", "c")).alias("m"))
    total = lambda f: F.aggregate("m", F.lit(0.0), lambda acc, x: acc + f(x) * x["c"])
    n = F.col("n")
    rows = [total(lambda x, k=k: (x["i"] == k).cast("double")) / n for k in range(q)]
    cols = [total(lambda x, k=k: (x["j"] == k).cast("double")) / n for k in range(q)]
    observed = total(lambda x: (x["i"] == x["j"]).cast("double")) / n
    gap = total(lambda x: F.abs(x["i"] - x["j"]).cast("double")) / n
    chance = sum((r * c for r, c in zip(rows, cols)), F.lit(0.0))
    chance_gap = sum((rows[a] * cols[b] * abs(a - b) for a in range(q) for b in range(q)), F.lit(0.0))
    means = [(r + c) / 2 for r, c in zip(rows, cols)]
    pe = sum((x * (1 - x) for x in means), F.lit(0.0)) / max(1, q - 1)
    kappa = F.when(chance == 1, 1.0).otherwise((observed - chance) / F.nullif(1 - chance, F.lit(0.0)))
    weighted = F.when(chance_gap == 0, 1.0).otherwise(1 - gap / F.nullif(chance_gap, F.lit(0.0)))
    ac1 = F.lit(1.0) if q < 2 else F.when(pe == 1, 1.0).otherwise((observed - pe) / F.nullif(1 - pe, F.lit(0.0)))
    return lists.select("n", *[F.round(x, 6).alias(a) for x, a in ((observed, "agreement"), (kappa, "kappa"), (weighted, "weighted_kappa"), (ac1, "ac1"))])
