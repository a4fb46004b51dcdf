"""The evaluation of retrieval: all metrics of all strategies at once, means by stratum, intervals, paired comparisons."""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexmill.operators import stats

KS = (1, 3, 5, 10)


def query_metrics(hits: DataFrame, judgments: DataFrame, evidence: DataFrame, ks: tuple[int, ...] = KS, top: int = 10) -> DataFrame:
    """All metrics of each (strategy, query_id): hit_at_1, mrr, ndcg (at `top`) over parents counted once, recall_k over
    them, unique_parents_k and duplicate_rate_k over raw hits, evidence_hit_k and evidence_recall_k by the anchors of raw hits.

    hits(strategy, query_id, parent_id, rank, start, end), judgments(query_id, parent_id, relevance), evidence(query_id,
    parent_id, order). Every judged query has a row for every strategy that has hits at all, with zeros where it has none.
    Hits are top-k lists: grouped by query they stay short."""
    keys = ["strategy", "query_id"]
    names = hits.select("strategy").distinct()
    relevant = judgments.where("relevance >= 1").groupBy("query_id", "parent_id").agg(F.max("relevance").alias("relevance"))
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    ideal = relevant.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "parent_id")))
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("n_relevant"), F.sum(F.when(F.col("place") <= top, gain / F.log2(F.col("place") + 1.0))).alias("ideal"))
    firsts = hits.groupBy(*keys, "parent_id").agg(F.min("rank").alias("raw"))
    firsts = firsts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("raw", "parent_id"))).join(relevant, ["query_id", "parent_id"])
    dcg = F.sum(F.when(F.col("place") <= top, gain / F.log2(F.col("place") + 1.0))).alias("dcg")
    deduped = firsts.groupBy(*keys).agg(F.min("place").alias("first"), dcg, *[F.count_if(F.col("place") <= k).alias(f"found_{k}") for k in ks])
    raw = hits.groupBy(*keys).agg(
        *[F.count_if(F.col("rank") <= k).alias(f"raw_{k}") for k in ks], *[F.count_distinct(F.when(F.col("rank") <= k, F.col("parent_id"))).alias(f"parents_{k}") for k in ks]
    )
    wanted = evidence.select("query_id", "parent_id", "order").distinct()
    covered = wanted.join(hits.where("start is not null"), ["query_id", "parent_id"]).where("order between start and end")
    covered = covered.groupBy(*keys, "parent_id", "order").agg(F.min("rank").alias("rank")).groupBy(*keys).agg(*[F.count_if(F.col("rank") <= k).alias(f"covered_{k}") for k in ks])
    totals = wanted.groupBy("query_id").agg(F.count("*").alias("n_evidence"))
    every = judgments.select("query_id").distinct().crossJoin(F.broadcast(names))  # strategies are a handful
    r = every.join(ideal, "query_id", "left").join(totals, "query_id", "left").join(deduped, keys, "left").join(raw, keys, "left").join(covered, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = [zero((F.col("first") == 1).cast("double")).alias("hit_at_1"), zero(F.when(F.col("first") <= top, 1.0 / F.col("first"))).alias("mrr"), zero(F.col("dcg") / F.col("ideal")).alias("ndcg")]
    for k in ks:
        n = F.nullif(F.col(f"raw_{k}").cast("double"), F.lit(0.0))
        out += [
            zero(F.col(f"found_{k}") / F.col("n_relevant")).alias(f"recall_{k}"), zero(F.col(f"parents_{k}").cast("double")).alias(f"unique_parents_{k}"), zero(1 - F.col(f"parents_{k}") / n).alias(f"duplicate_rate_{k}"),
            zero((F.col(f"covered_{k}") > 0).cast("double")).alias(f"evidence_hit_{k}"), zero(F.col(f"covered_{k}") / F.col("n_evidence")).alias(f"evidence_recall_{k}"),
        ]
    return r.select(*keys, *out)


def long_form(per_query: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(strategy, query_id, metric, value); null values, metrics that a query lacks, have no row."""
    names = names or [c for c in per_query.columns if c not in ("strategy", "query_id")]
    return per_query.unpivot(["strategy", "query_id"], names, "metric", "value").where("value is not null")


def mean_metrics(values: DataFrame, *cuts: str) -> DataFrame:
    """(strategy, metric, .., n, mean) of long rows over all queries and by each cut (a column of the rows; null is '(sin)'), in one pass."""
    named = values
    for c in cuts:
        named = named.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("(sin)")))
    return named.groupingSets([["strategy", "metric"], *[["strategy", "metric", c] for c in cuts]], "strategy", "metric", *cuts).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def aligned(values: DataFrame) -> DataFrame:
    """Rows of the queries that every strategy has, of each metric."""
    n = values.select("strategy").distinct().count()
    both = values.groupBy("metric", "query_id").agg(F.count_distinct("strategy").alias("__n")).where(F.col("__n") == n)
    return values.join(both.select("metric", "query_id"), ["metric", "query_id"], "left_semi")


def intervals(values: DataFrame, method=stats.bootstrap_ci) -> DataFrame:
    """(strategy, metric, mean, lo, hi, n) of long rows; one group is one value a question."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = method(pdf.sort_values("query_id")["value"].to_numpy())
        return pd.DataFrame([{"strategy": pdf["strategy"].iloc[0], "metric": pdf["metric"].iloc[0], **got}])[["strategy", "metric", "mean", "lo", "hi", "n"]]

    return values.groupBy("strategy", "metric").applyInPandas(run, "strategy string, metric string, mean double, lo double, hi double, n long")


def paired_vs_baseline(values: DataFrame, baseline: str, margin: float | None = None) -> DataFrame:
    """(metric, strategy, diff, lo, hi, p, n, adjusted, significant[, equivalent]): each strategy against one baseline over the
    questions both have; Holm's correction within a metric. An unknown baseline raises."""
    if values.where(F.col("strategy") == baseline).isEmpty():
        raise KeyError(baseline)
    base = values.where(F.col("strategy") == baseline).select("metric", "query_id", F.col("value").alias("base"))
    pairs = values.where(F.col("strategy") != baseline).join(base, ["metric", "query_id"])
    schema = "metric string, strategy string, diff double, lo double, hi double, p double, n long, equivalent boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.sort_values("query_id")
        got = stats.paired_bootstrap(one["value"], one["base"])
        same = stats.tost(one["value"], one["base"], margin)["equivalent"] if margin is not None else None
        return pd.DataFrame([{"metric": pdf["metric"].iloc[0], "strategy": pdf["strategy"].iloc[0], **got, "equivalent": same}])

    tested = pairs.groupBy("metric", "strategy").applyInPandas(run, schema)
    order = Window.partitionBy("metric").orderBy("p", "strategy")
    ranked = tested.withColumn("__i", F.row_number().over(order)).withColumn("__m", F.count("*").over(Window.partitionBy("metric")))
    step = F.max(F.col("p") * (F.col("__m") - F.col("__i") + 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = ranked.withColumn("adjusted", F.least(F.lit(1.0), step)).withColumn("significant", F.col("adjusted") < 0.05).drop("__i", "__m")
    return out if margin is not None else out.drop("equivalent")


def evaluate_strategies(runs: dict[str, DataFrame], questions: DataFrame, judgments: DataFrame, evidence: DataFrame, baseline: str, ks: tuple[int, ...] = KS) -> dict[str, DataFrame]:
    """per_query, means (overall, by style and by scope), intervals and paired comparisons of named runs(query_id, parent_id,
    rank, start, end) over questions(query_id, style, scope)."""
    hits = reduce(DataFrame.unionByName, [r.select(F.lit(n).alias("strategy"), "query_id", "parent_id", "rank", "start", "end") for n, r in runs.items()])
    per_query = query_metrics(hits, judgments, evidence, ks)
    values = long_form(per_query)
    return {
        "per_query": per_query, "means": mean_metrics(values.join(questions.select("query_id", "style", "scope"), "query_id", "left"), "style", "scope"),
        "intervals": intervals(values), "paired": paired_vs_baseline(values, baseline),
    }


def context_metrics(contexts: DataFrame, relevant: DataFrame, evidence: DataFrame) -> DataFrame:
    """Metrics of assembled contexts for each query of contexts(query_id, parent_id, orders array<int>, char_count, item_count,
    base_char_count): recall of evidence(query_id, parent_id, order), precision and recall by parent, sizes, expansion, share
    of repeated paragraphs, evidence_density (share of distinct context paragraphs that are evidence). relevant(query_id, parent_id)."""
    sums = contexts.groupBy("query_id").agg(
        F.sum("char_count").cast("double").alias("characters"), F.sum("item_count").cast("double").alias("items"), F.sum("base_char_count").alias("base"), F.sum(F.size("orders")).alias("paragraphs"),
        F.count_distinct("parent_id").alias("parents"),
    )
    places = contexts.select("query_id", "parent_id", F.explode("orders").alias("order")).distinct()
    distinct = places.groupBy("query_id").agg(F.count("*").alias("distinct_paragraphs"))
    wanted = evidence.select("query_id", "parent_id", "order").distinct()
    total = wanted.groupBy("query_id").agg(F.count("*").alias("n_evidence"))
    covered = wanted.join(places, ["query_id", "parent_id", "order"], "left_semi").groupBy("query_id").agg(F.count("*").alias("covered"))
    rel = relevant.select("query_id", "parent_id").distinct()
    n_rel = rel.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    right = contexts.select("query_id", "parent_id").distinct().join(rel, ["query_id", "parent_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("right"))
    r = reduce(lambda a, b: a.join(b, "query_id", "left"), [distinct, total, covered, n_rel, right], sums)
    share = lambda a, b: F.coalesce(F.coalesce(F.col(a), F.lit(0)) / F.nullif(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0))
    return r.withColumn("repeated", F.col("paragraphs") - F.coalesce("distinct_paragraphs", F.lit(0))).select(
        "query_id", share("covered", "n_evidence").alias("evidence_recall"), share("right", "parents").alias("precision"), share("right", "n_relevant").alias("recall"), "characters", "items",
        share("characters", "base").alias("expansion_ratio"), share("repeated", "paragraphs").alias("redundancy"), share("covered", "distinct_paragraphs").alias("evidence_density"),
    )


def _kappas(matrix: np.ndarray) -> dict[str, float | None]:
    n, q = matrix.sum(), len(matrix)
    if not n:
        return {"kappa": None, "weighted_kappa": None, "ac1": None}
    rows, cols = matrix.sum(1) / n, matrix.sum(0) / n
    out, far = {}, np.abs(np.subtract.outer(np.arange(q), np.arange(q)))
    for name, weight in (("kappa", (far > 0).astype(float)), ("weighted_kappa", far / max(1, q - 1))):
        chance = float((weight * np.outer(rows, cols)).sum())
        out[name] = 1.0 if chance == 0 else 1 - float((weight * matrix).sum()) / n / chance
    mean = (rows + cols) / 2
    by_chance = float((mean * (1 - mean)).sum()) / (q - 1) if q > 1 else 1.0
    observed = float(np.trace(matrix)) / n
    out["ac1"] = 1.0 if q < 2 or by_chance == 1 else (observed - by_chance) / (1 - by_chance)
    return out


def agreement_intervals(pairs: DataFrame, labels: list | None = None, resamples: int = 2000, seed: int = 42, alpha: float = 0.05, order: str = "query_id") -> DataFrame:
    """(measure, value, lo, hi, n) of kappa, weighted_kappa (only with an order of labels) and ac1 of pairs(human, judge) in
    the order of a key. Labels outside the list come after it, sorted. Resampling draws with Python's seeded generator;
    pairs are one annotation round, read whole by one task. Under two pairs there are no ends."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["human", "judge"]).sort_values("order")
        h, j = pdf["human"].tolist(), pdf["judge"].tolist()
        named = list(labels or [])
        named += sorted({*h, *j} - {*named})
        code = {x: i for i, x in enumerate(named)}
        q, n = len(named), len(h)
        cells = np.array([code[a] * q + code[b] for a, b in zip(h, j)], np.int64)
        count = lambda c: np.bincount(c, minlength=q * q).reshape(q, q).astype(float)
        measures = ("kappa", "weighted_kappa", "ac1") if labels is not None else ("kappa", "ac1")
        values, ends = _kappas(count(cells)) if n else dict.fromkeys(measures), {}
        if n >= 2 and resamples > 0:
            rng = random.Random(seed)  # each measure draws the same stream
            drawn = [_kappas(count(cells[[rng.randrange(n) for _ in range(n)]])) for _ in range(resamples)]
            for m in measures:
                s = sorted(d[m] for d in drawn if d[m] is not None)
                ends[m] = (s[int(alpha / 2 * len(s))], s[min(len(s) - 1, int((1 - alpha / 2) * len(s)))])
        return pd.DataFrame([{"measure": m, "value": values[m], "lo": ends.get(m, (None, None))[0], "hi": ends.get(m, (None, None))[1], "n": n} for m in measures])

    one = pairs.select(F.col(order).alias("order"), "human", "judge").withColumn("one", F.lit(1))
    return one.groupBy("one").applyInPandas(run, "measure string, value double, lo double, hi double, n long")


def confusion(pairs: DataFrame, labels: list) -> DataFrame:
    """(human, judge, n) for every pair of the labels, zeros included, and for every other pair that occurs."""
    counted = pairs.where("human is not null and judge is not null").groupBy("human", "judge").agg(F.count("*").alias("n"))
    kind = pairs.schema["human"].dataType
    one = pairs.sparkSession.createDataFrame([(x,) for x in labels], f"label {kind.simpleString()}")
    grid = one.select(F.col("label").alias("human")).crossJoin(one.select(F.col("label").alias("judge")))
    return grid.join(counted, ["human", "judge"], "full_outer").select("human", "judge", F.coalesce("n", F.lit(0)).alias("n"))


def disagreements(human: DataFrame, judge: DataFrame, column: str) -> DataFrame:
    """(query_id, human, judge) of the questions that both judged, and differently; nulls on a side do not count."""
    both = human.select("query_id", F.col(column).alias("human")).join(judge.select("query_id", F.col(column).alias("judge")), "query_id")
    return both.where("human <> judge")


def top1_scores(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, score): the best score of each query, 0 without hits."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("score"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def fusion_grid(dense: DataFrame, lexical: DataFrame, alphas: list[float], k: int = 10, rrf_k: int = 60, digits: int = 6) -> DataFrame:
    """(strategy, query_id, unit_id, score, rank): both runs, their reciprocal-rank fusion and a weighted fusion for each alpha,
    from one scaling of both lists."""
    from codexmill.operators import retrieval

    d, x = retrieval.min_max(dense).withColumnRenamed("score", "d"), retrieval.min_max(lexical).withColumnRenamed("score", "x")
    both = d.join(x, ["query_id", "unit_id"], "full_outer").na.fill(0.0, ["d", "x"])
    grid = both.select("query_id", "unit_id", F.explode(F.array(*[F.struct(F.lit(f"weighted_{a:.1f}").alias("strategy"), F.round(a * F.col("d") + (1 - a) * F.col("x"), digits).alias("score")) for a in alphas])).alias("g"))
    place = Window.partitionBy("strategy", "query_id").orderBy(F.col("score").desc(), "unit_id")
    weighted = grid.select("g.strategy", "query_id", "unit_id", "g.score").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    named = lambda run, name: run.where(F.col("rank") <= k).select(F.lit(name).alias("strategy"), "query_id", "unit_id", "score", "rank")
    return weighted.unionByName(named(dense, "dense")).unionByName(named(lexical, "bm25")).unionByName(named(retrieval.fuse_rrf([dense, lexical], k, rrf_k), "rrf"))

