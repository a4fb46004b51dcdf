"""Registered queries: token windows, embedding inputs, outcomes of answers, citations, metric groups, dataset checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.operators import generation, quality, windows
from codexmill.plans.catalogue import _t
from codexmill.registry import query

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_WIDTH, _OVERLAP = 128, 16
_STEP = _WIDTH - _OVERLAP
_CUT = f"""d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
c AS (SELECT doc_id, w, len(w) AS n, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= {_WIDTH} THEN 1 ELSE ((len(w) - {_WIDTH} + {_STEP - 1}) // {_STEP}) + 1 END)) AS win FROM d),
x AS (SELECT *, win * {_STEP} AS s, least(win * {_STEP} + {_WIDTH}, n) AS e FROM c)"""


def _words(text: str = "text"):
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


@query(f"""WITH {_CUT}, o AS (SELECT *, row_number() OVER (ORDER BY doc_id, win) - 1 AS row_index, array_to_string(w[s + 1:e], ' ') AS t FROM x)
SELECT row_index, 'ein_' || lpad(row_index::VARCHAR, greatest(6, len(row_index::VARCHAR))::INT, '0') AS embedding_input_id, doc_id, win::INT AS "window", (e - s)::INT AS n_tokens, n > {_WIDTH} AS overflow, sha256(t) AS sha256 FROM o""")
def embedding_inputs(spark, d):
    """Words as tokens; long texts become overlapping windows; every row numbered from 0 on."""
    texts = _t(spark, d, "documents").select("doc_id", _words().alias("tokens"))
    return windows.embedding_inputs(texts, "doc_id", _WIDTH, _OVERLAP).drop("text")


@query(f"""WITH {_CUT}, p0 AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
p AS (SELECT doc_id, k, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS m FROM p0),
i AS (SELECT doc_id, k, m, sum(m) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM p)
SELECT x.doc_id, win::INT AS "window", min(k)::INT AS first_paragraph, max(k)::INT AS last_paragraph, count(*)::INT AS n_paragraphs
FROM x JOIN i ON x.doc_id = i.doc_id AND stop - m < e AND stop > s AND m > 0 GROUP BY ALL""")
def window_anchors(spark, d):
    """The lines of its document that each token window touches."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.size(F.regexp_extract_all(x, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    docs = _t(spark, d, "documents").where("text is not null").select("doc_id", lines.alias("m"))
    docs = docs.select("doc_id", windows.token_intervals(F.col("m")).alias("i"), F.aggregate("m", F.lit(0), lambda a, x: a + x).alias("n"))
    cut = docs.select("doc_id", "i", F.posexplode(windows.token_windows(F.col("n"), _WIDTH, _OVERLAP)).alias("window", "w"))
    hit = cut.select("doc_id", "window", windows.touched(F.col("i"), F.col("w")).alias("k")).where(F.size("k") > 0)
    return hit.select("doc_id", "window", F.array_min("k").alias("first_paragraph"), F.array_max("k").alias("last_paragraph"), F.size("k").alias("n_paragraphs"))


@query("""WITH r AS (SELECT source, toxic = 0 AS answered, quality = 1 AS answerable, l.doc_id % 17 = 0 AS bad FROM labels l JOIN documents USING (doc_id)),
c AS (SELECT source, count(*) AS n, count(*) FILTER (bad) AS n_errors, count(*) FILTER (NOT bad AND answered AND answerable) AS "answered", count(*) FILTER (NOT bad AND answered AND NOT answerable) AS false_answer,
  count(*) FILTER (NOT bad AND NOT answered AND answerable) AS over_abstention, count(*) FILTER (NOT bad AND NOT answered AND NOT answerable) AS correct_abstention FROM r GROUP BY source),
a AS (SELECT *, CASE WHEN "answered" + over_abstention > 0 THEN "answered" / ("answered" + over_abstention)::DOUBLE END AS x,
  CASE WHEN correct_abstention + false_answer > 0 THEN correct_abstention / (correct_abstention + false_answer)::DOUBLE END AS y FROM c)
SELECT source, n, n_errors, "answered", false_answer, over_abstention, correct_abstention, round(x, 6) AS answer_accuracy, round(y, 6) AS abstention_accuracy,
  round(CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x ELSE (x + y) / 2 END, 6) AS balanced_accuracy FROM a""")
def answer_outcomes(spark, d):
    """Answered against answerable by source; labels stand for both."""
    r = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    r = r.select("source", (F.col("toxic") == 0).alias("answered"), (F.col("quality") == 1).alias("answerable"), F.when(F.col("doc_id") % 17 == 0, "failed").alias("error"))
    return generation.outcome_summary(r, "source")


@query("""WITH s AS (SELECT l_orderkey, count(DISTINCT l_partkey) FILTER (l_linenumber <= 2) AS n, count(DISTINCT l_partkey) FILTER (l_quantity > 25) AS m,
  len(list_intersect(coalesce(list(DISTINCT l_partkey) FILTER (l_linenumber <= 2), []), coalesce(list(DISTINCT l_partkey) FILTER (l_quantity > 25), []))) AS b FROM lineitem GROUP BY l_orderkey),
v AS (SELECT l_orderkey, CASE WHEN m > 0 THEN CASE WHEN n > 0 THEN b / n::DOUBLE ELSE 0 END END AS p, CASE WHEN m > 0 THEN b / m::DOUBLE END AS r FROM s)
SELECT l_orderkey, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) WHEN p IS NOT NULL THEN 0 END, 6) AS f1 FROM v""")
def citation_scores(spark, d):
    """Parts cited (first two lines of an order) against parts that ought to be (large quantities)."""
    sets = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_partkey"))).alias("c"), F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("g"))
    return sets.select("l_orderkey", *[F.round(x, 6).alias(k) for k, x in generation.set_scores(F.col("c"), F.col("g")).items()])


@query("""WITH l AS (SELECT event_type, value FROM events) SELECT coalesce(event_type, '(sin)') AS stratum, count(*) AS n, round(avg(value), 6) AS mean,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS largest FROM l GROUP BY 1""")
def stratum_latency(spark, d):
    """Means and interpolated percentiles by stratum."""
    g = _t(spark, d, "events").groupBy(F.coalesce("event_type", F.lit("(sin)")).alias("stratum"))
    return g.agg(F.count("*").alias("n"), *[F.round(x, 6).alias(a) for a, x in (("mean", F.avg("value")), ("p50", F.percentile("value", F.lit(0.5))), ("p95", F.percentile("value", F.lit(0.95))), ("largest", F.max("value")))])


@query("""SELECT 'unknown_document' AS check_name, 'ERROR' AS severity, doc_id::VARCHAR AS ref FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
UNION ALL SELECT 'repeated_label', 'ERROR', doc_id::VARCHAR FROM labels GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'value_out_of_range', 'ERROR', doc_id::VARCHAR FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)
UNION ALL SELECT 'split_leakage', 'ERROR', sha256(text) FROM documents JOIN labels USING (doc_id) GROUP BY text HAVING count(DISTINCT doc_id % 5 = 0) > 1""")
def dataset_checks(spark, d):
    """References, repeated keys, values, and texts that stand in both splits."""
    labels, docs = _t(spark, d, "labels"), _t(spark, d, "documents")
    odd = quality.rule_findings(labels, F.col("doc_id"), [("value_out_of_range", quality.ERROR, ~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1))])
    both = docs.join(labels, "doc_id").select(F.sha2("text", 256).alias("ref"), (F.col("doc_id") % 5 == 0).cast("int").alias("s")).groupBy("ref").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    leak = both.where("lo < hi").select(F.lit("split_leakage").alias("check_name"), F.lit(quality.ERROR).alias("severity"), "ref")
    return quality.missing_references(labels, "doc_id", docs, "doc_id", "unknown_document").unionByName(quality.repeated_keys(labels, ["doc_id"], "repeated_label")).unionByName(odd).unionByName(leak)
