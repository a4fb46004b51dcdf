"""Registered queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.operators import blocks, context, metrics, quality, retrieval, stats
from codexmill.registry import query


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_DENSE = """
s AS (SELECT q.vec_id AS query_id, r.vec_id AS unit_id, q.label AS query_label, r.label AS label,
  round(list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 12) AS raw, round(list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, unit_id) AS rank FROM s QUALIFY rank <= 10)"""


def _dense(spark: SparkSession, d: str, k: int = 10, rows=None) -> DataFrame:
    e = _t(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = e if rows is None else rows(e)
    return retrieval.dense_search(rows.select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector")), queries, k)


@query(f"WITH {_DENSE} SELECT query_id, unit_id, score, rank FROM dense")
def dense_top10(spark, d):
    return _dense(spark, d)


@query(f"WITH {_DENSE}".replace("WHERE q.vec_id % 100 = 0", "WHERE q.vec_id % 100 = 0 AND r.label IN (1, 3, 5)") + " SELECT query_id, unit_id, score, rank FROM dense")
def dense_top10_filtered(spark, d):
    return _dense(spark, d, rows=lambda e: e.where(F.col("label").isin(1, 3, 5)))


@query(f"""WITH {_DENSE},
n AS (SELECT q.vec_id AS query_id, q.label, count(*) AS n FROM embeddings q JOIN embeddings r USING (label) WHERE q.vec_id % 100 = 0 GROUP BY ALL),
g AS (SELECT query_id, count(*) AS found, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM dense WHERE label = query_label GROUP BY query_id),
i AS (SELECT query_id, sum(1 / log2(k + 1)) AS ideal FROM (SELECT query_id, unnest(range(1, least(10, n) + 1)) AS k FROM n) GROUP BY query_id),
m AS (SELECT n.label, coalesce((first = 1)::INT::DOUBLE, 0) AS hit, coalesce(1.0 / first, 0) AS mrr, coalesce(found / n.n, 0) AS recall, coalesce(dcg / ideal, 0) AS ndcg FROM n LEFT JOIN g USING (query_id) LEFT JOIN i USING (query_id))
SELECT label, count(*) AS n_queries, round(avg(hit), 6) AS hit_at_1, round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY label""")
def retrieval_quality_by_label(spark, d):
    """Dense search, judged by equal labels, averaged by the query's label."""
    e = _t(spark, d, "embeddings").select("vec_id", "label")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label"))
    per_query = metrics.label_metrics(_dense(spark, d).withColumnRenamed("unit_id", "parent_id"), asked, e.withColumnRenamed("vec_id", "parent_id"))
    return per_query.join(asked, "query_id").groupBy("label").agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit_at_1", "mrr", "recall", "ndcg")])


_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '\d+(?:[.,/]\d+)*|[a-záéíóúüñçàèìòùâêîôûäöß]+')"
_BM25 = f"""
d AS (SELECT doc_id AS unit_id, {_TOKENS} AS w FROM documents),
tf AS (SELECT token, unit_id, dl, count(*) AS tf FROM (SELECT unit_id, len(w) AS dl, unnest(w) AS token FROM d) GROUP BY ALL),
z AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
i0 AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT token, count(*) AS df FROM tf GROUP BY token), z),
i AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
q AS (SELECT query_id, token, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY ALL),
bs AS (SELECT query_id, unit_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN i USING (token) JOIN tf USING (token), z GROUP BY ALL),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM bs QUALIFY rank <= 10)"""


def _bm25(spark, d, k=10, rows=None):
    docs = _t(spark, d, "documents")
    docs = docs if rows is None else rows(docs)
    queries = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("tokens"))
    return retrieval.bm25_search(docs.select(F.col("doc_id").alias("unit_id"), "text"), queries, k, tokens=T.tokens(F.col("text")), spread=spark.sparkContext.defaultParallelism)


@query(f"WITH {_BM25} SELECT query_id, unit_id, score, rank FROM bm25")
def bm25_top10(spark, d):
    return _bm25(spark, d)


def _other(spark, d):
    """A second run: dense hits among even labels only."""
    return _dense(spark, d, rows=lambda e: e.where("label % 2 = 0"))


_EVEN = f"""WITH {_DENSE}, e AS (SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, unit_id) AS rank FROM s WHERE label % 2 = 0 QUALIFY rank <= 10)"""


@query(f"""{_EVEN}, u AS (SELECT query_id, unit_id, rank FROM dense UNION ALL SELECT query_id, unit_id, rank FROM e),
f AS (SELECT query_id, unit_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM u GROUP BY ALL)
SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM f QUALIFY rank <= 10""")
def fusion_rrf(spark, d):
    return retrieval.fuse_rrf([_dense(spark, d), _other(spark, d)])


@query(f"""{_EVEN},
a AS (SELECT query_id, unit_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) WHEN score > 0 THEN 1 ELSE 0 END AS x FROM dense WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, unit_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) WHEN score > 0 THEN 1 ELSE 0 END AS y FROM e WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, unit_id, round(0.7 * coalesce(x, 0) + (1 - 0.7) * coalesce(y, 0), 6) AS score FROM a FULL JOIN b USING (query_id, unit_id))
SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM f QUALIFY rank <= 10""")
def fusion_weighted(spark, d):
    return retrieval.fuse_weighted(_dense(spark, d), _other(spark, d))


@query(f"""{_EVEN}, u AS (SELECT 'all' AS system, query_id, unit_id, score, rank FROM dense UNION ALL SELECT 'even', query_id, unit_id, score, rank FROM e),
f AS (SELECT query_id, unit_id, count(*) AS n_systems, min(rank) AS best_rank, max(score) AS best_score, string_agg(system || ':' || rank, ', ' ORDER BY rank, system) AS found_by FROM u GROUP BY ALL),
j AS (SELECT vec_id AS query_id, vec_id AS unit_id FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, unit_id, coalesce(n_systems, 0) AS n_systems, best_rank, best_score, coalesce(found_by, '') AS found_by, j.unit_id IS NOT NULL AS judged FROM f FULL JOIN j USING (query_id, unit_id)""")
def candidate_pool(spark, d):
    judged = _t(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("unit_id"))
    return retrieval.pool({"all": _dense(spark, d), "even": _other(spark, d)}, judged)


@query("""WITH v AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS published FROM events),
i AS (SELECT user_id, event_type, CASE WHEN user_id % 7 > 0 THEN CASE WHEN user_id % 3 = 0 THEN min(published) ELSE max(published) END END AS index_date FROM v GROUP BY user_id, event_type),
a AS (SELECT user_id, event_type, max(index_date) AS x, max(published) AS latest, count(*) FILTER (published = index_date) AS m FROM v JOIN i USING (user_id, event_type) GROUP BY user_id, event_type)
SELECT user_id, event_type, CASE WHEN x IS NULL THEN 'missing_index_date' WHEN m = 0 THEN 'unresolved' WHEN m > 1 THEN 'ambiguous' WHEN x <> latest THEN 'index_not_max' ELSE 'resolved' END AS status,
  CASE WHEN x IS NOT NULL AND m = 1 AND x = latest THEN x END AS current_date FROM a""")
def current_versions(spark, d):
    v = _t(spark, d, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("published"))
    pick = F.when(F.col("user_id") % 7 > 0, F.when(F.col("user_id") % 3 == 0, F.min("published")).otherwise(F.max("published")))
    index = v.groupBy("user_id", "event_type").agg(pick.alias("index_date"))
    return blocks.resolve_versions(v, index, ["user_id", "event_type"])


@query("""WITH o AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') AS p, lag(strftime(ts, '%Y-%m-%d')) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT user_id, count(*) FILTER (p < b) AS n_out_of_order FROM o GROUP BY user_id""")
def version_chronology(spark, d):
    v = _t(spark, d, "events").select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("published"))
    return blocks.out_of_order(v, ["user_id"], "event_id")


@query("""WITH c AS (SELECT *, sum((role = 'system')::INT) OVER w AS r1, sum((role IN ('system', 'user'))::INT) OVER w AS r2 FROM (SELECT conv_id, turn, role, md5(coalesce(text, '')) AS h FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, h ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, role, h, last_value(CASE WHEN role = 'system' THEN h END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, h ROWS UNBOUNDED PRECEDING) AS system,
  last_value(CASE WHEN role = 'user' THEN h END IGNORE NULLS) OVER (PARTITION BY conv_id, r1 ORDER BY turn, h ROWS UNBOUNDED PRECEDING) AS "user",
  last_value(CASE WHEN role = 'assistant' THEN h END IGNORE NULLS) OVER (PARTITION BY conv_id, r2 ORDER BY turn, h ROWS UNBOUNDED PRECEDING) AS assistant FROM c""")
def heading_hierarchy(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    c = c.withColumn("o", F.struct("turn", "h"))
    return blocks.heading_state(c, "conv_id", "o", "role", "h", ["system", "user", "assistant"]).drop("o")


@query()
def chunked_documents(spark, d):
    return blocks.chunks(_t(spark, d, "documents"), "doc_id", "text")


@query("""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT *, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM w),
j AS (SELECT conv_id, turn, CASE WHEN len(list_distinct(list_concat(w, n))) = 0 THEN 0 ELSE len(list_intersect(w, n)) / len(list_distinct(list_concat(w, n))) END AS j FROM p WHERE n IS NOT NULL)
SELECT conv_id, turn, round(j, 6) AS jaccard, j > 0.8 AS near_duplicate FROM j""")
def neighbour_overlap(spark, d):
    return blocks.neighbour_overlap(_t(spark, d, "conversations"), "conv_id", "turn", "text")


@query("""WITH c AS (SELECT conv_id, turn, md5(coalesce(text, '')) AS h, regexp_split_to_array(coalesce(text, ''), '\\s') AS a FROM conversations),
n AS (SELECT *, lead(a) OVER (PARTITION BY conv_id ORDER BY turn, h) AS b FROM c),
p AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[len(a) - k + 1:] = b[:k])), 0) AS k FROM n WHERE b IS NOT NULL),
w AS (SELECT *, list_distinct(list_filter(a, lambda x: x <> '')) AS v, list_distinct(list_filter(b, lambda x: x <> '')) AS u FROM p)
SELECT conv_id, turn, h, k AS n_shared, coalesce(list_sum(list_transform(b[:k], lambda x: length(x))), 0)::BIGINT AS shared_chars,
  len(v) > 0 AND len(u) > 0 AND len(list_intersect(v, u)) / greatest(len(list_distinct(list_concat(v, u))), 1) > 0.8 AS near_duplicate FROM w""")
def boundary_overlap(spark, d):
    """Words that end a turn and begin the next one, as many as possible; the SQL tries every length."""
    c = _t(spark, d, "conversations").select("conv_id", F.struct("turn", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h")).alias("place"), "text")
    return blocks.boundary_overlaps(c, "conv_id", "place", split=r"\s").select("conv_id", "place.*", "n_shared", F.col("shared_chars").cast("long").alias("shared_chars"), "near_duplicate")


@query("""WITH p AS (SELECT p_partkey, p_size, p_retailprice FROM part)
SELECT p_partkey, p_size, p_retailprice FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))""")
def pareto_front(spark, d):
    return metrics.pareto_front(_t(spark, d, "part"), "p_partkey", "p_size", "p_retailprice")


@query("""WITH s AS (SELECT n_chars::DOUBLE AS score, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)),
t AS (SELECT count(*) FILTER (pos) AS np, count(*) FILTER (NOT pos) AS nn FROM s),
b AS (SELECT score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM s GROUP BY score),
c AS (SELECT *, coalesce(sum(p) OVER w, 0) AS pb, coalesce(sum(n) OVER w, 0) AS nb FROM b WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT c.*, np, nn, round(((np - pb) / np + nb / nn) / 2, 10) AS bal FROM c, t)
SELECT (SELECT round(sum(p * (nb + n / 2)) / any_value(np * nn), 4) FROM e) AS auc, score AS threshold, round(bal, 4) AS balanced_accuracy FROM e ORDER BY bal DESC, score LIMIT 1""")
def abstention_threshold(spark, d):
    s = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    return metrics.auc_threshold(s.select(F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("positive")))


@query("""WITH c AS (SELECT quality AS h, toxic AS j, count(*)::DOUBLE AS c FROM labels GROUP BY ALL), n AS (SELECT sum(c) AS n FROM c),
m AS (SELECT n, sum(c) FILTER (h = j) / n AS po, sum(c) FILTER (h = 0) / n AS h0, sum(c) FILTER (h = 1) / n AS h1, sum(c) FILTER (j = 0) / n AS j0, sum(c) FILTER (j = 1) / n AS j1 FROM c, n GROUP BY n)
SELECT n::BIGINT AS n, round(po, 6) AS agreement, round((po - h0 * j0 - h1 * j1) / (1 - h0 * j0 - h1 * j1), 6) AS kappa, round(1 - (1 - po) / (h0 * j1 + h1 * j0), 6) AS weighted_kappa,
  round((po - ((h0 + j0) / 2 * (1 - (h0 + j0) / 2) + (h1 + j1) / 2 * (1 - (h1 + j1) / 2))) / (1 - ((h0 + j0) / 2 * (1 - (h0 + j0) / 2) + (h1 + j1) / 2 * (1 - (h1 + j1) / 2))), 6) AS ac1 FROM m""")
def judge_agreement(spark, d):
    return metrics.agreement(_t(spark, d, "labels").select(F.col("quality").alias("human"), F.col("toxic").alias("judge")), [0, 1])


@query("""WITH r AS (SELECT source, count(*) AS n, count(*) FILTER (toxic = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY source), p AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM r)
SELECT source, n, k, round(greatest(0, ((p + z * z / (2 * n)) / (1 + z * z / n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS low,
  round(least(1, ((p + z * z / (2 * n)) / (1 + z * z / n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS high FROM p""")
def wilson_rates(spark, d):
    r = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return r.select("source", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""WITH p AS (SELECT event_type, round(1.0 / (1 + row_number() OVER (ORDER BY event_type) * avg(abs(value))), 6) AS p FROM events GROUP BY event_type),
r AS (SELECT *, row_number() OVER (ORDER BY p, event_type) AS i, count(*) OVER () AS m FROM p),
a AS (SELECT event_type, p, least(1, max(p * (m - i + 1)) OVER (ORDER BY p, event_type ROWS UNBOUNDED PRECEDING)) AS adjusted FROM r)
SELECT event_type, p, round(adjusted, 6) AS adjusted, adjusted < 0.05 AS significant FROM a""")
def holm_correction(spark, d):
    e = _t(spark, d, "events").groupBy("event_type").agg(F.avg(F.abs("value")).alias("v"))
    p = e.withColumn("p", F.round(1.0 / (1 + F.row_number().over(Window.orderBy("event_type")) * F.col("v")), 6))
    return metrics.holm(p, "event_type", "p").withColumn("adjusted", F.round("adjusted", 6))


@query("""WITH f AS (SELECT 'order_without_customer' AS check_name, 'ERROR' AS severity, o_custkey::VARCHAR AS ref FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'customer_without_order', 'WARNING', c_custkey::VARCHAR FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'line_without_order', 'ERROR', k::VARCHAR FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'repeated_line', 'ERROR', l_orderkey || '/' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'high_discount', 'WARNING', l_orderkey::VARCHAR FROM lineitem WHERE l_discount > 0.09
UNION ALL SELECT 'large_quantity', 'INFO', l_orderkey::VARCHAR FROM lineitem WHERE l_quantity >= 50)
SELECT severity, check_name, count(*) AS n FROM f GROUP BY GROUPING SETS ((severity), (check_name), ())""")
def findings_summary(spark, d):
    o, c, x = _t(spark, d, "orders"), _t(spark, d, "customer"), _t(spark, d, "lineitem")
    found = quality.missing_references(o, "o_custkey", c, "c_custkey", "order_without_customer")
    found = found.unionByName(quality.missing_references(c, "c_custkey", o, "o_custkey", "customer_without_order", quality.WARNING))
    found = found.unionByName(quality.missing_references(x, "l_orderkey", o, "o_orderkey", "line_without_order"))
    found = found.unionByName(quality.repeated_keys(x, ["l_orderkey", "l_linenumber"], "repeated_line"))
    found = found.unionByName(quality.rule_findings(x, F.col("l_orderkey"), [("high_discount", quality.WARNING, F.col("l_discount") > 0.09), ("large_quantity", quality.INFO, F.col("l_quantity") >= 50)]))
    return quality.summarise(found)


@query("""SELECT count(*) FILTER (s = 'ERROR') AS n_errors, count(*) FILTER (s = 'WARNING') AS n_warnings, count(*) FILTER (s = 'ERROR') = 0 AS ready FROM (
SELECT 'ERROR' AS s FROM embeddings WHERE len(embedding) <> 64 UNION ALL SELECT 'ERROR' FROM embeddings WHERE abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.01
UNION ALL SELECT 'WARNING' FROM embeddings GROUP BY embedding HAVING count(*) > 1)""")
def vector_gate(spark, d):
    return quality.ready(quality.vector_findings(_t(spark, d, "embeddings"), "vec_id", "embedding", 64))


@query("""WITH h AS (SELECT sha256(doc_id || '|' || coalesce(text, '')) AS h FROM documents), b AS (SELECT h[1:2] AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY b)) AS fingerprint FROM b""")
def corpus_fingerprint(spark, d):
    return quality.fingerprint(_t(spark, d, "documents"), "doc_id", "text")


@query("""SELECT lang, count(*) AS n, round(quantile_cont(n_chars, 0.5), 1) AS p50, round(quantile_cont(n_chars, 0.9), 1) AS p90, round(quantile_cont(n_chars, 0.95), 1) AS p95, round(quantile_cont(n_chars, 0.99), 1) AS p99, max(n_chars) AS longest, count(*) FILTER (n_chars > 2000) AS n_over
FROM documents GROUP BY ROLLUP (lang)""")
def length_profile(spark, d):
    p = F.percentile("n_chars", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95), F.lit(0.99)))
    r = _t(spark, d, "documents").rollup("lang").agg(F.count("*").alias("n"), p.alias("p"), F.max("n_chars").alias("longest"), F.count_if(F.col("n_chars") > 2000).alias("n_over"))
    return r.select("lang", "n", *[F.round(F.get("p", F.lit(i)), 1).alias(x) for i, x in enumerate(("p50", "p90", "p95", "p99"))], "longest", "n_over")


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS x FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS x FROM orders WHERE o_orderkey % 5 <> 0)
SELECT CASE WHEN a.k IS NULL THEN 'only_new' WHEN b.k IS NULL THEN 'only_old' WHEN a.x <> b.x THEN 'changed' ELSE 'same' END AS outcome, count(*) AS n FROM a FULL JOIN b USING (k) GROUP BY 1""")
def run_diff(spark, d):
    """Two runs by key: rows of one only, changed and equal."""
    o = _t(spark, d, "orders")
    a = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("a"))
    b = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_totalprice") > 200000, "X").otherwise(F.col("o_orderstatus")).alias("b"))
    kind = F.when(F.col("a").isNull(), "only_new").when(F.col("b").isNull(), "only_old").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return a.join(b, "k", "full_outer").groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, len(regexp_extract_all(html, '(?i)<tr[ >]')) AS n_rows, len(regexp_extract_all(html, '(?i)<p[ >]')) AS n_paragraphs, regexp_matches(html, '(?i)<table[ >]') AS has_table, regexp_matches(html, '(?i)<img[ />]') AS has_image,
trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages""")
def page_blocks(spark, d):
    h = F.col("html")
    title = T.clean_text(F.regexp_extract(h, "(?is)<title[^>]*>(.*?)</title>", 1))
    return _t(spark, d, "pages").select(
        "page_id", F.regexp_count(h, F.lit("(?i)<tr[ >]")).cast("long").alias("n_rows"), F.regexp_count(h, F.lit("(?i)<p[ >]")).cast("long").alias("n_paragraphs"),
        h.rlike("(?i)<table[ >]").alias("has_table"), h.rlike("(?i)<img[ />]").alias("has_image"), title.alias("title"),
    )


@query("""WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS raw, o_orderpriority AS label FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE raw[1:4] || '-' || raw[5:6] || '-' || raw[7:8] END AS iso, regexp_replace(trim(label), '\\s+', ' ', 'g') AS label,
  label || CASE WHEN right(label, 1) IN ('.', ':', ';', '?', '!') THEN ' ' ELSE '. ' END || 'x' AS joined FROM d""")
def scalar_text(spark, d):
    o = _t(spark, d, "orders")
    raw = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.when(F.col("o_orderkey") % 10 == 0, "x").otherwise(""))
    return o.select("o_orderkey", T.normalize_date(raw).alias("iso"), T.clean_text(F.col("o_orderpriority")).alias("label"), T.join_context(F.array("o_orderpriority", F.lit(""), F.lit("x"))).alias("joined"))


@query()
def evidence_selection(spark, d):
    """Greedy selection over BM25 hits with their documents' texts joined late."""
    hits = _bm25(spark, d)
    texts = _t(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text")
    return context.select_evidence(hits.join(texts, "unit_id").select("query_id", F.col("unit_id").alias("parent_id"), "rank", "text"))


@query()
def bounded_context(spark, d):
    """Each conversation's middle turn, expanded both ways within 2000 characters."""
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    c = c.select("conv_id", F.transform("t", lambda x: x["text"]).alias("p"))
    mid = F.floor(F.size("p") / 2).cast("int")
    return c.select("conv_id", context.expand_bounded(F.col("p"), mid, mid, 2000).alias("x")).select("conv_id", "x.lo", "x.hi", "x.size")


@query()
def bootstrap_intervals(spark, d):
    """Seeded percentile intervals of n_chars by source over the labelled documents."""
    v = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select("source", "doc_id", F.col("n_chars").cast("double").alias("v"))
    return stats.grouped_ci(v, "source", "v", "doc_id")


@query()
def bca_intervals(spark, d):
    v = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select("source", "doc_id", F.col("n_chars").cast("double").alias("v"))
    return stats.grouped_ci(v, "source", "v", "doc_id", stats.bca_ci)
