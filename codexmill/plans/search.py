"""Registered queries: filters, resolved hits, hybrid search with candidate pools, representative rows, scale-safe statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.operators import postings, retrieval
from codexmill.plans.catalogue import _BM25, _DENSE, _TOKENS, _dense, _t
from codexmill.registry import query

_ATTR = """attr AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 'c' || vec_id END AS chunk_id, 'p' || vec_id % 30 AS parent_id,
  CASE WHEN vec_id % 5 > 0 THEN 'r' || label % 3 ELSE 'r' || vec_id % 30 % 2 END AS rank_code, CASE WHEN vec_id % 5 > 0 THEN vec_id % 2 = 0 ELSE vec_id % 30 % 3 = 0 END AS annex,
  CASE WHEN vec_id % 5 > 0 THEN ['s' || vec_id % 4, 's9'] ELSE ['s' || vec_id % 30 % 4] END AS subject_codes FROM embeddings)"""


def _attributes(spark, d):
    e, v = _t(spark, d, "embeddings"), F.col("vec_id")
    text, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    named = lambda df, rank, annex, codes, *key: df.select(*key, rank.alias("rank_code"), text.alias("scope_code"), text.alias("semantic_role"), no.alias("without_content"), annex.alias("annex"), no.alias("table"), no.alias("image"), codes.alias("subject_codes"))
    s = lambda x: F.concat(F.lit("s"), x.cast("string"))
    rows = e.select(v.alias("unit_id"), F.col("embedding").alias("vector"), F.when(v % 5 > 0, F.concat(F.lit("c"), v.cast("string"))).alias("chunk_id"), F.concat(F.lit("p"), (v % 30).cast("string")).alias("parent_id"))
    chunks = named(e.where("vec_id % 5 > 0"), F.concat(F.lit("r"), (F.col("label") % 3).cast("string")), v % 2 == 0, F.array(s(v % 4), F.lit("s9")), F.concat(F.lit("c"), v.cast("string")).alias("chunk_id"))
    k = F.col("id")
    parents = named(spark.range(30), F.concat(F.lit("r"), (k % 2).cast("string")), k % 3 == 0, F.array(s(k % 4)), F.concat(F.lit("p"), k.cast("string")).alias("parent_id"))
    return retrieval.filter_attributes(rows, chunks, parents)


@query(f"WITH {_ATTR} SELECT vec_id AS unit_id, rank_code, annex, subject_codes, rank_code = 'r1' AND annex AND len(list_intersect(subject_codes, ['s0', 's9'])) > 0 AS passes FROM attr")
def row_filters(spark, d):
    """Attributes of each row by its chunk or parent, and whether it passes a filter."""
    wanted = retrieval.active_filters(rank_code="r1", annex=True, table=False, subject_codes=["s0", "s9"], scope_code=None)
    return _attributes(spark, d).select("unit_id", "rank_code", "annex", "subject_codes", retrieval.matches(wanted).alias("passes"))


@query(f"""WITH {_ATTR}, {_DENSE.replace("WHERE q.vec_id % 100 = 0", "WHERE q.vec_id % 100 = 0 AND r.vec_id IN (SELECT vec_id FROM attr WHERE rank_code = 'r1' AND annex AND list_has_any(subject_codes, ['s0', 's9']))")}
SELECT query_id, unit_id, rank, round(score, 4) AS brief_score, CASE WHEN unit_id % 5 = 0 THEN CASE WHEN unit_id % 30 % 7 = 0 THEN 'p' || unit_id % 30 ELSE 'P' || unit_id % 30 END ELSE 'C' || unit_id END AS citation_label,
CASE WHEN unit_id % 11 = 0 THEN 'own' WHEN unit_id % 5 = 0 THEN 'parent ' || unit_id % 30 WHEN unit_id % 3 = 0 THEN 'body ' || unit_id ELSE 'indexed ' || unit_id END AS retrieval_text FROM dense""")
def resolved_dense_hits(spark, d):
    """Filtered dense search with the hits' texts and citations."""
    rows, u = _attributes(spark, d), F.col("unit_id")
    num = lambda c: F.regexp_replace(c, "[a-z]", "")
    kinds = rows.select("unit_id", F.when(u % 11 == 0, "derived").when(u % 5 == 0, "parent").otherwise("chunk").alias("kind"), F.lit("retrieval_text").alias("field"), "chunk_id", "parent_id", F.lit("own").alias("derived_text"))
    c, p = rows.where("chunk_id is not null"), rows.select("parent_id").distinct()
    chunks = c.select("chunk_id", F.concat(F.lit("body "), num(F.col("chunk_id"))).alias("text"), F.when(u % 3 > 0, F.concat(F.lit("indexed "), num(F.col("chunk_id")))).alias("retrieval_text"), F.upper("chunk_id").alias("label"), F.lit("u").alias("url"))
    n = num(F.col("parent_id"))
    parents = p.select("parent_id", F.concat(F.lit("parent "), n).alias("text"), F.when(n.cast("int") % 7 == 0, "").otherwise(F.upper("parent_id")).alias("label"), F.lit(None).cast("string").alias("url"))
    texts = retrieval.row_texts(kinds, chunks, parents)
    asked = _t(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.lit("q").alias("query"), F.col("embedding").alias("vector"))
    hits = retrieval.dense_retrieve(rows, texts, asked, lambda q: q.select("query_id", "vector"), filters=retrieval.active_filters(rank_code="r1", annex=True, subject_codes=["s0", "s9"]))
    return hits.select("query_id", "unit_id", "rank", "brief_score", "citation_label", "retrieval_text")


_DEEP = _DENSE.replace("rank <= 10", "rank <= 100")
_SIDE = "e AS (SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, unit_id) AS rank FROM s WHERE label % 2 = 0 QUALIFY rank <= 100)"
_SCALED = "CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) WHEN score > 0 THEN 1 ELSE 0 END"


@query(f"""WITH {_DEEP}, {_SIDE}, f AS (SELECT query_id, unit_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, unit_id, rank FROM dense UNION ALL SELECT query_id, unit_id, rank FROM e) GROUP BY ALL)
SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM f QUALIFY rank <= 10""")
def hybrid_rrf(spark, d):
    """Hybrid search that fuses the first 100 hits of both sides."""
    return retrieval.hybrid(lambda k: _dense(spark, d, k), lambda k: _dense(spark, d, k, lambda e: e.where("label % 2 = 0")), 10)


@query(f"""WITH {_DEEP}, {_SIDE}, a AS (SELECT query_id, unit_id, {_SCALED} AS x FROM dense WINDOW w AS (PARTITION BY query_id)), b AS (SELECT query_id, unit_id, {_SCALED} AS y FROM e WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, unit_id, round(0.7 * coalesce(x, 0) + (1 - 0.7) * coalesce(y, 0), 6) AS score FROM a FULL JOIN b USING (query_id, unit_id)),
r AS (SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM f QUALIFY rank <= 10)
SELECT r.*, CASE WHEN dense.unit_id IS NOT NULL THEN 'dense' ELSE 'other' END AS origin FROM r LEFT JOIN dense USING (query_id, unit_id)""".replace("SELECT r.*,", "SELECT r.query_id, r.unit_id, r.score, r.rank,"))
def hybrid_weighted(spark, d):
    """The weighted form, with what is known of each hit taken from the dense side first."""
    dense, other = (lambda k: _dense(spark, d, k).withColumn("origin", F.lit("dense"))), (lambda k: _dense(spark, d, k, lambda e: e.where("label % 2 = 0")).withColumn("origin", F.lit("other")))
    fused = retrieval.hybrid(dense, other, 10, "weighted")
    return retrieval.representatives(fused, dense(100), other(100))


@query(f"""WITH {_BM25.replace("QUALIFY rank <= 10", "")}, f AS (SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS place FROM bm25 WHERE unit_id % 2 = 0 QUALIFY place <= 10) SELECT query_id, unit_id, score, place AS rank FROM f""")
def bm25_filtered(spark, d):
    """BM25 with whole-corpus statistics over the rows that pass a filter."""
    docs = _t(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("unit_id"), "text", (F.col("doc_id") % 2 == 0).alias("annex"))
    index = postings.build_scratch(rows, tokens=T.tokens(F.col("text")), spread=spark.sparkContext.defaultParallelism)
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    texts = docs.select(F.col("doc_id").alias("unit_id"), "source")
    return retrieval.lexical_retrieve(index, texts, asked, T.tokens, filters={"annex": True}, attributes=rows).select("query_id", "unit_id", "score", "rank")


#: One-factor settings of the ablation (fixed values); the stemmer and the stop words are left to the tests.
_ABLATION = retrieval.one_factor({"boost": 0, "k1": 1.5, "b": 0.75}, {"boost": [1, 2, 3], "k1": [0.9, 1.2, 2.0], "b": [0.3, 0.5, 0.9]})
_SETTINGS = ", ".join(f"('{name}', {s['boost']}, {s['k1']}::DOUBLE, {s['b']}::DOUBLE)" for name, s in _ABLATION)


@query(f"""WITH c(setting, boost, k1, b) AS (VALUES {_SETTINGS}),
d AS (SELECT doc_id AS unit_id, {_TOKENS} AS w, {_TOKENS.replace("text", "source")} AS h FROM documents),
x AS (SELECT boost, unit_id, len(w) + boost * len(h) AS dl, w, h FROM d, (SELECT DISTINCT boost FROM c)),
tf AS (SELECT boost, token, unit_id, dl, sum(n) AS tf FROM (SELECT boost, unit_id, dl, unnest(w) AS token, 1 AS n FROM x UNION ALL SELECT boost, unit_id, dl, unnest(h), boost FROM x WHERE boost > 0) GROUP BY ALL),
z AS (SELECT boost, count(*) AS n, avg(dl) AS avgdl FROM x GROUP BY boost),
i0 AS (SELECT boost, token, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT boost, token, count(*) AS df FROM tf GROUP BY ALL) JOIN z USING (boost)),
i AS (SELECT boost, token, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY boost) ELSE idf END AS idf FROM i0),
q AS (SELECT query_id, token, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY ALL),
s AS (SELECT setting, query_id, unit_id, round(sum(times * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))), 6) AS score FROM q JOIN i USING (token) JOIN tf USING (boost, token) JOIN z USING (boost) JOIN c USING (boost) GROUP BY ALL)
SELECT setting, query_id, unit_id, score, row_number() OVER (PARTITION BY setting, query_id ORDER BY score DESC, unit_id) AS rank FROM s QUALIFY rank <= 10""")
def bm25_ablation(spark, d):
    """Ten settings over one analysis and one index; sources stand for headings."""
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text", F.col("source").alias("heading"))
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.lexical_ablation(rows, asked, _ABLATION, T.tokens, spread=spark.sparkContext.defaultParallelism)


@query("""WITH s AS (SELECT doc_id AS unit_id, len(coalesce(text, '')) AS size, lang AS role, doc_id % 9 = 4 AS is_table FROM documents), o AS (SELECT *, row_number() OVER (ORDER BY size, unit_id) - 1 AS place, count(*) OVER () AS n FROM s),
w AS (SELECT unit_id, size, CASE WHEN place = 0 THEN 0 WHEN place = n // 2 THEN 1 WHEN place = n - 1 THEN 2 ELSE 5 END AS why FROM o UNION ALL SELECT unit_id, size, 3 FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY size, unit_id) AS i FROM s) WHERE i = 1
UNION ALL SELECT unit_id, size, 4 FROM (SELECT *, row_number() OVER (ORDER BY size, unit_id) AS i FROM s WHERE is_table) WHERE i = 1)
SELECT unit_id, size, min(why) AS why FROM w GROUP BY unit_id, size ORDER BY why, size, unit_id LIMIT 12""")
def representative_documents(spark, d):
    i = F.col("doc_id")
    return retrieval.representative_rows(_t(spark, d, "documents").select(i.alias("unit_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("role"), (i % 9 == 4).alias("is_table")), 12)
