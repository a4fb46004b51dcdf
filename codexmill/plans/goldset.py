"""Registered queries: a question bank made of documents (questions), their labels (judgments) and conversations (answer keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.operators import goldset
from codexmill.plans.catalogue import _t
from codexmill.registry import query

_Q = """q0 AS (SELECT doc_id::VARCHAR AS query_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, lang, source FROM documents),
q AS (SELECT query_id, CASE WHEN n % 9 > 0 THEN t ELSE '' END AS query, CASE WHEN n % 4 = 0 THEN 'test' WHEN n % 5 = 0 THEN 'out_of_corpus' WHEN n % 23 = 0 THEN 'x' ELSE 'development' END AS split, lang || (n % 200) AS issue_family_id,
  CASE WHEN n % 3 = 0 THEN 'ciudadana' ELSE 'otra' END AS query_style, CASE WHEN n % 5 = 0 THEN 'none' WHEN n % 2 = 0 THEN 'multi_parent' ELSE 'single_parent' END AS answer_scope, CASE WHEN n % 7 > 2 THEN 'reviewed' ELSE 'draft' END AS review_status FROM q0),
j AS (SELECT doc_id::VARCHAR AS query_id, (doc_id // 2)::VARCHAR AS parent_id, coalesce(quality, 0) + coalesce(toxic, 0) AS relevance, CASE WHEN toxic = 1 THEN [1, 2] ELSE [] END AS orders, CASE WHEN quality = 1 AND doc_id % 3 > 0 THEN 'q' END AS quote, 'final' AS review_status FROM labels
  UNION ALL SELECT doc_id::VARCHAR, doc_id::VARCHAR, quality + toxic, [9], NULL, 'draft' FROM labels WHERE quality = 1),
a AS (SELECT conv_id::VARCHAR AS query_id, length(coalesce(text, '')) % 3 > 0 AS answerable, CASE WHEN length(coalesce(text, '')) % 4 > 0 THEN text ELSE ' ' END AS reference_answer, CASE WHEN turn % 2 = 0 THEN [(conv_id // 2)::VARCHAR, 'gone'] ELSE [] END AS cited, 'final' AS review_status FROM conversations WHERE turn < 2),
p AS (SELECT doc_id::VARCHAR AS parent_id, CASE WHEN coalesce(length(text), 0) % 2 = 0 THEN [1, 2, 9] ELSE [1] END AS orders FROM documents),
gq AS (SELECT * FROM q WHERE split <> 'x' AND issue_family_id IS NOT NULL), gj AS (SELECT * FROM j WHERE relevance IN (0, 1, 2)),
sp AS (SELECT query_id, max(split) AS split FROM gq GROUP BY query_id), rel AS (SELECT query_id, list_distinct(list(parent_id)) AS relevant FROM gj WHERE relevance >= 1 GROUP BY query_id),
qr AS (SELECT gq.*, coalesce(len(relevant), 0) AS n_relevant FROM gq LEFT JOIN rel USING (query_id)),
jr AS (SELECT gj.*, sp.split, p.parent_id IS NOT NULL AS known, list_filter(gj.orders, lambda o: NOT list_contains(p.orders, o)) AS bad FROM gj LEFT JOIN sp USING (query_id) LEFT JOIN p USING (parent_id)),
ar AS (SELECT a.*, sp.split, coalesce(relevant, []) AS relevant, list_filter(cited, lambda c: NOT list_contains(every, c)) AS lost FROM (SELECT * FROM a, (SELECT list(parent_id) AS every FROM p)) AS a LEFT JOIN sp USING (query_id) LEFT JOIN rel USING (query_id))"""


def _tables(spark, d):
    docs, labels, conv = (_t(spark, d, n) for n in ("documents", "labels", "conversations"))
    q = docs.select(F.col("doc_id").cast("string").alias("query_id"), F.coalesce("text", F.lit("")).alias("t"), F.length(F.coalesce("text", F.lit(""))).alias("n"), "lang").selectExpr(
        "query_id", "CASE WHEN n % 9 > 0 THEN t ELSE '' END AS query", "CASE WHEN n % 4 = 0 THEN 'test' WHEN n % 5 = 0 THEN 'out_of_corpus' WHEN n % 23 = 0 THEN 'x' ELSE 'development' END AS split", "concat(lang, n % 200) AS issue_family_id",
        "CASE WHEN n % 3 = 0 THEN 'ciudadana' ELSE 'otra' END AS query_style", "CASE WHEN n % 5 = 0 THEN 'none' WHEN n % 2 = 0 THEN 'multi_parent' ELSE 'single_parent' END AS answer_scope", "'media' AS difficulty", "'auto_draft' AS provenance",
        "CASE WHEN n % 7 > 2 THEN 'reviewed' ELSE 'draft' END AS review_status",
    )
    j = labels.selectExpr("CAST(doc_id AS STRING) AS query_id", "CAST(doc_id div 2 AS STRING) AS parent_id", "coalesce(quality, 0) + coalesce(toxic, 0) AS relevance", "CASE WHEN toxic = 1 THEN array(1, 2) ELSE array() END AS orders", "CASE WHEN quality = 1 AND doc_id % 3 > 0 THEN 'q' END AS quote", "CAST(NULL AS STRING) AS notes", "'final' AS review_status")
    j = j.unionAll(labels.where("quality = 1").selectExpr("CAST(doc_id AS STRING)", "CAST(doc_id AS STRING)", "quality + toxic", "array(9)", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "'draft'"))
    a = conv.where("turn < 2").withColumn("n", F.length(F.coalesce("text", F.lit("")))).selectExpr("CAST(conv_id AS STRING) AS query_id", "n % 3 > 0 AS answerable", "CASE WHEN n % 4 > 0 THEN text ELSE ' ' END AS reference_answer", "CASE WHEN turn % 2 = 0 THEN array(CAST(conv_id div 2 AS STRING), 'gone') ELSE array() END AS cited", "'final' AS review_status")
    p = docs.selectExpr("CAST(doc_id AS STRING) AS parent_id", "CASE WHEN coalesce(length(text), 0) % 2 = 0 THEN array(1, 2, 9) ELSE array(1) END AS orders")
    return q, j, a, p


def _f(check: str, table: str, when: str, message: str, severity: str = "ERROR", ref: str = "query_id") -> str:
    return f"SELECT 'dataset.{check}' AS check_name, '{severity}' AS severity, {ref} AS ref, {message} AS message FROM {table} WHERE {when}"


_FINDINGS = " UNION ALL ".join([
    _f("contract", "q", "NOT (split <> 'x' AND issue_family_id IS NOT NULL)", "'question breaks its contract'"), _f("contract", "j", "relevance IS NULL OR relevance NOT IN (0, 1, 2)", "'judgment breaks its contract'"),
    _f("empty_query", "qr", "trim(query) = ''", "'the query is blank'"), _f("scope_and_split", "qr", "(answer_scope = 'none') <> (split = 'out_of_corpus')", "'scope none and split out_of_corpus go together'"),
    _f("style", "qr", "query_style = 'otra'", "'unknown style: otra'", "WARN"), _f("too_few_parents", "qr", "answer_scope = 'multi_parent' AND review_status = 'reviewed' AND n_relevant < 2", "'relevant parents: ' || n_relevant"),
    _f("judgment_without_question", "jr", "split IS NULL", "'no such question'"), _f("unknown_parent", "jr", "NOT known", "'no such parent: ' || parent_id"), _f("unknown_paragraph", "jr", "known AND len(bad) > 0", "'no such paragraphs of ' || parent_id || ': ' || array_to_string(bad, ',')"),
    _f("evidence_missing", "jr", "review_status = 'final' AND relevance = 2 AND len(orders) = 0", "'no evidence for ' || parent_id"), _f("reason_missing", "jr", "review_status = 'final' AND relevance >= 1 AND quote IS NULL", "'no quote or note for ' || parent_id"),
    _f("relevant_out_of_corpus", "jr", "split = 'out_of_corpus' AND relevance >= 1", "'relevant though out of corpus: ' || parent_id"),
    _f("key_without_question", "ar", "split IS NULL", "'no such question'"), _f("answerable_out_of_corpus", "ar", "split = 'out_of_corpus' AND answerable", "'answerable though out of corpus'"),
    _f("answer_of_unanswerable", "ar", "split IS NOT NULL AND NOT answerable AND (trim(coalesce(reference_answer, '')) <> '' OR len(cited) > 0)", "'an answer or citations, though not answerable'"),
    _f("unknown_citations", "ar", "split IS NOT NULL AND len(lost) > 0", "'no such parents: ' || array_to_string(lost, ',')"), _f("answer_missing", "ar", "split IS NOT NULL AND answerable AND trim(coalesce(reference_answer, '')) = ''", "'no reference answer'"),
    _f("citations_missing", "ar", "split IS NOT NULL AND answerable AND len(cited) = 0", "'no expected citations'"),
    _f("citations_not_relevant", "ar", "split IS NOT NULL AND answerable AND len(relevant) > 0 AND len(list_filter(cited, lambda c: NOT list_contains(relevant, c))) > 0", "'cited, not judged relevant: ' || array_to_string(list_sort(list_filter(cited, lambda c: NOT list_contains(relevant, c))), ',')", "WARN"),
    _f("repeated_question", "(SELECT query_id, count(*) AS n FROM gq GROUP BY query_id)", "n > 1", "'copies: ' || n"), _f("repeated_judgment", "(SELECT query_id, parent_id, count(*) AS n FROM gj GROUP BY ALL)", "n > 1", "parent_id || ', copies: ' || n"),
    _f("repeated_key", "(SELECT query_id, count(*) AS n FROM a GROUP BY query_id)", "n > 1", "'copies: ' || n"),
    _f("family_leak", "(SELECT issue_family_id, bool_or(split = 'development') AND bool_or(split = 'test') AS leak FROM gq GROUP BY issue_family_id)", "leak", "'in development and test'", ref="issue_family_id"),
])


@query(f"WITH {_Q} {_FINDINGS}")
def dataset_audit(spark, d):
    """All rule groups over questions, judgments and answer keys made of three tables."""
    return goldset.dataset_findings(*_tables(spark, d)).select("check_name", "severity", "ref", "message")


@query(f"""WITH {_Q}, jd AS (SELECT DISTINCT query_id FROM gj WHERE review_status = 'final' AND relevance >= 1), kd AS (SELECT DISTINCT query_id FROM a),
c AS (SELECT split, count(*) AS n, count(*) FILTER (review_status = 'reviewed' AND (query_id IN (FROM jd) OR split = 'out_of_corpus')) AS ready, count(*) FILTER (review_status = 'reviewed' AND query_id IN (FROM kd)) AS generation_ready FROM gq GROUP BY split)
SELECT s.split, coalesce(n, 0) AS n, coalesce(ready, 0) AS ready, coalesce(generation_ready, 0) AS generation_ready FROM (VALUES ('development'), ('test'), ('out_of_corpus')) AS s(split) LEFT JOIN c USING (split)""")
def dataset_readiness(spark, d):
    q, j, a, _ = _tables(spark, d)
    return goldset.dataset_counts(q, j, a)
