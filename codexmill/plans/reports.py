"""Registered queries: length profiles, anchors of chunks, annotation sheets, pool records, answers by a stand-in model."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from codexmill.operators import answering, blocks, context, generation, preparation
from codexmill.plans.catalogue import _t
from codexmill.plans.evaluation import _PICKED, _TURNS, _conversation_hits, _parents
from codexmill.registry import query
from codexmill.sources import reports

_P = ", ".join(f"round(quantile_cont(n_tokens, {q})::DECIMAL(18, 6), 1)::DOUBLE AS {n}" for q, n in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")))


@query(rf"""WITH w AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents)
SELECT lang, source, count(*) AS n, count(*) FILTER (n_tokens > 256) AS n_truncated, round(100.0 * count(*) FILTER (n_tokens > 256) / count(*), 2) AS pct_truncated, max(n_tokens) AS longest, {_P} FROM w GROUP BY GROUPING SETS ((), (lang), (source))""")
def token_length_summary(spark, d):
    """Token counts by an injected tokenizer: overall and by two cuts."""
    docs = preparation.counted(_t(spark, d, "documents").select("lang", "source", "text"), "text", lambda t: t.encode().split())
    return preparation.length_summary(docs, 256, "lang", "source")


@query()
def chunk_anchors(spark, d):
    """The lines of its document that each chunk holds, repeated lines told apart by order."""
    docs = _t(spark, d, "documents").where("text is not null")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda p: F.trim(p)), lambda p: p != "")
    parents = docs.select(F.col("doc_id").alias("parent_id"), lines.alias("paragraphs"))
    chunks = blocks.chunks(docs, "doc_id", "text").select(F.col("doc_id").alias("parent_id"), F.col("position").alias("place"), "text")
    return preparation.chunk_anchors(chunks, parents)


@query()
def prepared_inputs(spark, d):
    """Embedding rows of whole documents with the lines that each window touches."""
    docs = _t(spark, d, "documents").where("text is not null")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda p: F.trim(p)), lambda p: p != "")
    texts = docs.select(F.col("doc_id").alias("key"), lines.alias("paragraphs"), F.lit(1).alias("first")).withColumn("text", F.array_join("paragraphs", "\n"))
    made = preparation.prepare_inputs(texts, str.split, " ".join, 130, 16, 2)
    return made.drop("text")


@query("""SELECT doc_id AS query_id, sha256('## ' || doc_id || chr(10) || chr(10) || '**Pregunta:** ' || source || chr(10) || chr(10) || '**Respuesta:**' || chr(10) || chr(10) || lang || chr(10) || chr(10) || '**Referencia' || CASE WHEN doc_id % 3 = 0 THEN ' — VACÍA: no anotes corrección' ELSE '' END || ':**' || chr(10) || chr(10)
|| CASE WHEN doc_id % 3 = 0 THEN '(sin referencia)' ELSE lang END || chr(10) || chr(10) || '**Evidencia:**' || chr(10) || chr(10) || '(sin evidencia)' || chr(10) || chr(10) || 'FIDELIDAD: ' || CASE doc_id % 3 WHEN 1 THEN 'true' WHEN 2 THEN 'false' ELSE '' END || chr(10) || 'CORRECCION: ' || CASE WHEN doc_id % 2 = 0 THEN 'correct' ELSE '' END || chr(10) || 'NOTAS: n' || doc_id || chr(10)) AS block_sha256,
CASE doc_id % 3 WHEN 1 THEN true WHEN 2 THEN false END AS faithful, CASE WHEN doc_id % 2 = 0 THEN 'correct' ELSE '' END AS correctness, 'n' || doc_id AS notes FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def annotation_sheets(spark, d):
    """Annotation blocks in Markdown, and what reading them back gives."""
    i = F.col("doc_id")
    rows = _t(spark, d, "documents").where("source is not null and lang is not null").select(
        i.alias("query_id"), F.col("source").alias("question"), F.col("lang").alias("answer"), F.when(i % 3 > 0, F.col("lang")).alias("reference"), F.lit(None).cast("string").alias("evidence"),
        F.when(i % 3 == 1, True).when(i % 3 == 2, False).alias("faithful"), F.when(i % 2 == 0, "correct").alias("correctness"), F.concat(F.lit("n"), i.cast("string")).alias("notes"),
    )
    made = reports.annotation_block(rows)
    back = reports.parse_annotations(made.select(F.concat(F.lit("# head\n\n"), "block").alias("text")))
    return made.select("query_id", F.sha2("block", 256).alias("block_sha256")).join(back.select(F.col("query_id").cast("long").alias("query_id"), "faithful", "correctness", "notes"), "query_id")


@query("""WITH p AS (SELECT doc_id // 10 AS query_id, doc_id AS parent_id, doc_id % 10 + 1 AS place, doc_id % 4 > 0 AS found FROM documents)
SELECT query_id, 'q' || query_id AS query, array_to_string(list(parent_id ORDER BY place) FILTER (found), ',') AS candidates, array_to_string(list(parent_id ORDER BY parent_id) FILTER (NOT found), ',') AS judged FROM p GROUP BY query_id""")
def pool_records(spark, d):
    """One record a question: candidates in order, judged parents that no system found."""
    i = F.col("doc_id")
    pool = _t(spark, d, "documents").select(F.floor(i / 10).alias("query_id"), i.alias("parent_id"), (i % 10 + 1).alias("place"), F.when(i % 4 > 0, "s:1").otherwise("").alias("found_by"), F.lit(1).alias("relevance"))
    questions = pool.select("query_id").distinct().withColumn("query", F.concat(F.lit("q"), F.col("query_id").cast("string")))
    made = reports.pool_records(pool, questions)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return made.select("query_id", "query", joined(F.transform("candidates", lambda x: x["parent_id"])).alias("candidates"), joined(F.col("judged_not_pooled")).alias("judged"))


@query(rf"""WITH {_TURNS}, p AS (SELECT conv_id AS parent_id, count(*) AS n_lines, string_agg('  [' || o || '] ' || CASE WHEN len(f) > 80 THEN left(f, 80) || '…' ELSE f END, chr(10) ORDER BY o) AS s FROM (SELECT *, trim(regexp_replace(x, '\s+', ' ', 'g')) AS f FROM t) GROUP BY conv_id)
SELECT parent_id, n_lines, sha256(s) AS lines_sha256 FROM p""")
def numbered_paragraphs(spark, d):
    """Paragraphs as a worksheet shows them, cut at 80 characters."""
    lines = reports.paragraph_lines(F.col("paragraphs"), F.lit(""), 80)
    return _parents(spark, d).select("parent_id", F.size("paragraphs").cast("long").alias("n_lines"), F.sha2(F.array_join(lines, "\n"), 256).alias("lines_sha256"))


def _first_id(prompts: list[str]) -> list[str]:
    """A stand-in for a model: answers with the first evidence it is shown."""
    return [json.dumps({"answered": "[E1]" in p, "answer": "x", "citations": ["E1"], "reason": "none shown"}) for p in prompts]


@query(f"""{_PICKED}, q AS (SELECT DISTINCT query_id FROM h UNION ALL SELECT -1), one AS (SELECT query_id, parent_id FROM s WHERE i > 0 AND reason IS NULL AND n = 1)
SELECT q.query_id, one.parent_id IS NOT NULL AS answered, one.parent_id AS cited, one.parent_id IS NOT NULL AS asked_model, CASE WHEN one.parent_id IS NULL THEN CASE WHEN q.query_id = -1 THEN 'no_hits' ELSE 'no_evidence' END END AS reason FROM q LEFT JOIN one USING (query_id)""")
def answered_questions(spark, d):
    """Questions answered over selected evidences by a stand-in model, with checked citations and abstentions."""
    hits = _conversation_hits(spark, d).withColumn("text", F.lit(""))
    ids = hits.select("query_id").distinct().unionAll(spark.range(1).select(F.lit(-1).cast("long")))
    questions = ids.withColumn("query", F.lit("what?"))
    config = answering.GenerationConfig(item_chars=4000, strategy=context.FULL)
    made, _ = answering.answer(questions, hits, _parents(spark, d), _first_id, "answer from the evidence", "{question}\n{evidences}\n{allowed_ids}", config)
    return made.select("query_id", "answered", F.get("citations", F.lit(0))["parent_id"].alias("cited"), "asked_model", "reason")


@query("""WITH a AS (SELECT doc_id AS query_id, doc_id % 2 = 0 AS an, doc_id % 3 = 0 AS no_text, doc_id % 5 = 0 AS no_cit, doc_id % 7 = 0 AS why FROM documents)
SELECT query_id, 'answer_without_text' AS breach FROM a WHERE an AND no_text UNION ALL SELECT query_id, 'answer_without_citations' FROM a WHERE an AND no_cit UNION ALL SELECT query_id, 'answer_with_reason' FROM a WHERE an AND why
UNION ALL SELECT query_id, 'abstention_with_text' FROM a WHERE NOT an AND NOT no_text UNION ALL SELECT query_id, 'abstention_with_citations' FROM a WHERE NOT an AND NOT no_cit UNION ALL SELECT query_id, 'abstention_without_reason' FROM a WHERE NOT an AND NOT why""")
def answer_contracts(spark, d):
    """Answers that break their contract."""
    i = F.col("doc_id")
    empty = F.array().cast("array<string>")
    a = _t(spark, d, "documents").select(i.alias("query_id"), (i % 2 == 0).alias("answered"), F.when(i % 3 > 0, "t").alias("text"), F.when(i % 5 == 0, empty).otherwise(F.array(F.lit("E1"))).alias("citations"), F.when(i % 7 == 0, "r").alias("reason"))
    return generation.contract_breaches(a)
