"""Registered queries: answers and their metrics, strategy comparison, contexts and evidences."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.functions import analysis as A
from codexmill.functions import text as T
from codexmill.operators import context, evaluation, generation
from codexmill.plans.catalogue import _DENSE, _EVEN, _dense, _other, _t
from codexmill.registry import query

_STOP = "', '".join(A.STOP_WORDS)


@query(f"""SELECT doc_id, list_filter(regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '[0-9]+(?:[.,][0-9]+)*|[a-záéíóúüñ]+'), lambda t: t NOT IN ('{_STOP}') AND (t[1] BETWEEN '0' AND '9' OR len(t) >= 2)) AS tokens,
'es' AS language, true AS remove_stopwords, false AS stem, 2 AS min_token_len FROM documents""")
def analyzed_tokens(spark, d):
    """Tokens without stop words, unstemmed, and the analyzer's settings."""
    return _t(spark, d, "documents").select("doc_id", A.analyze(F.col("text"), stemmed=False).alias("tokens"), A.signature(stemmed=False).alias("s")).select("doc_id", "tokens", "s.*")


@query()
def stemmed_tokens(spark, d):
    """The number of stemmed tokens and distinct stems of each document."""
    tokens = _t(spark, d, "documents").select("doc_id", A.analyze(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_stems"))


_ANSWERS = r"""w AS (SELECT doc_id, source, n_chars, text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM documents),
r AS (SELECT doc_id AS query_id, source, CASE WHEN doc_id % 13 = 0 THEN 'failed' END AS error, doc_id % 3 <> 0 AS answered, doc_id % 4 <> 0 AS answerable, doc_id % 2 = 0 AS asked_model, coalesce(text, '') AS answer,
  list_filter([upper(w[1]), w[3], left(w[5], len(w[5]) - 1), 'zzyzx'], lambda x: x IS NOT NULL AND x <> '') AS key_facts, list_filter([w[7], 'qqxq'], lambda x: x IS NOT NULL) AS forbidden_facts,
  [source, lang, source] AS cited, CASE WHEN doc_id % 5 = 0 THEN [] ELSE [source, 'x'] END AS expected FROM w JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)),
m AS (SELECT *, regexp_replace(lower(strip_accents(answer)), '\s+', ' ', 'g') AS norm, answered AND answerable AND error IS NULL AS ok, list_distinct(cited) AS c FROM r),
f AS (SELECT *, CASE WHEN ok THEN list_filter(key_facts, lambda x: regexp_matches(norm, '(^|[^\p{L}\p{N}_])' || lower(x) || '($|[^\p{L}\p{N}_])')) END AS present,
  CASE WHEN ok THEN list_filter(forbidden_facts, lambda x: regexp_matches(norm, '(^|[^\p{L}\p{N}_])' || lower(x) || '($|[^\p{L}\p{N}_])')) END AS hits,
  CASE WHEN ok AND len(expected) > 0 THEN len(list_intersect(c, expected)) END AS tp FROM m),
a AS (SELECT query_id, source, error, answered, answerable,
  CASE WHEN error IS NULL THEN CASE WHEN answered AND answerable THEN 'answered' WHEN answered THEN 'false_answer' WHEN answerable THEN 'over_abstention' ELSE 'correct_abstention' END END AS abstention_outcome,
  CASE WHEN error IS NULL THEN CASE WHEN answered THEN 'answered' WHEN asked_model THEN 'llm_decided' ELSE 'pre_llm' END END AS abstention_point,
  len(present) / len(key_facts)::DOUBLE AS key_fact_recall, len(hits) AS n_forbidden, len(hits) > 0 AS hallucinated_forbidden, tp / len(c)::DOUBLE AS citation_precision, tp / 2::DOUBLE AS citation_recall,
  CASE WHEN tp IS NOT NULL THEN CASE WHEN tp > 0 THEN 2 * (tp / len(c)::DOUBLE) * (tp / 2::DOUBLE) / (tp / len(c)::DOUBLE + tp / 2::DOUBLE) ELSE 0 END END AS citation_f1,
  CASE WHEN ok THEN CASE WHEN query_id % 7 = 0 THEN 0.5 ELSE 1.0 END END::DOUBLE AS faithfulness, CASE WHEN ok THEN CASE query_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END END::DOUBLE AS correctness FROM f)"""


def _answers(spark, d):
    """Documents as answers: facts are words of their own, of changed case, cut short or made up."""
    docs = _t(spark, d, "documents")
    w = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    docs = docs.withColumn("w", w)
    word = lambda i: F.get("w", F.lit(i - 1))
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull() & (x != ""))
    i = F.col("doc_id")
    rows = docs.select(
        i.alias("query_id"), "source", F.when(i % 13 == 0, "failed").alias("error"), (i % 3 != 0).alias("answered"), (i % 4 != 0).alias("answerable"), (i % 2 == 0).alias("asked_model"), F.col("text").alias("answer"),
        some(F.upper(word(1)), word(3), F.expr("left(get(w, 4), length(get(w, 4)) - 1)"), F.lit("zzyzx")).alias("key_facts"), some(word(7), F.lit("qqxq")).alias("forbidden_facts"),
        F.array("source", "lang", "source").alias("cited"), F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("source", F.lit("x"))).alias("expected"),
        F.when(i % 7 == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))).alias("claims"), F.when(i % 3 == 0, "correct").when(i % 3 == 1, "partial").otherwise("incorrect").alias("verdict"),
    )
    return rows, generation.answer_metrics(rows)


@query(f"""WITH {_ANSWERS} SELECT query_id, abstention_outcome, abstention_point, round(key_fact_recall, 6) AS key_fact_recall, n_forbidden, hallucinated_forbidden, round(citation_precision, 6) AS citation_precision,
round(citation_recall, 6) AS citation_recall, round(citation_f1, 6) AS citation_f1, faithfulness, correctness, faithfulness >= 0.8 AS faithful FROM a""")
def answer_scores(spark, d):
    m = _answers(spark, d)[1]
    rounded = [F.round(c, 6).alias(c) for c in ("key_fact_recall", "citation_precision", "citation_recall", "citation_f1")]
    return m.select(
        "query_id", "abstention_outcome", "abstention_point", F.size("forbidden_fact_hits").alias("n_forbidden"), "hallucinated_forbidden", *rounded, "faithfulness", "correctness", T.is_faithful(F.col("faithfulness"), 0.8).alias("faithful")
    ).withColumn("n_forbidden", F.when(F.col("n_forbidden") >= 0, F.col("n_forbidden").cast("long")))


_MEANS = ", ".join(f"round(avg({c}) FILTER (error IS NULL), 6) AS {c}_mean, count({c}) FILTER (error IS NULL) AS {c}_n" for c in generation.NUMERIC)
_OUT = ", ".join(f"count(*) FILTER (abstention_outcome = '{x}') AS n_{x}" for x in ("answered", "false_answer", "over_abstention", "correct_abstention"))
_POINTS = ", ".join(f"count(*) FILTER (abstention_point = '{x}') AS point_{x}" for x in ("answered", "pre_llm", "llm_decided"))


@query(f"""WITH {_ANSWERS}, s AS (SELECT source, count(*) FILTER (error IS NULL) AS n_queries, count(error) AS n_generation_errors, {_MEANS}, {_OUT}, count(*) FILTER (error IS NULL AND answerable) AS answerable_total,
  count(*) FILTER (error IS NULL AND NOT answerable) AS unanswerable_total, count(*) FILTER (error IS NULL AND hallucinated_forbidden) AS hallucinated_forbidden_count, {_POINTS} FROM a GROUP BY source)
SELECT *, round(n_answered / nullif(answerable_total, 0), 6) AS answer_rate, round(n_correct_abstention / nullif(unanswerable_total, 0), 6) AS abstention_rate, round(n_over_abstention / nullif(answerable_total, 0), 6) AS over_abstention_rate,
  round(n_false_answer / nullif(unanswerable_total, 0), 6) AS false_answer_rate, round(list_avg([n_answered / nullif(answerable_total, 0), n_correct_abstention / nullif(unanswerable_total, 0)]), 6) AS balanced_accuracy FROM s""")
def answer_summary(spark, d):
    rows, m = _answers(spark, d)
    out = generation.answer_summary(m.join(rows.select("query_id", "source"), "query_id"), "source")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


_KS = (1, 3, 5, 10)
_HITS = """h AS (SELECT 'all' AS strategy, query_id, unit_id % 40 AS parent_id, rank, unit_id % 5 AS "start", unit_id % 5 + 2 AS "end", unit_id % 6 > 0 AS anchored FROM dense
UNION ALL SELECT 'even', query_id, unit_id % 40, rank, unit_id % 5, unit_id % 5 + 2, unit_id % 6 > 0 FROM e),
rel AS (SELECT q.vec_id AS query_id, p.parent_id, max(1 + p.parent_id % 2) AS relevance FROM (SELECT vec_id, label FROM embeddings WHERE vec_id % 100 = 0) q JOIN (SELECT DISTINCT vec_id % 40 AS parent_id, label FROM embeddings WHERE vec_id % 3 = 0) p USING (label) GROUP BY ALL),
ev AS (SELECT query_id, parent_id, unnest([1, 4]) AS o FROM rel WHERE relevance = 2),
nrel AS (SELECT query_id, count(*) AS n, sum(CASE WHEN place <= 10 THEN (2 ** relevance - 1) / log2(place + 1) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, parent_id) AS place FROM rel) GROUP BY query_id),
fst AS (SELECT strategy, query_id, parent_id, row_number() OVER (PARTITION BY strategy, query_id ORDER BY min(rank), parent_id) AS place FROM h GROUP BY strategy, query_id, parent_id),
ded AS (SELECT strategy, query_id, min(place) AS f, sum(CASE WHEN place <= 10 THEN (2 ** relevance - 1) / log2(place + 1) END) AS dcg, """ + ", ".join(f"count(*) FILTER (place <= {k}) AS f{k}" for k in _KS) + """ FROM fst JOIN rel USING (query_id, parent_id) GROUP BY ALL),
raw AS (SELECT strategy, query_id, """ + ", ".join(f"count(*) FILTER (rank <= {k}) AS r{k}, count(DISTINCT parent_id) FILTER (rank <= {k}) AS p{k}" for k in _KS) + """ FROM h GROUP BY ALL),
cov AS (SELECT strategy, query_id, """ + ", ".join(f"count(*) FILTER (rank <= {k}) AS c{k}" for k in _KS) + """ FROM (SELECT strategy, query_id, parent_id, o, min(rank) AS rank FROM ev JOIN h USING (query_id, parent_id) WHERE anchored AND o BETWEEN "start" AND "end" GROUP BY ALL) GROUP BY ALL),
nev AS (SELECT query_id, count(*) AS n_ev FROM ev GROUP BY query_id),
pq AS (SELECT strategy, query_id, coalesce((f = 1)::INT::DOUBLE, 0) AS hit_at_1, coalesce(CASE WHEN f <= 10 THEN 1 / f END, 0) AS mrr, coalesce(dcg / ideal, 0) AS ndcg, """ + ", ".join(
    f"coalesce(f{k} / n, 0) AS recall_{k}, coalesce(p{k}, 0)::DOUBLE AS unique_parents_{k}, coalesce(1 - p{k} / r{k}, 0) AS duplicate_rate_{k}, coalesce((c{k} > 0)::INT::DOUBLE, 0) AS evidence_hit_{k}, coalesce(c{k} / n_ev, 0) AS evidence_recall_{k}" for k in _KS
) + """ FROM (SELECT DISTINCT query_id FROM rel) CROSS JOIN (SELECT DISTINCT strategy FROM h) LEFT JOIN nrel USING (query_id) LEFT JOIN nev USING (query_id) LEFT JOIN ded USING (strategy, query_id) LEFT JOIN raw USING (strategy, query_id) LEFT JOIN cov USING (strategy, query_id))"""


def _comparison(spark, d):
    """(runs, questions, judgments, evidence): units belong to 40 parents, parents of a query's label are relevant."""
    e = _t(spark, d, "embeddings")
    u = F.col("unit_id")
    anchored = lambda run: run.select("query_id", (u % 40).alias("parent_id"), "rank", F.when(u % 6 > 0, u % 5).alias("start"), F.when(u % 6 > 0, u % 5 + 2).alias("end"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    parents = e.where("vec_id % 3 = 0").select((F.col("vec_id") % 40).alias("parent_id"), "label").distinct()
    judged = q.join(parents, "label").select("query_id", "parent_id", (1 + F.col("parent_id") % 2).alias("relevance"))
    evidence = judged.where("relevance = 2").select("query_id", "parent_id", F.explode(F.array(F.lit(1), F.lit(4))).alias("order"))
    questions = q.select("query_id", F.when(F.col("label") % 3 > 0, F.concat(F.lit("s"), (F.col("label") % 3).cast("string"))).alias("style"), F.lit("one").alias("scope"))
    return {"all": anchored(_dense(spark, d)), "even": anchored(_other(spark, d))}, questions, judged, evidence


def _hits(runs):
    a, b = (r.withColumn("strategy", F.lit(n)) for n, r in runs.items())
    return a.unionByName(b)


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


@query(f"{_EVEN}, {_HITS} SELECT strategy, query_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ["hit_at_1", "mrr", "ndcg", *[f"{m}_{k}" for k in _KS for m in ("recall", "unique_parents", "duplicate_rate", "evidence_hit", "evidence_recall")]]) + " FROM pq")
def strategy_query_metrics(spark, d):
    """All retrieval metrics of two strategies for every k in one pass."""
    runs, _, judged, evidence = _comparison(spark, d)
    return _rounded(evaluation.query_metrics(_hits(runs), judged, evidence, _KS))


@query(f"""{_EVEN}, {_HITS}, v AS (SELECT strategy, query_id, metric, value FROM pq UNPIVOT (value FOR metric IN (hit_at_1, mrr, ndcg, recall_5, evidence_recall_5))),
st AS (SELECT v.*, CASE WHEN label % 3 > 0 THEN 's' || label % 3 ELSE '(sin)' END AS style, 'one' AS scope FROM v JOIN (SELECT vec_id AS query_id, label FROM embeddings) USING (query_id))
SELECT strategy, metric, style, scope, count(*) AS n, round(avg(value), 6) AS mean FROM st GROUP BY GROUPING SETS ((strategy, metric), (strategy, metric, style), (strategy, metric, scope))""")
def strategy_means(spark, d):
    """Means overall and by two strata."""
    runs, questions, judged, evidence = _comparison(spark, d)
    values = evaluation.long_form(evaluation.query_metrics(_hits(runs), judged, evidence, _KS), ["hit_at_1", "mrr", "ndcg", "recall_5", "evidence_recall_5"])
    return _rounded(evaluation.mean_metrics(values.join(questions, "query_id", "left"), "style", "scope"))


@query()
def strategy_comparison(spark, d):
    """Paired comparison of each strategy with a baseline, Holm-corrected, with equivalence."""
    runs, _, judged, evidence = _comparison(spark, d)
    values = evaluation.aligned(evaluation.long_form(evaluation.query_metrics(_hits(runs), judged, evidence, _KS), ["ndcg", "mrr", "recall_10"]))
    return _rounded(evaluation.paired_vs_baseline(values, "all", margin=0.02))


@query()
def strategy_intervals(spark, d):
    runs, _, judged, evidence = _comparison(spark, d)
    values = evaluation.long_form(evaluation.query_metrics(_hits(runs), judged, evidence, _KS), ["ndcg", "mrr", "recall_10"])
    return _rounded(evaluation.intervals(values))


@query(f"""{_EVEN}, a AS (SELECT query_id, unit_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) WHEN score > 0 THEN 1 ELSE 0 END AS x FROM dense WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, unit_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) WHEN score > 0 THEN 1 ELSE 0 END AS y FROM e WINDOW w AS (PARTITION BY query_id)),
g AS (SELECT 'weighted_' || al AS strategy, query_id, unit_id, round(al::DOUBLE * coalesce(x, 0) + (1 - al::DOUBLE) * coalesce(y, 0), 6) AS score FROM a FULL JOIN b USING (query_id, unit_id) CROSS JOIN (SELECT unnest(['0.3', '0.5', '0.7']) AS al)),
f AS (SELECT 'rrf' AS strategy, query_id, unit_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, unit_id, rank FROM dense UNION ALL SELECT query_id, unit_id, rank FROM e) GROUP BY ALL)
SELECT strategy, query_id, unit_id, score, row_number() OVER (PARTITION BY strategy, query_id ORDER BY score DESC, unit_id) AS rank FROM (SELECT * FROM g UNION ALL SELECT * FROM f) QUALIFY rank <= 10
UNION ALL SELECT 'dense', query_id, unit_id, score, rank FROM dense UNION ALL SELECT 'bm25', query_id, unit_id, score, rank FROM e""")
def fusion_ablation(spark, d):
    """Both runs, their reciprocal-rank fusion and a grid of weights."""
    return evaluation.fusion_grid(_dense(spark, d), _other(spark, d), [0.3, 0.5, 0.7])


@query(f"WITH {_DENSE} SELECT query_id, max(score) AS score FROM dense GROUP BY query_id UNION ALL SELECT vec_id + 1, 0.0 FROM embeddings WHERE vec_id % 100 = 0")
def top1_scores(spark, d):
    """Best scores; questions without hits have 0."""
    q = _t(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.explode(F.array("vec_id", F.col("vec_id") + 1)).alias("query_id"))
    return evaluation.top1_scores(_dense(spark, d), q)


_TURNS = """t AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')))::INT AS o, coalesce(text, '') AS x FROM conversations)"""


def _parents(spark, d):
    """Conversations as parents, their turns as paragraphs numbered from 1 on."""
    listed = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(listed.alias("t"))
    return c.select(F.col("conv_id").alias("parent_id"), F.transform("t", lambda x, i: F.struct((i + 1).alias("order"), x["text"].alias("text"))).alias("paragraphs"))


def _conversation_hits(spark, d):
    """Each query asks ten neighbouring conversations; one in ten does not exist, some anchors are beyond the end."""
    n = F.col("parent_id")
    h = _parents(spark, d).select(F.floor(n / 10).alias("query_id"), n, (n % 10 + 1).alias("rank"), ((n % 3) + 1).cast("int").alias("start"), ((n % 3) + 2).cast("int").alias("end"), F.when(n % 4 == 0, "retrieved ").otherwise("").alias("text"))
    return h.withColumn("parent_id", F.when(n % 10 == 7, -n).otherwise(n))


def _context_sql(strategy: str) -> str:
    anchored = "coalesce(string_agg(x, chr(10) ORDER BY o) FILTER (o BETWEEN s AND e), '')"
    base = f"CASE WHEN r <> '' THEN r ELSE {anchored} END"
    picked = {"K_ONLY": (base, "greatest(count(*) FILTER (o BETWEEN s AND e), 1)"), "P_EXPAND_FULL": (f"CASE WHEN string_agg(x, chr(10) ORDER BY o) <> '' THEN string_agg(x, chr(10) ORDER BY o) ELSE {base} END", "count(*)")}
    text, items = picked[strategy]
    return f"SELECT conv_id AS parent_id, '{strategy}' AS strategy, sha256({text}) AS sha256, len({text}) AS char_count, {items} AS item_count, len({base}) AS base_char_count FROM h JOIN t USING (conv_id) GROUP BY conv_id, r"


@query(f"""WITH {_TURNS}, h AS (SELECT DISTINCT conv_id, conv_id % 3 + 1 AS s, conv_id % 3 + 2 AS e, CASE WHEN conv_id % 4 = 0 THEN 'retrieved ' ELSE '' END AS r FROM conversations)
{_context_sql("K_ONLY")} UNION ALL {_context_sql("P_EXPAND_FULL")}""")
def assembled_contexts(spark, d):
    """Contexts of the retrieved text and of whole parents."""
    n = F.col("parent_id")
    hits = _parents(spark, d).withColumn("start", (n % 3 + 1).cast("int")).withColumn("end", (n % 3 + 2).cast("int")).withColumn("text", F.when(n % 4 == 0, "retrieved ").otherwise(""))
    out = None
    for s in (context.K_ONLY, context.FULL):
        c = context.assemble(hits, s).select("parent_id", F.lit(s).alias("strategy"), F.sha2("context.text", 256).alias("sha256"), F.col("context.char_count").cast("long").alias("char_count"), F.col("context.item_count").cast("long").alias("item_count"), F.col("context.base_char_count").cast("long").alias("base_char_count"))
        out = c if out is None else out.unionByName(c)
    return out


_GROWN = f"""WITH RECURSIVE {_TURNS},
p AS (SELECT conv_id, count(*)::INT AS n, list(x ORDER BY o) AS x FROM t GROUP BY conv_id),
h AS (SELECT conv_id, n, x, (conv_id % 3)::INT AS lo0, least(conv_id % 3 + 1, n - 1)::INT AS hi0, CASE WHEN conv_id % 4 = 0 THEN 'retrieved ' ELSE '' END AS r FROM p),
s0 AS (SELECT *, len(array_to_string(x[lo0 + 1:hi0 + 1], chr(10))) AS size0 FROM h WHERE lo0 < n),
g AS (SELECT conv_id, n, x, lo0 AS lo, hi0 AS hi, size0 AS size, 0 AS i FROM s0 WHERE size0 <= 1500
  UNION ALL SELECT conv_id, n, x, CASE WHEN lo > 0 AND size2 + 1 + len(x[lo]) <= 1500 THEN lo - 1 ELSE lo END, hi2, CASE WHEN lo > 0 AND size2 + 1 + len(x[lo]) <= 1500 THEN size2 + 1 + len(x[lo]) ELSE size2 END, i + 1
  FROM (SELECT *, CASE WHEN hi + 1 < n AND size + 1 + len(x[hi + 2]) <= 1500 THEN hi + 1 ELSE hi END AS hi2, CASE WHEN hi + 1 < n AND size + 1 + len(x[hi + 2]) <= 1500 THEN size + 1 + len(x[hi + 2]) ELSE size END AS size2 FROM g) WHERE i < n),
z AS (SELECT conv_id, max_by(lo, i) AS lo, max_by(hi, i) AS hi, max_by(size, i) AS size FROM g GROUP BY conv_id)"""


@query(f"""{_GROWN}
SELECT h.conv_id AS parent_id, h.lo0 >= h.n AS failed, CASE WHEN z.lo IS NOT NULL THEN z.size ELSE CASE WHEN h.lo0 >= h.n THEN NULL WHEN r <> '' THEN 10 ELSE size0 END END AS char_count,
CASE WHEN z.lo IS NOT NULL THEN z.hi - z.lo + 1 WHEN h.lo0 >= h.n THEN 0 ELSE hi0 - h.lo0 + 1 END AS item_count, coalesce(s0.size0 > 1500 AND CASE WHEN r <> '' THEN 10 ELSE size0 END > 1500, false) AS over_budget,
CASE WHEN s0.size0 > 1500 THEN CASE WHEN r <> '' THEN 'anchor_exceeds_budget_retrieved_text_fallback' ELSE 'anchor_exceeds_budget' END END AS fallback FROM h LEFT JOIN z USING (conv_id) LEFT JOIN (SELECT conv_id, size0 FROM s0) s0 USING (conv_id)""")
def bounded_contexts(spark, d):
    """Contexts grown from an anchor within a budget, by turns after and before it, with their fallbacks."""
    n = F.col("parent_id")
    hits = _parents(spark, d).withColumn("start", (n % 3 + 1).cast("int")).withColumn("end", (n % 3 + 2).cast("int")).withColumn("text", F.when(n % 4 == 0, "retrieved ").otherwise(""))
    c = F.col("context")
    made = context.assemble(hits, context.BOUNDED, 1500)
    return made.select("parent_id", c["failed"].alias("failed"), F.when(~c["failed"], c["char_count"].cast("long")).alias("char_count"), c["item_count"].cast("int").alias("item_count"), c["over_budget"].alias("over_budget"), c["fallback"].alias("fallback"))


_PICKED = f"""WITH RECURSIVE {_TURNS}, p AS (SELECT conv_id, string_agg(x, chr(10) ORDER BY o) AS full_text FROM t GROUP BY conv_id),
h AS (SELECT conv_id // 10 AS query_id, (CASE WHEN conv_id % 10 = 7 THEN -conv_id ELSE conv_id END)::VARCHAR AS parent_id, (conv_id % 10 + 1)::INT AS rank, conv_id % 10 <> 7 AS known, full_text, len(full_text) AS c FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM h),
s AS (SELECT query_id, 0 AS i, 0 AS n, 0::BIGINT AS used, NULL::VARCHAR AS parent_id, NULL::INT AS rank, NULL::VARCHAR AS reason, NULL::BIGINT AS c FROM (SELECT DISTINCT query_id FROM k)
UNION ALL SELECT query_id, i, n + (reason IS NULL)::INT, used + CASE WHEN reason IS NULL THEN c ELSE 0 END, parent_id, rank, reason, c FROM (
  SELECT s.query_id, k.i, s.n, s.used, k.parent_id, k.rank, k.c, CASE WHEN NOT known THEN 'parent_not_found' WHEN trim(full_text) = '' THEN 'empty_context' WHEN s.used + k.c > 12000 THEN 'exceeds_total_context_budget' END AS reason
  FROM s JOIN k ON k.query_id = s.query_id AND k.i = s.i + 1 WHERE s.n < 5))"""


@query(f"""{_PICKED} SELECT query_id, parent_id, rank, CASE WHEN reason IS NULL THEN 'E' || n END AS evidence_id, reason, CASE WHEN reason IS DISTINCT FROM 'parent_not_found' THEN c END AS char_count FROM s WHERE i > 0""")
def evidences(spark, d):
    """Evidences of whole parents: lost parents and ones over the total are passed over, the next is tried."""
    made = context.build_evidences(_conversation_hits(spark, d).withColumn("text", F.lit("")), _parents(spark, d), context.FULL)
    return made.select("query_id", "parent_id", "rank", "evidence_id", "reason", F.col("char_count").cast("long").alias("char_count"))


@query(f"""{_PICKED} SELECT h.query_id, h.parent_id, h.rank, x.rank IS NOT NULL AS selected FROM h LEFT JOIN (SELECT query_id, parent_id, rank FROM s WHERE i > 0 AND reason IS NULL) x USING (query_id, parent_id, rank)""")
def hit_traces(spark, d):
    """Which hits became evidences."""
    hits = _conversation_hits(spark, d).withColumn("text", F.lit(""))
    traced = context.hit_trace(hits, context.build_evidences(hits, _parents(spark, d), context.FULL))
    return traced.select("query_id", F.col("parent_id").cast("string").alias("parent_id"), F.col("rank").cast("int").alias("rank"), "selected")


@query(f"""WITH {_TURNS}, p AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
a AS (SELECT p.conv_id, conv_id // 10 AS query_id, conv_id % 10 + 1 AS place, n, o, x, len(x) AS l FROM p JOIN t USING (conv_id)),
b AS (SELECT query_id, conv_id, place, list(o ORDER BY o) AS orders, sum(l) + count(*) - 1 AS chars, count(*) AS items, coalesce(sum(l) FILTER (o BETWEEN conv_id % 3 + 1 AND conv_id % 3 + 2) + count(*) FILTER (o BETWEEN conv_id % 3 + 1 AND conv_id % 3 + 2) - 1, 0) AS base FROM a GROUP BY ALL),
c AS (SELECT k, b.* FROM b CROSS JOIN (SELECT unnest([1, 3]) AS k) WHERE place <= k),
ev AS (SELECT DISTINCT query_id, conv_id, unnest([2, 3]) AS o FROM b WHERE conv_id % 2 = 0),
u AS (SELECT k, query_id, conv_id, unnest(orders) AS o FROM c),
m AS (SELECT k, query_id, count(*) AS covered FROM u JOIN ev USING (query_id, conv_id, o) GROUP BY ALL),
r AS (SELECT k, query_id, sum(chars) AS chars, sum(items) AS items, sum(base) AS base, count(*) AS parents, count(*) FILTER (conv_id % 2 = 0) AS good, sum(len(orders)) AS paragraphs FROM c GROUP BY ALL),
ne AS (SELECT query_id, count(*) AS ne, count(DISTINCT conv_id) AS nr FROM ev GROUP BY query_id)
SELECT r.k, r.query_id, round(coalesce(covered / ne, 0), 6) AS evidence_recall, round(good / parents, 6) AS "precision", round(coalesce(good / nr, 0), 6) AS recall, chars::DOUBLE AS characters, items::DOUBLE AS items, round(CASE WHEN base > 0 THEN chars / base ELSE 0 END, 6) AS expansion_ratio,
  0.0::DOUBLE AS redundancy, round(coalesce(covered, 0) / paragraphs, 6) AS evidence_density FROM r LEFT JOIN m USING (k, query_id) LEFT JOIN ne USING (query_id)""")
def context_ablation(spark, d):
    """Metrics of whole-parent contexts of the first 1 and 3 parents."""
    n = F.col("parent_id")
    hits = _parents(spark, d).select(F.floor(n / 10).alias("query_id"), n, (n % 10 + 1).alias("rank"), ((n % 3) + 1).cast("int").alias("start"), ((n % 3) + 2).cast("int").alias("end"), F.lit("").alias("text"))
    made = context.context_ablation(hits, _parents(spark, d), context.context_configs((context.FULL,), ks=(1, 3)))
    gold = hits.where(n % 2 == 0).select("query_id", "parent_id")
    wanted = gold.withColumn("order", F.explode(F.array(F.lit(2), F.lit(3))))
    out = None
    for k in (1, 3):
        one = _rounded(evaluation.context_metrics(made.where(F.col("k") == k), gold, wanted)).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH p AS (SELECT quality AS human, toxic AS judge FROM labels), g AS (SELECT a.x AS human, b.x AS judge FROM (SELECT unnest([0, 1, 2]) AS x) a, (SELECT unnest([0, 1, 2]) AS x) b)
SELECT g.human, g.judge, count(p.human) AS n FROM g LEFT JOIN p ON p.human = g.human AND p.judge = g.judge GROUP BY ALL""")
def confusion_matrix(spark, d):
    """All cells, those without pairs too."""
    return evaluation.confusion(_t(spark, d, "labels").select(F.col("quality").alias("human"), F.col("toxic").alias("judge")), [0, 1, 2])


@query()
def agreement_intervals(spark, d):
    """Seeded intervals of kappa, weighted kappa and AC1 over the labels."""
    pairs = _t(spark, d, "labels").select(F.col("doc_id").alias("query_id"), F.col("quality").cast("string").alias("human"), F.col("toxic").cast("string").alias("judge"))
    return _rounded(evaluation.agreement_intervals(pairs, ["0", "1"], resamples=200))


@query("SELECT doc_id AS query_id, quality AS human, toxic AS judge FROM labels WHERE quality <> toxic")
def judge_disagreements(spark, d):
    x = _t(spark, d, "labels")
    return evaluation.disagreements(x.select(F.col("doc_id").alias("query_id"), F.col("quality").alias("v")), x.select(F.col("doc_id").alias("query_id"), F.col("toxic").alias("v")), "v")
