"""Checks of a question bank, its judgments and answer keys, and whether it may serve a benchmark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.operators.audit import ERROR, WARN, Rule, findings

#: Vocabularies of the three tables, and reviewed items that each level asks of each split (fixed values).
SPLITS, SCOPES, DIFFICULTIES = ("development", "test", "out_of_corpus"), ("single_parent", "multi_parent", "none"), ("facil", "media", "dificil")
STYLES = ("directa_articulo", "ciudadana", "conceptual", "procedimental", "lexica", "comparativa", "sin_respuesta")
STATUSES, REVIEWED, PROVENANCES = ("example", "draft", "reviewed", "final"), ("reviewed", "final"), ("auto_draft", "human_authored")
LEVELS = {"checkpoint": {"development": 40, "test": 20, "out_of_corpus": 10}, "formal": {"development": 40, "test": 80, "out_of_corpus": 20}}

_KIND = "dataset"


def _in(column: str, allowed: tuple) -> str:
    return f"coalesce({column} IN (" + ", ".join(f"'{a}'" if isinstance(a, str) else str(a) for a in allowed) + "), false)"


def _rule(check: str, when: str, message: str, severity: str = ERROR, each: str | None = None) -> Rule:
    return Rule(f"{_KIND}.{check}", severity, _KIND, when, message, "query_id", each=each)


_REVIEWED, _BLANK = _in("review_status", REVIEWED), "trim(coalesce({}, '')) = ''".format
QUESTION_VALID = f"query_id IS NOT NULL AND query IS NOT NULL AND issue_family_id IS NOT NULL AND query_style IS NOT NULL AND {_in('split', SPLITS)} AND {_in('answer_scope', SCOPES)} AND {_in('difficulty', DIFFICULTIES)} AND {_in('provenance', PROVENANCES)} AND {_in('review_status', STATUSES)}"
JUDGMENT_VALID = f"query_id IS NOT NULL AND parent_id IS NOT NULL AND {_in('relevance', (0, 1, 2))} AND {_in('review_status', STATUSES)}"
KEY_VALID = f"query_id IS NOT NULL AND answerable IS NOT NULL AND {_in('review_status', STATUSES)}"

QUESTION_RULES = [
    _rule("empty_query", _BLANK("query"), "'the query is blank'"),
    _rule("empty_family", _BLANK("issue_family_id"), "'the family is blank'"),
    _rule("scope_and_split", "(answer_scope = 'none') <> (split = 'out_of_corpus')", "'scope none and split out_of_corpus go together'"),
    _rule("style", f"NOT {_in('query_style', STYLES)}", "concat('unknown style: ', query_style)", WARN),
    _rule("too_few_parents", f"answer_scope = 'multi_parent' AND {_REVIEWED} AND n_relevant < 2", "concat('relevant parents: ', CAST(n_relevant AS STRING))"),
]
JUDGMENT_RULES = [
    _rule("judgment_without_question", "split IS NULL", "'no such question'"),
    _rule("unknown_parent", "checked AND NOT known", "concat('no such parent: ', parent_id)"),
    _rule("unknown_paragraph", "checked AND known AND size(array_except(orders, parent_orders)) > 0", "concat('no such paragraphs of ', parent_id, ': ', array_join(array_except(orders, parent_orders), ','))"),
    _rule("evidence_missing", f"{_REVIEWED} AND relevance = 2 AND size(orders) = 0", "concat('no evidence for ', parent_id)"),
    _rule("reason_missing", f"{_REVIEWED} AND relevance >= 1 AND {_BLANK('quote')} AND {_BLANK('notes')}", "concat('no quote or note for ', parent_id)"),
    _rule("relevant_out_of_corpus", "split = 'out_of_corpus' AND relevance >= 1", "concat('relevant though out of corpus: ', parent_id)"),
]
KEY_RULES = [
    _rule("key_without_question", "split IS NULL", "'no such question'"),
    _rule("answerable_out_of_corpus", "split = 'out_of_corpus' AND answerable", "'answerable though out of corpus'"),
    _rule("answer_of_unanswerable", f"split IS NOT NULL AND NOT answerable AND (NOT {_BLANK('reference_answer')} OR size(cited) > 0)", "'an answer or citations, though not answerable'"),
    _rule("unknown_citations", "split IS NOT NULL AND checked AND size(array_except(cited, known_cited)) > 0", "concat('no such parents: ', array_join(array_except(cited, known_cited), ','))"),
    _rule("answer_missing", f"split IS NOT NULL AND {_REVIEWED} AND answerable AND {_BLANK('reference_answer')}", "'no reference answer'"),
    _rule("citations_missing", f"split IS NOT NULL AND {_REVIEWED} AND answerable AND size(cited) = 0", "'no expected citations'"),
    _rule("citations_not_relevant", f"split IS NOT NULL AND {_REVIEWED} AND answerable AND size(relevant) > 0 AND size(array_except(cited, relevant)) > 0", "concat('cited, not judged relevant: ', array_join(array_sort(array_except(cited, relevant)), ','))", WARN),
]


def _named(rows: DataFrame, check: str, ref: str, message: str) -> DataFrame:
    return findings(rows, [Rule(f"{_KIND}.{check}", ERROR, _KIND, "true", message, ref)])


def dataset_findings(questions: DataFrame, judgments: DataFrame, keys: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Findings (see `audit.findings`; document_id is null, ref the query_id) of questions(query_id, query, split, issue_family_id,
    query_style, answer_scope, difficulty, provenance, review_status), judgments(query_id, parent_id, relevance, orders array<int>,
    quote, notes, review_status), keys(query_id, answerable, reference_answer, cited array<string>, review_status) and, if
    given, parents(parent_id, orders array<int>) of the corpus.

    Rows that break their contract (a null key, a value outside its vocabulary) are found as such and count nowhere else.
    Structure is asked of every row, completeness of reviewed ones only. Where a question id is repeated, every copy is
    checked, and a judgment or key of it is held against the one of the last split by name. Every lookup is an equi-join on
    query_id or parent_id; what is gathered are the parents of one question and the paragraphs of one parent."""
    blank = lambda c: F.coalesce(c, F.array())
    questions, judgments, keys = (df.withColumn("document_id", F.lit(None).cast("string")) for df in (questions, judgments, keys))
    judgments = judgments.withColumn("orders", blank("orders").cast("array<int>"))
    keys = keys.withColumn("cited", blank("cited").cast("array<string>"))
    broken, good = [], []
    for df, valid, name in ((questions, QUESTION_VALID, "question"), (judgments, JUDGMENT_VALID, "judgment"), (keys, KEY_VALID, "answer_key")):
        broken.append(_named(df.where(f"NOT coalesce({valid}, false)"), "contract", "query_id", f"'{name} breaks its contract'"))
        good.append(df.where(valid))
    q, j, a = good
    splits = q.groupBy("query_id").agg(F.max("split").alias("split"))
    relevant = j.where("relevance >= 1").groupBy("query_id").agg(F.collect_set("parent_id").alias("relevant"))
    q_rows = q.join(relevant, "query_id", "left").withColumn("n_relevant", F.coalesce(F.size("relevant"), F.lit(0)))
    j_rows = j.join(splits, "query_id", "left").withColumn("checked", F.lit(parents is not None))
    a_rows = a.join(splits, "query_id", "left").join(relevant, "query_id", "left").withColumn("checked", F.lit(parents is not None)).withColumn("relevant", blank("relevant").cast("array<string>"))
    if parents is None:
        j_rows = j_rows.withColumns({"known": F.lit(True), "parent_orders": F.array().cast("array<int>")})
        a_rows = a_rows.withColumn("known_cited", F.col("cited"))
    else:
        own = parents.select("parent_id", F.lit(True).alias("known"), blank("orders").cast("array<int>").alias("parent_orders"))
        j_rows = j_rows.join(own, "parent_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
        cited = a.select(F.explode("cited").alias("parent_id"), "query_id").distinct().join(own, "parent_id", "left_semi")
        a_rows = a_rows.join(cited.groupBy("query_id").agg(F.collect_set("parent_id").alias("known_cited")), "query_id", "left").withColumn("known_cited", blank("known_cited").cast("array<string>"))
    many = lambda df, *on: df.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1").withColumn("document_id", F.lit(None).cast("string"))
    leaks = q.groupBy("issue_family_id").agg(F.bool_or(F.col("split") == "development").alias("d"), F.bool_or(F.col("split") == "test").alias("t")).where("d AND t").withColumn("document_id", F.lit(None).cast("string"))
    parts = [
        *broken, findings(q_rows, QUESTION_RULES), findings(j_rows, JUDGMENT_RULES), findings(a_rows, KEY_RULES),
        _named(many(q, "query_id"), "repeated_question", "query_id", "concat('copies: ', CAST(n AS STRING))"), _named(many(j, "query_id", "parent_id"), "repeated_judgment", "query_id", "concat(parent_id, ', copies: ', CAST(n AS STRING))"),
        _named(many(a, "query_id"), "repeated_key", "query_id", "concat('copies: ', CAST(n AS STRING))"), _named(leaks, "family_leak", "issue_family_id", "'in development and test'"),
    ]
    return reduce(DataFrame.unionAll, parts)


def dataset_counts(questions: DataFrame, judgments: DataFrame, keys: DataFrame) -> DataFrame:
    """(split, n, ready, generation_ready) of every split, those without questions too: questions that keep their contract; reviewed
    ones that have a reviewed relevant judgment (out of corpus: reviewed ones); reviewed ones that have a reviewed key."""
    q, done = questions.where(QUESTION_VALID), F.col("review_status").isin(*REVIEWED)
    judged = judgments.where(JUDGMENT_VALID).where(done & (F.col("relevance") >= 1)).select("query_id").distinct().withColumn("judged", F.lit(True))
    keyed = keys.where(KEY_VALID).where(done).select("query_id").distinct().withColumn("keyed", F.lit(True))
    both = q.join(judged, "query_id", "left").join(keyed, "query_id", "left")
    ready = done & (F.col("judged").isNotNull() | (F.col("split") == "out_of_corpus"))
    per = both.groupBy("split").agg(F.count("*").alias("n"), F.count_if(ready).alias("ready"), F.count_if(done & F.col("keyed").isNotNull()).alias("generation_ready"))
    every = questions.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return every.join(per, "split", "left").na.fill(0, ["n", "ready", "generation_ready"])


def dataset_gate(found: DataFrame, counts: DataFrame, keys: DataFrame, level: str = "formal") -> DataFrame:
    """One row (level, ready, reasons, generation_ready, generation_reasons) of the findings and counts of a dataset: no errors, and
    in every split at least as many reviewed questions, and answer keys, as the level asks."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level}; known are {sorted(LEVELS)}")
    need = F.element_at(F.create_map(*[F.lit(x) for pair in LEVELS[level].items() for x in pair]), F.col("split"))
    short = lambda c: F.when(F.col(c) < need, F.concat("split", F.lit(": "), F.col(c).cast("string"), F.lit(" of "), need.cast("string")))
    listed = lambda c: F.array_sort(F.collect_list(short(c)))
    lacks = counts.agg(listed("ready").alias("few"), listed("generation_ready").alias("few_keys"))
    wrong = found.agg(F.count_if(F.col("severity") == ERROR).alias("errors"))
    held = keys.where(KEY_VALID).agg(F.count("*").alias("keys"))
    one = lacks.crossJoin(wrong).crossJoin(held)  # one row each
    first = F.when(F.col("errors") > 0, F.array(F.lit("errors"))).otherwise(F.array().cast("array<string>"))
    no_keys = F.when(F.col("keys") == 0, F.array(F.lit("no answer keys"))).otherwise(F.array().cast("array<string>"))
    out = one.select(F.lit(level).alias("level"), F.concat(first, "few").alias("reasons"), F.concat(first, F.col("few"), no_keys, F.col("few_keys")).alias("generation_reasons"))
    return out.select("level", (F.size("reasons") == 0).alias("ready"), "reasons", (F.size("generation_reasons") == 0).alias("generation_ready"), "generation_reasons")
