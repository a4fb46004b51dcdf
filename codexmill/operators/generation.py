"""Prompts, answers by an injected model, and the metrics of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.functions.analysis import normalize_text
from codexmill.functions.text import abstention_outcome, abstention_point, contains_term, correctness_score, faithfulness_score


def allowed_ids(n: Column) -> Column:
    """'E1, E2, ...' up to n; '' for none."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("E"), i.cast("string"))), ", ")).otherwise("")


def messages(system: str, user: Column) -> Column:
    """array<struct<role, content>> of a system and a user message."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def ask(prompts: DataFrame, model: Callable[[list[str]], list[str]], key: str = "query_id", prompt: str = "prompt") -> DataFrame:
    """(key, answer, error): the model's answer to each prompt, asked a batch at a time where the data lie. A null prompt is
    not asked; a batch that fails is asked one by one, so one bad prompt costs only its own answer."""
    schema = prompts.select(key).schema.add("answer", "string").add("error", "string")

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return model([text])[0], None
        except Exception as e:  # the model is foreign code: its failure is a row's result
            return None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = [t for t in frame[prompt] if t is not None]
            try:
                got = iter([(a, None) for a in model(asked)] if asked else [])
            except Exception:
                got = iter([one(t) for t in asked])
            rows = [next(got) if t is not None else (None, None) for t in frame[prompt]]
            yield pd.DataFrame({key: frame[key], "answer": [a for a, _ in rows], "error": [e for _, e in rows]})

    return prompts.select(key, prompt).mapInPandas(run, schema)


def set_scores(cited: Column, gold: Column) -> dict[str, Column]:
    """precision, recall and f1 of two arrays as sets; all null without gold, precision 0 when nothing is cited."""
    both, n, m = F.size(F.array_intersect(cited, gold)), F.size(F.array_distinct(cited)), F.size(F.array_distinct(gold))
    ok = m > 0
    p = F.when(ok, F.when(n > 0, both / F.greatest(n, F.lit(1))).otherwise(0.0))
    r = F.when(ok, both / F.greatest(m, F.lit(1)))
    return {"precision": p, "recall": r, "f1": F.when(ok, F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0))}


def facts_in(norm: Column, facts: Column) -> Column:
    """Those of the facts that a text in normal form contains, between word ends."""
    # a fact's normal form is made once, not in every use
    return F.filter(facts, lambda f: F.exists(F.transform(F.array(f), normalize_text), lambda n: contains_term(norm, n)))


def facts_present(answer: Column, facts: Column) -> Column:
    """Those of the facts that the answer contains, both in normal form, between word ends."""
    # inside a lambda of its own, so that the answer's normal form is made once and not for each fact
    return F.flatten(F.transform(F.array(normalize_text(answer)), lambda norm: facts_in(norm, facts)))


def fact_recall(answer: Column, facts: Column) -> Column:
    """Share of the facts that the answer contains; null without facts."""
    return F.when(F.size(facts) > 0, F.size(facts_present(answer, facts)) / F.greatest(F.size(facts), F.lit(1)))


#: Means that a summary gives, with the number of rows that have the value.
NUMERIC = ("key_fact_recall", "citation_precision", "citation_recall", "citation_f1", "faithfulness", "correctness")


def answer_metrics(rows: DataFrame) -> DataFrame:
    """Metrics of each answer of rows(query_id, error, answered, answerable, asked_model, answer, key_facts, forbidden_facts,
    cited, expected, claims array<boolean>, verdict; all but query_id may be null): outcome and point always, the others
    only for questions that can be answered and were. Rows with an error keep nulls."""
    scored = F.col("answered") & F.col("answerable") & F.col("error").isNull()
    on = lambda c: F.when(scored, c)
    lists = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("key_facts", "forbidden_facts", "cited", "expected")}
    # normal forms are made once, not in every use
    norm = rows.withColumn("__norm", on(normalize_text(F.col("answer"))))
    facts = norm.select("*", *[on(facts_in(F.col("__norm"), lists[c])).alias(f"__{c}") for c in ("key_facts", "forbidden_facts")])
    scores = set_scores(lists["cited"], lists["expected"])
    ok = F.col("error").isNull()
    return facts.select(
        "query_id", "error", "answered", "answerable", F.when(ok, abstention_outcome(F.col("answered"), F.col("answerable"))).alias("abstention_outcome"),
        F.when(ok, abstention_point(F.col("answered"), F.col("asked_model"))).alias("abstention_point"),
        on(F.when(F.size(lists["key_facts"]) > 0, F.size("__key_facts") / F.greatest(F.size(lists["key_facts"]), F.lit(1)))).alias("key_fact_recall"),
        F.col("__key_facts").alias("key_facts_present"), on(F.filter(lists["key_facts"], lambda f: ~F.array_contains(F.col("__key_facts"), f))).alias("key_facts_missing"),
        F.col("__forbidden_facts").alias("forbidden_fact_hits"), (F.size("__forbidden_facts") > 0).alias("hallucinated_forbidden"),
        *[on(scores[k]).alias(f"citation_{k}") for k in ("precision", "recall", "f1")],
        on(faithfulness_score(F.col("claims"))).alias("faithfulness"), on(correctness_score(F.col("verdict"))).alias("correctness"),
    )


def answer_summary(metrics: DataFrame, *groups: str) -> DataFrame:
    """One row for each group of answer_metrics: numbers, means over the rows that have a value, outcomes, rates, points.
    Rows with an error are counted and left out of all else."""
    ok = F.col("error").isNull()
    own = lambda c: F.when(ok, F.col(c))
    is_ = lambda c, x: F.count_if(ok & (F.col(c) == x))
    out = metrics.groupBy(*groups).agg(
        F.count_if(ok).alias("n_queries"), F.count_if(~ok).alias("n_generation_errors"),
        *[F.avg(own(c)).alias(f"{c}_mean") for c in NUMERIC], *[F.count(own(c)).alias(f"{c}_n") for c in NUMERIC],
        *[is_("abstention_outcome", x).alias(f"n_{x}") for x in ("answered", "false_answer", "over_abstention", "correct_abstention")],
        F.count_if(ok & F.col("answerable")).alias("answerable_total"), F.count_if(ok & ~F.col("answerable")).alias("unanswerable_total"),
        F.count_if(ok & F.col("hallucinated_forbidden")).alias("hallucinated_forbidden_count"),
        *[is_("abstention_point", x).alias(f"point_{x}") for x in ("answered", "pre_llm", "llm_decided")],
    )
    share = lambda a, n: F.col(a) / F.nullif(F.col(n).cast("double"), F.lit(0.0))
    out = out.withColumns({
        "answer_rate": share("n_answered", "answerable_total"), "abstention_rate": share("n_correct_abstention", "unanswerable_total"),
        "over_abstention_rate": share("n_over_abstention", "answerable_total"), "false_answer_rate": share("n_false_answer", "unanswerable_total"),
    })
    seen = F.filter(F.array("answer_rate", "abstention_rate"), lambda x: x.isNotNull())
    return out.withColumn("balanced_accuracy", F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(seen).cast("double"), F.lit(0.0)))


def grounding_findings(facts: DataFrame) -> DataFrame:
    """(query_id, fact) of facts(query_id, fact, text) that the cited text does not contain; plain containment of normal forms, without word ends."""
    return facts.where(~F.contains(normalize_text(F.col("text")), normalize_text(F.col("fact")))).select("query_id", "fact")


def contract_breaches(answers: DataFrame) -> DataFrame:
    """(query_id, breach) of answers(query_id, answered, text, citations array, reason): an answer has text and citations and no
    reason to abstain; an abstention has a reason, no text and no citations."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    none = F.coalesce(F.size("citations"), F.lit(0)) <= 0
    told = F.trim(F.coalesce("reason", F.lit(""))) != ""
    a = F.col("answered")
    rules = [("answer_without_text", a & blank), ("answer_without_citations", a & none), ("answer_with_reason", a & told), ("abstention_with_text", ~a & ~blank), ("abstention_with_citations", ~a & ~none), ("abstention_without_reason", ~a & ~told)]
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules]), lambda x: x.isNotNull())
    return answers.select("query_id", F.explode(found).alias("breach"))


def closed_book(system: str, question: Column) -> Column:
    """Messages of a question without evidence."""
    return messages(system, question)


def evidences_block(evidences: Column) -> Column:
    """The text of array<struct<evidence_id, label, text>> shown to a model, in order, parted by blank lines."""
    return F.array_join(F.transform(evidences, lambda e: F.concat(F.lit("["), e["evidence_id"], F.lit("] "), F.coalesce(e["label"], F.lit("")), F.lit("\n"), e["text"])), "\n\n")


def enriched_citations(cited: Column, evidences: Column) -> Column:
    """array<struct<evidence_id, parent_id, label, url>> of the cited ids that are among the evidences, first mention first, each once."""
    known = F.filter(F.array_distinct(cited), lambda c: F.exists(evidences, lambda e: e["evidence_id"] == c))
    one = lambda c: F.get(F.filter(evidences, lambda e: e["evidence_id"] == c), F.lit(0))
    return F.transform(known, lambda c: F.struct(c.alias("evidence_id"), one(c)["parent_id"].alias("parent_id"), one(c)["label"].alias("label"), one(c)["url"].alias("url")))


def rejudged(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """answers(query_id, ..) with their verdict replaced by verdicts(query_id, verdict); an answer without one raises, the rest of the row stays."""
    both = answers.drop("verdict").join(verdicts.select("query_id", "verdict", F.lit(True).alias("__known")), "query_id", "left")
    known = F.coalesce("__known", F.raise_error(F.concat(F.lit("no verdict for "), F.col("query_id").cast("string"))).cast("boolean"))
    return both.where(known).drop("__known")


def outcome_summary(rows: DataFrame, *groups: str) -> DataFrame:
    """Counts and accuracies by group of rows(answered, answerable, error): rows with an error are counted and left out
    of the rest; balanced accuracy is the mean over the classes that occur."""
    ok = F.col("error").isNull()
    outcome = F.when(ok, abstention_outcome(F.col("answered"), F.col("answerable")))
    names = ("answered", "false_answer", "over_abstention", "correct_abstention")
    counted = rows.withColumn("__o", outcome).groupBy(*groups).agg(
        F.count("*").alias("n"), F.count_if(~ok).alias("n_errors"), *[F.count_if(F.col("__o") == x).alias(x) for x in names]
    )
    share = lambda a, b: F.col(a) / F.nullif((F.col(a) + F.col(b)).cast("double"), F.lit(0.0))
    out = counted.withColumn("answer_accuracy", share("answered", "over_abstention")).withColumn("abstention_accuracy", share("correct_abstention", "false_answer"))
    seen = F.filter(F.array("answer_accuracy", "abstention_accuracy"), lambda x: x.isNotNull())
    mean = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(seen).cast("double"), F.lit(0.0))
    return out.select(*groups, "n", "n_errors", *names, *[F.round(x, 6).alias(a) for a, x in (("answer_accuracy", F.col("answer_accuracy")), ("abstention_accuracy", F.col("abstention_accuracy")), ("balanced_accuracy", mean))])
