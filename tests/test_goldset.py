"""A small question bank with one fault of each kind."""

import pytest

from codexmill.operators import goldset

Q = "query_id string, query string, split string, issue_family_id string, query_style string, answer_scope string, difficulty string, provenance string, review_status string"
J = "query_id string, parent_id string, relevance int, orders array<int>, quote string, notes string, review_status string"
A = "query_id string, answerable boolean, reference_answer string, cited array<string>, review_status string"


def question(i, split="test", scope="single_parent", family=None, status="reviewed", query="¿Qué?", style="ciudadana"):
    return (i, query, split, family or f"f{i}", style, scope, "media", "auto_draft", status)


QUESTIONS = [
    question("ok"), question("multi", scope="multi_parent"), question("draft", scope="multi_parent", status="draft"), question("blank", query=" "), question("style", style="x"), question("scope", scope="none"), question("out", "out_of_corpus", "none"),
    question("leak1", family="same"), question("leak2", "development", family="same"), question("twice"), question("twice"), question("badsplit", "train"), question(None), question("nofamily", family=" "),
]
JUDGMENTS = [
    ("ok", "p1", 2, [1], "q", None, "final"), ("ok", "p2", 1, None, None, "note", "final"), ("multi", "p1", 1, [], "q", "", "reviewed"), ("gone", "p1", 0, [], None, None, "draft"), ("ok", "p9", 0, [], None, None, "draft"),
    ("draft", "p1", 2, [7], None, None, "draft"), ("leak1", "p1", 2, [], "q", None, "final"), ("leak2", "p1", 1, [], " ", None, "final"), ("out", "p1", 1, [], None, None, "draft"), ("multi", "p1", 1, [], "q", "", "reviewed"), ("ok", "p3", 5, [], None, None, "draft"),
]
KEYS = [
    ("ok", True, "r", ["p1"], "final"), ("gone", True, "r", ["p1"], "final"), ("out", True, "r", [], "draft"), ("blank", False, "r", [], "final"), ("multi", True, " ", None, "final"), ("leak1", True, "r", ["p2", "px"], "reviewed"), ("style", False, "", [], "final"),
    ("style", False, "", [], "final"), ("draft", None, "", [], "draft"),
]


def tables(spark):
    return spark.createDataFrame(QUESTIONS, Q), spark.createDataFrame(JUDGMENTS, J), spark.createDataFrame(KEYS, A)


def named(found):
    return sorted((r.check_name.removeprefix("dataset."), r.ref or "") for r in found.collect())


ALWAYS = [
    ("contract", "badsplit"), ("contract", ""), ("contract", "ok"), ("contract", "draft"), ("empty_query", "blank"), ("empty_family", "nofamily"), ("style", "style"), ("scope_and_split", "scope"), ("too_few_parents", "multi"), ("judgment_without_question", "gone"),
    ("evidence_missing", "leak1"), ("reason_missing", "leak2"), ("relevant_out_of_corpus", "out"), ("key_without_question", "gone"), ("answerable_out_of_corpus", "out"), ("answer_of_unanswerable", "blank"), ("answer_missing", "multi"), ("citations_missing", "multi"),
    ("citations_not_relevant", "leak1"), ("repeated_question", "twice"), ("repeated_judgment", "multi"), ("repeated_key", "style"), ("family_leak", "same"),
]


def test_every_rule_once(spark):
    parents = spark.createDataFrame([("p1", [1, 2]), ("p2", None), ("p3", [])], "parent_id string, orders array<int>")
    assert named(goldset.dataset_findings(*tables(spark), parents)) == sorted([*ALWAYS, ("unknown_parent", "ok"), ("unknown_paragraph", "draft"), ("unknown_citations", "leak1")])


def test_without_a_corpus(spark):
    assert named(goldset.dataset_findings(*tables(spark))) == sorted(ALWAYS)


def test_counts_and_gate(spark):
    q, j, a = tables(spark)
    counts = goldset.dataset_counts(q, j, a)
    assert sorted(map(tuple, counts.collect())) == [("development", 1, 1, 0), ("out_of_corpus", 1, 1, 0), ("test", 10, 3, 5)]
    gate = goldset.dataset_gate(goldset.dataset_findings(q, j, a), counts, a, "checkpoint").first()
    assert not gate.ready and gate.reasons == ["errors", "development: 1 of 40", "out_of_corpus: 1 of 10", "test: 3 of 20"]
    assert gate.generation_reasons == [*gate.reasons, "development: 0 of 40", "out_of_corpus: 0 of 10", "test: 5 of 20"]
    none = [df.limit(0) for df in (q, j, a)]
    assert goldset.dataset_findings(*none).count() == 0
    empty = goldset.dataset_gate(goldset.dataset_findings(*none), goldset.dataset_counts(*none), none[2]).first()
    assert len(empty.reasons) == 3 and "no answer keys" in empty.generation_reasons
    with pytest.raises(ValueError):
        goldset.dataset_gate(goldset.dataset_findings(*none), counts, a, "best")


def test_a_bank_that_is_ready(spark):
    q = spark.createDataFrame([question(f"{s}{i}", s, "none" if s == "out_of_corpus" else "single_parent") for s, n in goldset.LEVELS["checkpoint"].items() for i in range(n)], Q)
    j = spark.createDataFrame([(r.query_id, "p", 1, [], "q", None, "final") for r in q.collect() if r.split != "out_of_corpus"], J)
    a = spark.createDataFrame([(r.query_id, r.split != "out_of_corpus", "r" if r.split != "out_of_corpus" else "", ["p"] if r.split != "out_of_corpus" else [], "final") for r in q.collect()], A)
    gate = goldset.dataset_gate(goldset.dataset_findings(q, j, a), goldset.dataset_counts(q, j, a), a, "checkpoint").first()
    assert gate.ready and gate.generation_ready and gate.reasons == gate.generation_reasons == []
