"""Rows that share an id or have none, clashing names, and stored tables that go after use."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexmill.llm import common, decontam, graph, rules, simhash, substrings

CLASH = "doc_id long, text string, spans string, spans_ int, given_id int, __spans int, n_chars int"


def passages(n):
    rng = np.random.default_rng(n)
    return [" ".join(f"p{x}" for x in rng.integers(0, 10**9, 70)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3, 0) for i, t in rows], CLASH)


def test_repeats_in_rows_that_share_an_id(spark):
    p, q, r, s = passages(4)
    rows = [(1, f"{p} {q}"), (5, f"{r} one"), (5, f"two {p} {r}"), (5, None), (None, f"{q} null"), (None, f"{s} {q}"), (7, f"{s} last"), (8, "short"), (8, " "), (9, p)]
    d = frame(spark, rows)
    left = {}
    for row in substrings.remove_repeats(d).collect():
        assert (row.spans, row.spans_, row.given_id, row["__spans"]) == ("s", 1, 2, 3) and row.n_chars == len(row.text or "") * (row.text is not None) or row.text is None
        left.setdefault(row.doc_id, []).append(row.text)
    assert left[1] == [f"{p} {q}"] and 9 not in left and sorted(left[8]) == [" ", "short"]
    fives = [t for t in left[5] if t is not None]
    assert len(left[5]) == 3 and sum(r in t for t in fives) == 1 and not any(p in t for t in fives)
    assert left[7] == [f"{s} last"] and sorted(" ".join(t.split()) for t in left[None]) == ["null"]
    found = substrings.substring_duplicates(d).collect()
    assert len(found) == len(rows)
    by = {(x.doc_id, x.n_words): x for x in found}
    assert by[(9, 70)].n_repeated == 70 and by[(9, 70)].sources == [1] and by[(1, 140)].n_repeated == 0
    assert by[(None, 71)].n_repeated == 70 and by[(None, 140)].n_repeated == 140 and by[(None, 140)].sources == [1, 7]
    assert sum(x.n_repeated for x in found if x.doc_id == 5) == 140  # p is repeated, r in one of the two rows


def test_repeats_of_unique_ids_need_no_numbers(spark):
    p, q = passages(2)
    rows = [(3, f"{p} x"), (4, f"y {p}"), (5, q), (6, None)]
    d = frame(spark, rows)
    assert common.numbered(d) == (d, None)
    assert sorted((r.doc_id, r.text) for r in substrings.remove_repeats(d).collect() if r.text) == [(3, f"{p} x"), (4, "y "), (5, q)]
    empty = frame(spark, [])
    assert substrings.remove_repeats(empty).columns == d.columns and substrings.remove_repeats(empty).count() == 0
    assert substrings.substring_duplicates(empty).count() == 0
    same = frame(spark, [(1, p), (1, p), (1, p)])
    assert [r.text for r in substrings.remove_repeats(same).collect()] == [p]
    with pytest.raises(ValueError):
        substrings.repeated_spans(same)


def stored(spark):
    where = common.shared_dir(spark).removeprefix("file://")
    return set(os.listdir(where)) if os.path.isdir(where) else set()


def test_stored_tables_go(spark):
    d = frame(spark, [(i, f"word{i % 7} and some more words of text {i % 5}") for i in range(60)])
    before = stored(spark)
    near = simhash.near_duplicates(d)
    kinds = {n.rpartition("-")[0] for n in stored(spark) - before}
    assert kinds == {"fingerprints", "fingerprint-groups"} and near.count() == 60
    common.discard(*near.reads)
    links = spark.createDataFrame([(i, i + 1) for i in range(30)], "u long, v long")
    found = graph.connected_components(links)
    assert {n.rpartition("-")[0] for n in stored(spark) - before} == {"links"} and len(stored(spark) - before) == 1
    assert found.where("component = 0").count() == 31
    common.discard(*found.reads)
    items = spark.createDataFrame([(1, "word1 and")], "item_id long, text string")
    judged = decontam.decontaminate(d, items)
    assert judged.where("n_items = 1").count() > 0
    common.discard(*judged.reads)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert rules.quality_rules(d, labels).count() == 60
    assert stored(spark) == before


def test_pipeline_leaves_the_last_stage_only(spark, tmp_path):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    if not os.path.isdir(source):
        pytest.skip("no test data")
    shutil.copytree(source, tmp_path / "t")
    before = stored(spark)
    assert corpus_pipeline.run(spark, str(tmp_path / "t")).count() > 0
    assert {n.rpartition("-")[0] for n in stored(spark) - before} == {"stage-benchmark_decontamination"}


def test_free_names(spark):
    d = spark.createDataFrame([(1, 2, 3)], "A int, a_ int, b int")
    assert common.free_name(d, "a") == "a__" and common.free_name(d, "c") == "c"
    rows, given = common.numbered(spark.createDataFrame([(2, "x", 1), (None, "y", 2), (2, "a", 3), (1, None, 4)], "doc_id long, text string, given_id int"))
    assert given == "given_id_" and [r[given] for r in rows.orderBy("doc_id").collect()] == [1, 2, 2, None]
    assert rows.select("doc_id").distinct().count() == 4
    assert common.with_given_ids(rows, given, ["doc_id", "given_id"]).where(F.col("doc_id").isNull()).first().given_id == 2
