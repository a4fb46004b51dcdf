"""The stored lexical index against a plain loop."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexmill.operators import postings, retrieval
from codexmill.sources import files

ROWS = "unit_id long, tokens array<string>, heading array<string>, block int, term string"


def bm25_by_loop(rows, queries, k, k1=1.5, b=0.75, boost=0, allowed=None):
    words = {u: Counter(w or []) + Counter({t: boost * n for t, n in Counter(h or []).items() if boost}) for u, w, h in rows}
    sizes = {u: sum(c.values()) for u, c in words.items()}
    n, mean = len(rows), sum(sizes.values()) / len(rows)
    df = Counter(t for c in words.values() for t in c)
    idf = {t: math.log(n - m + 0.5) - math.log(m + 0.5) for t, m in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = []
    for q, asked in queries:
        scores = {}
        for u, c in words.items():
            if any(t in c for t in asked) and (allowed is None or u in allowed):
                scores[u] = round(sum(idf[t] * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * sizes[u] / mean)) for t in asked if t in c), 6)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, u, s, r) for r, (u, s) in enumerate(best, 1)]
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(11)
    words = [f"t{int(i)}" for i in rng.zipf(1.3, 60_000) if i < 400]
    rows, at = [], 0
    for u in range(300):
        size = int(rng.integers(0, 60))
        rows.append((u, words[at : at + size], words[at + size : at + size + 3]))
        at += size + 3
    rows += [(900, None, None), (901, [], ["t1"]), (902, ["t1"] * 4000, [])]
    queries = [(1, ["t1", "t5", "t5"]), (2, ["t77"]), (3, ["t399", "absent"]), (4, []), (5, [f"t{i}" for i in range(1, 30)]), (6, ["t1"])]
    return rows, queries, spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS), spark.createDataFrame(queries, "query_id long, tokens array<string>")


def found(hits):
    return sorted((r.query_id, r.unit_id, r.score, r["rank"]) for r in hits.collect())


@pytest.mark.parametrize("block_rows, seeds", [(1024, 16), (8, 2), (1, 3)])
def test_search_against_a_loop(spark, tmp_path, corpus, block_rows, seeds):
    rows, queries, df, asked = corpus
    index = postings.build(df, str(tmp_path / "i"), heading=F.col("heading"), block_rows=block_rows)
    for how in ({}, {"boost": 2}, {"k1": 0.9}, {"b": 0.3, "boost": 1}):
        assert found(postings.search(index, asked, 7, seeds=seeds, **how)) == sorted(bm25_by_loop(rows, queries, 7, **how)), how
    even = df.where("unit_id % 2 = 0")
    got = found(postings.search(index, asked, 5, seeds=seeds, allowed=even.select("unit_id")))
    assert got == sorted(bm25_by_loop(rows, queries, 5, allowed={r[0] for r in rows if r[0] % 2 == 0}))


def test_blocks_are_skipped(spark, tmp_path):
    """A rare word's block decides; the lists of the common word are not read elsewhere."""
    rows = [(u, ["common"] * (1 + u % 3) + (["rare"] if u % 50 == 7 else []), []) for u in range(1000)]
    index = postings.build(spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS), str(tmp_path / "i"), block_rows=10)
    asked = spark.createDataFrame([(1, ["rare", "common"])], "query_id long, tokens array<string>")
    hits = postings.search(index, asked, 3, seeds=30)
    assert found(hits) == sorted(bm25_by_loop(rows, [(1, ["rare", "common"])], 3))
    lists = index.postings.where("term = 'common'").count()
    assert lists > 80
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "unit_id" in plan


SETTINGS = [(None, None, None), (0.9, None, None), (0.0, 1.0, None), (None, 0.3, 1), (2.0, 0.9, 3)]


@pytest.mark.parametrize("cell_hits, cell_pairs", [(1 << 20, 1 << 17), (500, 20), (60, 5)])
def test_scan_against_a_loop(spark, tmp_path, corpus, cell_hits, cell_pairs):
    rows, queries, df, asked = corpus
    index = postings.build(df, str(tmp_path / "i"), heading=F.col("heading"), block_rows=16, filed=False)
    got = postings.scan(index, asked, SETTINGS, 7, cell_hits=cell_hits, cell_pairs=cell_pairs).collect()
    for n, given in enumerate(SETTINGS):
        how = {key: v for key, v in zip(("k1", "b", "boost"), given) if v is not None}
        assert sorted((r.query_id, r.unit_id, r.score, r["rank"]) for r in got if r.setting == n) == sorted(bm25_by_loop(rows, queries, 7, **how)), how
    assert found(postings.search(index, asked, 7, boost=2)) == sorted(bm25_by_loop(rows, queries, 7, boost=2))


def test_scan_of_copies_and_shared_ids(spark, tmp_path):
    """Many equal scores at the depth, rows that share an id or have none, string ids of queries, one of them null."""
    rows = [(u, ["a", "b"], []) for u in range(500, 0, -1)] + [(7, ["a", "c"], ["b"]), (None, ["c"], []), (None, ["b", "b"], [])]
    index = postings.build(spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS), str(tmp_path / "i"), heading=F.col("heading"), block_rows=50)
    asked = spark.createDataFrame([("p", ["a", "b"]), (None, ["c"]), ("s", ["b", "a", "a"])], "query_id string, tokens array<string>")
    key = lambda r: tuple((x is not None, x) for x in (r.query_id, r.unit_id, r.score, r["rank"]))
    for cells in ({}, {"cell_hits": 40, "cell_pairs": 2}):
        got = postings.scan(index, asked, SETTINGS, 5, **cells).collect()
        for n, (k1, b, boost) in enumerate(SETTINGS):
            wanted = postings.search(index, asked, 5, k1=k1, b=b, boost=boost).collect()
            assert sorted(key(r) for r in got if r.setting == n) == sorted(map(key, wanted)), n
    with pytest.raises(ValueError):
        postings.scan(index, asked, SETTINGS, 0)


def test_the_empty_index_is_scanned(spark, tmp_path):
    empty = postings.build(spark.createDataFrame([], ROWS), str(tmp_path / "e"), filed=False)
    asked = spark.createDataFrame([(1, ["a"])], "query_id long, tokens array<string>")
    assert postings.scan(empty, asked, SETTINGS).collect() == []


def test_ablation_reads_lists_once(spark):
    """Ten settings read and shuffle as much as one."""
    rows = spark.createDataFrame([(u, "casa roja", "x") for u in range(50)], "unit_id long, text string, heading string")
    asked = spark.createDataFrame([(1, "casa")], "query_id long, query string")
    plans = []
    for settings in (retrieval.one_factor({"boost": 0}, {}), retrieval.one_factor({"boost": 0, "k1": 1.5, "b": 0.75}, {"boost": [1, 2, 3], "k1": [0.9, 1.2, 2.0], "b": [0.3, 0.5, 0.9]})):
        run = retrieval.lexical_ablation(rows, asked, settings, lambda c: F.split(c, " "))
        plans.append(run._jdf.queryExecution().executedPlan().toString())
    assert [p.count("Exchange hashpartitioning") for p in plans][0] == [p.count("Exchange hashpartitioning") for p in plans][1]
    assert plans[1].count("FileScan") == plans[0].count("FileScan")


def test_an_empty_index_and_a_published_table(spark, tmp_path):
    asked = spark.createDataFrame([(1, ["a"])], "query_id long, tokens array<string>")
    empty = postings.build(spark.createDataFrame([], ROWS), str(tmp_path / "e"))
    assert found(postings.search(empty, asked)) == []
    rows = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c d"), (4, None)], "unit_id long, text string")
    files.publish(rows, str(tmp_path / "p"), lambda r: spark.createDataFrame([], "severity string"))
    index = postings.of_published(spark, str(tmp_path / "p"), str(tmp_path / "i"), lambda c: F.split(c, " "))
    assert [r[1] for r in found(postings.search(index, asked))] == [1]
    with pytest.raises(ValueError):
        postings.search(index, asked, 0)
    with pytest.raises(Exception, match="exists"):
        postings.build(rows, str(tmp_path / "i"), F.split("text", " "))


def test_ablation_shares_analyses(spark, monkeypatch):
    made = []
    build = postings.build_scratch
    monkeypatch.setattr(postings, "build_scratch", lambda *a, **k: made.append(1) or build(*a, **k))
    rows = spark.createDataFrame([(1, "de la casa", "Casa"), (2, "la casas", "x"), (3, "nada", "y")], "unit_id long, text string, heading string")
    asked = spark.createDataFrame([(1, "casa")], "query_id long, query string")
    from codexmill.functions.analysis import analyze

    settings = retrieval.one_factor({"stop_words": True, "stemmed": True, "boost": 0, "k1": 1.5, "b": 0.75}, {"stop_words": [False], "stemmed": [False], "boost": [1, 2, 3], "k1": [0.9, 1.2, 2.0], "b": [0.3, 0.5, 0.9]})
    got = retrieval.lexical_ablation(rows, asked, settings, analyze).collect()
    assert len(settings) == 12 and len(made) == 3
    assert {r.setting for r in got} == {name for name, _ in settings}
    assert sorted(r.unit_id for r in got if r.setting == "base") == [1, 2] and [r.unit_id for r in got if r.setting == "stemmed_false"] == [1]
