import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.operators import blocks, context, metrics, quality, retrieval, stats


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_scalars(spark):
    df = spark.createDataFrame([(" a  b\n", "20159902", "BOE-A-2015-10565 y", "La ley", "IVA")], "a string, b string, c string, d string, e string")
    r = df.select(T.clean_text(F.col("a")), T.normalize_date(F.col("b")), T.norm_id(F.col("c")), T.lower_first(F.col("d")), T.lower_first(F.col("e")), T.normalize_date(F.lit("2015"))).first()
    assert tuple(r) == ("a b", "2015-99-02", "BOE-A-2015-10565", "la ley", "IVA", None)


def test_term_boundaries(spark):
    df = spark.createDataFrame([("son 140.000 euros", "40.000"), ("son 40.000 euros", "40.000"), ("año dos", "a")], "h string, n string")
    assert [r[0] for r in df.select(T.contains_term(F.col("h"), F.col("n"))).collect()] == [False, True, False]


def test_template_is_filled_once(spark):
    r = spark.range(1).select(T.render_template("q {a} {b}", {"a": F.lit("{b}"), "b": F.lit("x")})).first()
    assert r[0] == "q {b} x"


def test_dense_ties_and_blocks(spark, monkeypatch):
    units = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(6)], "unit_id long, vector array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<float>")
    want = [(1, 1, 1.0, 1), (1, 3, 1.0, 2), (1, 5, 1.0, 3), (2, 0, 1.0, 1), (2, 1, 1.0, 2), (2, 2, 1.0, 3)]
    assert rows(retrieval.dense_search(units, queries, 3), "query_id", "rank") == want
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 16)
    monkeypatch.setattr(retrieval, "ROW_BYTES", 40)
    assert rows(retrieval.dense_search(units, queries, 3), "query_id", "rank") == want
    with pytest.raises(ValueError):
        retrieval.dense_search(units, queries, 0)


def test_dense_grid_against_numpy(spark, monkeypatch):
    """Seven groups of queries by many of rows; near ties keep the order of their full scores."""
    rng = np.random.default_rng(4)
    r, q = rng.normal(size=(500, 8)), rng.normal(size=(40, 8))
    r[100], r[7], r[8] = r[3], r[3] * (1 + 1e-9), r[3]
    units = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r)], "unit_id long, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    scores = np.round(q @ r.T, 12)
    want = [(i, int(u), round(float(scores[i, u]), 6), n) for i in range(40) for n, u in enumerate(sorted(range(500), key=lambda u: (-scores[i, u], u))[:9], 1)]
    monkeypatch.setattr(retrieval, "TILE_ROWS", 64)
    monkeypatch.setattr(retrieval, "TILE_QUERIES", 3)
    for how in ({}, {"query_bytes": 400, "row_bytes": 3000}, {"query_bytes": 400}):
        assert rows(retrieval.dense_search(units, queries, 9, **how), "query_id", "rank") == want, how
    assert retrieval.dense_search(units.limit(0), queries, 3, query_bytes=400).count() == retrieval.dense_search(units, queries.limit(0)).count() == 0
    assert retrieval.dense_search(units.limit(2), queries, 9, query_bytes=400).count() == 80


@pytest.mark.parametrize("bad", [[1.0], [1.0, 2.0, 3.0], None])
def test_dense_lengths(spark, bad):
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, 2.0])], "unit_id long, vector array<float>")
    other = spark.createDataFrame([(1, bad), (2, [1.0, 2.0, 3.0] if bad and len(bad) == 1 else [1.0, 2.0])], "unit_id long, vector array<float>")
    as_queries = lambda df: df.withColumnRenamed("unit_id", "query_id")
    with pytest.raises(Exception, match="length"):
        retrieval.dense_search(other, as_queries(two)).collect()
    with pytest.raises(Exception, match="length"):
        retrieval.dense_search(other, as_queries(two), query_bytes=1).collect()
    with pytest.raises(ValueError):
        retrieval.dense_search(two, as_queries(other))


def test_bm25_boost_and_overlap(spark):
    docs = spark.createDataFrame([(1, ["a", "b"], ["z"]), (2, ["a"], []), (3, ["c"], [])], "unit_id long, tokens array<string>, heading array<string>")
    asked = spark.createDataFrame([(1, ["z"]), (2, ["q"])], "query_id long, tokens array<string>")
    assert rows(retrieval.bm25_search(docs, asked, 5), "query_id") == []
    assert [r[1] for r in rows(retrieval.bm25_search(docs, asked, 5, boost=3), "rank")] == [1]


def test_rrf_and_weighted(spark):
    run = lambda units: spark.createDataFrame([(1, u, 1.0 / (k + 1), k + 1) for k, u in enumerate(units)], "query_id long, unit_id string, score double, rank int")
    fused = retrieval.fuse_rrf([run(["a", "b"]), run(["b", "c"])])
    assert [r[1] for r in rows(fused, "rank")] == ["b", "a", "c"]
    w = {r[1]: r[2] for r in rows(retrieval.fuse_weighted(run(["a", "b"]), run(["c"])), "rank")}
    assert w == {"a": 0.7, "b": 0.0, "c": 0.3}


def test_ranking_metrics(spark):
    hits = spark.createDataFrame([(1, "p1", 1), (1, "p1", 2), (1, "p2", 3), (1, "p3", 4)], "query_id long, parent_id string, rank int")
    judged = spark.createDataFrame([(1, "p2", 2), (1, "p9", 1), (2, "p1", 0)], "query_id long, parent_id string, relevance int")
    a, b = rows(metrics.ranking_metrics(hits, judged), "query_id")
    assert a[1:4] == (0.0, 0.5, 0.5)
    assert a[4] == pytest.approx((3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    assert b == (2, 0.0, 0.0, 0.0, 0.0)
    assert rows(metrics.raw_hit_metrics(hits, 3), "query_id") == [(1, 2, pytest.approx(1 / 3))]


def test_evidence_needs_an_anchor(spark):
    e = spark.createDataFrame([(1, "p", 2), (1, "p", 9)], "query_id long, parent_id string, order int")
    kind = "query_id long, parent_id string, rank int, start int, end int"
    assert rows(metrics.evidence_recall(spark.createDataFrame([(1, "p", 1, None, None)], kind), e, 5), "query_id") == [(1, 0.0, 0.0)]
    assert rows(metrics.evidence_recall(spark.createDataFrame([(1, "p", 1, 1, 3)], kind), e, 5), "query_id") == [(1, 1.0, 0.5)]


def test_pareto_keeps_equal_points(spark):
    p = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 1.0), (3, 4.0, 2.0), (4, 9.0, 500.0), (5, 9.0, 700.0)], "k int, q double, c double")
    assert [r[0] for r in rows(metrics.pareto_front(p, "k", "q", "c"), "k")] == [1, 2, 4]


def test_holm(spark):
    p = spark.createDataFrame([("a", 0.0001), ("b", 0.026), ("c", 0.24)], "k string, p double")
    got = {r[0]: r for r in rows(metrics.holm(p, "k", "p"), "k")}
    assert got["b"][2] == pytest.approx(0.052) and not got["b"][3] and got["a"][3]


def test_resampling_is_seeded_and_sane():
    v = np.arange(28) / 27
    assert stats.bootstrap_ci(v) == stats.bootstrap_ci(v)
    for ci in (stats.bootstrap_ci(v), stats.bca_ci(v)):
        assert ci["lo"] < ci["mean"] < ci["hi"]
    assert stats.paired_bootstrap(v, v)["p"] == 1.0 and stats.tost(v, v, 0.02)["equivalent"]
    assert stats.bootstrap_ci([])["n"] == 0
    with pytest.raises(ValueError):
        stats.paired_bootstrap([1], [1, 2])


def test_versions(spark):
    v = spark.createDataFrame([("a", "2020-01-01"), ("a", "2021-01-01"), ("b", "2020-01-01"), ("b", "2020-01-01"), ("c", "2020-01-01"), ("d", "2020-01-01"), ("d", "2021-01-01"), ("e", "2020-01-01")], "k string, published string")
    i = spark.createDataFrame([("a", "2021-01-01"), ("b", "2020-01-01"), ("c", "2019-01-01"), ("d", "2020-01-01")], "k string, index_date string")
    got = {r[0]: r[1:] for r in rows(blocks.resolve_versions(v, i, ["k"]), "k")}
    assert got == {"a": ("resolved", "2021-01-01"), "b": ("ambiguous", None), "c": ("unresolved", None), "d": ("index_not_max", None), "e": ("missing_index_date", None)}


def _packed(paragraphs, limit, overlap):
    out, now = [], []
    for p in filter(None, paragraphs):
        if now and len("\n".join([*now, p])) > limit:
            out.append(now)
            now = (now[-overlap:] if overlap else []) + [p]
        else:
            now = [*now, p]
    return out + ([now] if now else [])


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_packing_equals_a_loop(spark, overlap):
    rng = np.random.default_rng(overlap)
    data = [(i, ["x" * int(n) for n in rng.integers(0, 40, int(rng.integers(0, 12)))]) for i in range(60)]
    df = spark.createDataFrame(data, "i int, p array<string>")
    for i, got in df.select("i", blocks.pack(F.col("p"), 60, overlap)).collect():
        assert [list(g) for g in got] == _packed(data[i][1], 60, overlap)


def test_hierarchy_resets(spark):
    df = spark.createDataFrame([(1, 1, "book", "B1"), (1, 2, "title", "T1"), (1, 3, "x", "-"), (1, 4, "book", "B2"), (1, 5, "x", "-")], "d int, o int, level string, text string")
    got = [tuple(r)[4:] for r in blocks.heading_state(df, "d", "o", "level", "text", ["book", "title"]).orderBy("o").collect()]
    assert got == [("B1", None), ("B1", "T1"), ("B1", "T1"), ("B2", None), ("B2", None)]


def test_bounded_expansion_tries_next_first(spark):
    df = spark.createDataFrame([(["aa", "bb", "cc", "dddddd"],)], "p array<string>")
    r = df.select(context.expand_bounded(F.col("p"), F.lit(1), F.lit(1), 5).alias("x")).first().x
    assert (r.lo, r.hi, r.size) == (1, 2, 5)
    r = df.select(context.expand_bounded(F.col("p"), F.lit(1), F.lit(1), 9).alias("x")).first().x
    assert (r.lo, r.hi, r.size) == (0, 2, 8)


def test_evidence_skips_and_goes_on(spark):
    hits = spark.createDataFrame([(1, "a", 1, "x" * 6), (1, "a", 2, "x"), (1, "b", 3, "x" * 20), (1, "c", 4, "x" * 6), (1, "d", 5, " "), (1, "e", 6, "x" * 3)], "query_id long, parent_id string, rank int, text string")
    got = [r[1:] for r in rows(context.select_evidence(hits, 2, 10, 10), "rank")]
    assert got == [("a", 1, "E1", None), ("b", 3, None, "exceeds_evidence_context_budget"), ("c", 4, None, "exceeds_total_context_budget"), ("d", 5, None, "empty_context"), ("e", 6, "E2", None)]


def test_vector_gate(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [2.0, 0.0]), (5, [float("nan"), 0.0]), (6, [1.0])], "k int, v array<float>")
    got = {(r[0], r[2]) for r in quality.vector_findings(df, "k", "v", 2).collect()}
    assert {("zero_vector", "3"), ("norm", "4"), ("not_finite", "5"), ("dimension", "6"), ("equal_vectors", "1")} <= got


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, t string")
    assert quality.fingerprint(a, "i", "t").first() == quality.fingerprint(a.orderBy(F.desc("i")), "i", "t").first()
    assert quality.fingerprint(a, "i", "t").first() != quality.fingerprint(a.where("i = 1"), "i", "t").first()


def test_hybrid_fuses_deep_runs(spark):
    rows = [(1, u, float(200 - u), u) for u in range(1, 151)]
    run = lambda sign: lambda n: spark.createDataFrame([(q, u if sign else 161 - u, s, r) for q, u, s, r in rows if r <= n], "query_id long, unit_id long, score double, rank long")
    first, second = {u: u for u in range(1, 101)}, {161 - u: u for u in range(1, 101)}
    both = {u: sum(1 / (60 + x[u]) for x in (first, second) if u in x) for u in first | second}
    want = sorted(both, key=lambda u: (-round(both[u], 6), u))[:10]
    assert [r.unit_id for r in retrieval.hybrid(run(True), run(False)).orderBy("rank").collect()] == want
    scaled = {u: 0.7 * (100 - first.get(u, 100)) / 99 + 0.3 * (100 - second.get(u, 100)) / 99 for u in both}
    want = sorted(scaled, key=lambda u: (-round(scaled[u], 6), u))[:10]
    assert [r.unit_id for r in retrieval.hybrid(run(True), run(False), fusion="weighted", alpha=0.7).orderBy("rank").collect()] == want
    assert retrieval.hybrid(run(True), run(False), k=120).count() == 120


def test_label_metrics_equal_listed_pairs(spark):
    rng = np.random.default_rng(4)
    members = [(i, int(rng.integers(5)) if i % 9 else None) for i in range(60)] + [(1, 1), (1, 1)]
    asked = [(q, int(rng.integers(7)) if q % 5 else None) for q in range(20)]
    hits = [(q, int(p), r + 1) for q in range(19) for r, p in enumerate(rng.integers(0, 60, 12))]
    m = spark.createDataFrame(members, "parent_id long, label int")
    a, h = spark.createDataFrame(asked, "query_id long, label int"), spark.createDataFrame(hits, "query_id long, parent_id long, rank int")
    pairs = a.join(m.distinct(), "label").select("query_id", "parent_id", F.lit(1).alias("relevance"))
    for k in (1, 3, 10):
        got, want = rows(metrics.label_metrics(h, a, m, k), "query_id"), rows(metrics.ranking_metrics(h, pairs, k), "query_id")
        assert [x[0] for x in got] == [x[0] for x in want]
        assert np.allclose([x[1:] for x in got], [x[1:] for x in want])
    assert metrics.label_metrics(h, a, m.limit(0)).count() == 0


@pytest.mark.parametrize("ranges", [2, 7, 1024])
def test_carried_ranges_against_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(metrics, "RANGES", ranges)
    rng = np.random.default_rng(ranges)
    scored = [(float(x) / 8, bool(y)) for x, y in zip(rng.integers(-40, 40, 200), rng.integers(0, 2, 200))] + [(None, True), (1e300, True), (-math.inf, False)]
    held = [x for x in scored if x[0] is not None]
    up, down = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((a > b) + (a == b) / 2 for a in up for b in down) / len(up) / len(down)
    best = max({s for s, _ in held}, key=lambda t: (round((sum(s >= t for s in up) / len(up) + sum(s < t for s in down) / len(down)) / 2, 10), -t))
    got = metrics.auc_threshold(spark.createDataFrame(scored, "score double, positive boolean")).first()
    assert got["auc"] == pytest.approx(auc, abs=1e-4) and got["threshold"] == best
    points = [(i, int(rng.integers(0, 30)), float(rng.integers(0, 50))) for i in range(150)]
    front = [p[0] for p in points if not any(q[1] >= p[1] and q[2] <= p[2] and (q[1] > p[1] or q[2] < p[2]) for q in points)]
    table = spark.createDataFrame(points, "k long, q int, c double")
    assert [r[0] for r in rows(metrics.pareto_front(table, "k", "q", "c"), "k")] == front
    assert metrics.pareto_front(table.limit(0), "k", "q", "c").count() == 0
