"""Exact dedup, whitening and resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexmill.llm import exactdups, resampling, whitening

DOCS = "doc_id long, text string, key string, bucket int, at long, ids string"
AWKWARD = [None, "", " \n\t ", "a", "A", "a b", "A B c", "É", "é", "word " * 3000, "\x00 q", "x" * 50_000, "X" * 50_000, "K", "k"]


def docs(spark, rows):
    """Extra columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], DOCS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def exact_by_loop(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, digest = max(known) if known else None, hashlib.sha256(t.encode()).hexdigest()
        stays = ids.index(keep) if known else 0
        out += [(i, keep, len(ids), n == stays, digest) for n, i in enumerate(ids)]
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


AWKWARD_ROWS = [*enumerate(AWKWARD), (None, "a"), (None, "only null ids"), (None, "Only null ids"), (3, "a"), (3, "a"), (7, "other"), (7, "text of one id")]


@pytest.mark.parametrize("bits, capacity", [(63, None), (3, None), (0, 10), (63, 1), (12, 500)])
def test_exact_duplicates_against_a_loop(spark, bits, capacity):
    """With few bits keys collide and texts are chained; a small capacity makes the directory deep."""
    assert found(exactdups.exact_duplicates(docs(spark, AWKWARD_ROWS).repartition(3), bits, capacity)) == exact_by_loop(AWKWARD_ROWS)


def test_exact_duplicates_of_a_hot_text(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), "The Hot text" if i % 3 == 0 else f"text {rng.integers(300)}") for i in range(3000)]
    df = docs(spark, rows).repartition(40)
    assert found(exactdups.exact_duplicates(df)) == exact_by_loop(rows)
    index = exactdups.build_index(df)
    hot = index.where("record is not null").groupBy("key", "chain").count().agg(F.max("count")).first()[0]
    assert hot == 40  # one record from each partition, not one from each row
    assert exactdups.exact_duplicates(docs(spark, [])).count() == 0


def test_lists_of_ids_are_cut(spark, monkeypatch):
    monkeypatch.setattr(exactdups, "RECORDS_PER_COPY", 2)
    rows = [(i, "same") for i in range(100)] + [(None, "same")]
    assert found(exactdups.exact_duplicates(docs(spark, rows).repartition(9))) == exact_by_loop(rows)
    held = exactdups._Collapsed(63)
    for i in range(exactdups.RECORD_IDS + 1):
        held.add(i, b"t")
    assert [len(ids) for _, _, ids in held.taken()] == [exactdups.RECORD_IDS, 1]


def test_directory_doubling():
    rng = np.random.default_rng(9)
    keys = np.unique(rng.integers(0, 1 << exactdups.KEY_BITS, 4000))
    keys = np.concatenate([keys, keys[:5] + 1])
    cells = np.sort(np.unique(keys >> exactdups.KEY_BITS - exactdups.MAX_DEPTH))
    of = keys >> exactdups.KEY_BITS - exactdups.MAX_DEPTH
    size = np.array([10 * (of == c).sum() for c in cells])
    least, most = (np.array([f(keys[of == c]) for c in cells]) for f in (min, max))
    d = exactdups.Directory(cells, size, least, most, 200)
    assert len(d.slots) == 1 << d.depth and d.depth > 4
    at = keys >> exactdups.KEY_BITS - d.depth
    loads = Counter(d.slots[at].tolist())
    assert max(loads.values()) * 10 <= 200
    for bucket, local in enumerate(d.local):
        assert (d.slots == bucket).sum() == 1 << d.depth - local  # a bucket's places are one run of its depth
    owner = d.owners(7)
    assert (np.diff(owner) >= 0).all() and set(owner) == set(range(7))
    assert all(len(set(owner[d.slots == b])) == 1 for b in range(len(d.local)))
    shares = Counter(owner[at].tolist())
    assert max(shares.values()) < 1.2 * len(keys) / 7


def test_a_bucket_of_one_key_does_not_split():
    one = exactdups.Directory(np.array([5]), np.array([10**9]), np.array([5 << 47]), np.array([5 << 47]), 10)
    assert one.depth == 0 and one.owners(4).tolist() == [2]
    empty = exactdups.Directory(*[np.array([], np.int64)] * 4, 10)
    assert empty.depth == 0 and empty.owners(4).shape == (1,)


VECTORS = "vec_id long, embedding array<float>, x int, c int, n int"


def whitened_by_numpy(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)) + 100_000
    centred = x - x.mean(axis=0)
    values, rows = np.linalg.eigh(centred.T @ centred / len(x))
    values, rows = values[::-1][:8], rows.T[::-1][:8]
    exact = x.astype(int)
    return centred @ rows.T / np.sqrt(values), values / np.trace(centred.T @ centred / len(x)), ((len(x) * exact - exact.sum(axis=0)) ** 2).sum(axis=1)


@pytest.mark.parametrize("dims, panel", [(12, 16), (12, 5), (3, 16), (1, 16)])
def test_whitening_against_numpy(spark, dims, panel):
    rng = np.random.default_rng(dims)
    good = (rng.normal(size=(120, dims)) * np.arange(1, dims + 1)).astype(np.float32).tolist()
    bad = [None, [None] * dims, [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [1e20] * dims, [0.0] * (dims + 2), []]
    rows = [(i, v, 1, 2, 3) for i, v in enumerate(good)] + [(None, good[0], 1, 2, 3), (5, good[5], 1, 2, 3)] + [(900 + i, v, 1, 2, 3) for i, v in enumerate(bad)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS), panel=panel).collect()
    want, shares, deviation = whitened_by_numpy([*good, good[0], good[5]])
    k = min(dims, 8)
    assert len(got) == k * len(want)
    assert {r.vec_id for r in got} == {None, *range(120)}
    for r in got:
        i, c = (0 if r.vec_id is None else r.vec_id), r.component - 1
        assert abs(abs(r.whitened) - abs(want[i, c])) < 1e-6 and r.explained == pytest.approx(shares[c], rel=1e-9)
        assert r.n == 122 and r.deviation == deviation[i] and r.identity_error < 1e-9
    by_component = {c: np.array([r.whitened * want[r.vec_id, c - 1] for r in got if r.component == c and r.vec_id is not None]) for c in range(1, k + 1)}
    assert all((v >= -1e-6).all() or (v <= 1e-6).all() for v in by_component.values())  # one sign for all rows


def test_whitening_without_variance(spark):
    flat = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0], 1, 2, 3), (2, [2.0, 3.0], 1, 2, 3)], VECTORS)).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat] == [(c, 0, None, None, None) for _ in range(2) for c in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], 1, 2, 3) for i in range(4)], VECTORS)).collect()
    assert [r.whitened is None for r in line] == [False, True] * 4 and line[0].identity_error < 1e-9
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, 2, 3), (2, [], 1, 2, 3)], VECTORS)).count() == 0


def resampled_by_loop(rows, target, longest=1, percent=10, min_words=20, buckets=10_000):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    total, wanted, out = sum(s.values()), sum(t.values()), []
    for i, text in rows:
        words, found = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in found]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gains) // len(gains) if gains else 0
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= min_words])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): n for n, r in enumerate(able[: percent * len(able) // 100], 1)}
    return Counter((*r[:4], ranks.get(id(r))) for r in out)


@pytest.mark.parametrize("longest, percent", [(1, 10), (3, 40)])
def test_resampling_against_a_loop(spark, longest, percent):
    rng = np.random.default_rng(longest)
    words = [f"W{i}é" if i % 5 == 0 else f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 80))))) for i in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(None, rows[0][1]), (None, None), (4, rows[4][1]), (4, rows[4][1])]
    target = [" ".join(words[:30]), None, "", " ".join(words[:7])]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs(spark, rows).repartition(5), goal, percent=percent, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == resampled_by_loop(rows, target, longest, percent)


def test_resampling_edges(spark):
    goal = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(docs(spark, []), goal).count() == 0
    rows = [(7, " ".join(["same"] * 30))] * 40  # one id, one text: ties of all keys
    got = resampling.resample(docs(spark, rows).repartition(4), goal.limit(0))
    assert Counter(map(tuple, got.collect())) == resampled_by_loop(rows, [])
