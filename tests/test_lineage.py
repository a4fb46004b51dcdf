"""Lineage: traces against a walk, breaks, and the account of single blocks."""

import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from codexmill.operators import lineage
from codexmill.operators.stored import scratch
from codexmill.sources import stream

LINKS = "from_kind string, from_key string, to_kind string, to_key string"


def walked(links, seeds):
    out = set()
    for seed in seeds:
        for sign, (a, b) in ((1, (slice(0, 2), slice(2, 4))), (-1, (slice(2, 4), slice(0, 2)))):
            seen, queue = {seed: 0}, deque([seed])
            while queue:
                at = queue.popleft()
                for e in links:
                    if e[a] == at and e[b] not in seen:
                        seen[e[b]] = seen[at] + sign
                        queue.append(e[b])
            out |= {(*seed, *node, d) for node, d in seen.items()}
    return out


def test_traces_against_a_walk(spark):
    rng = random.Random(2)
    some = lambda: (rng.choice("abc"), str(rng.randint(0, 14)))
    links = list({(*some(), *some()) for _ in range(60)})  # with cycles
    seeds = [some() for _ in range(5)] * 2 + [("z", "none")]
    got = lineage.trace(spark.createDataFrame(links, LINKS), spark.createDataFrame(seeds, "kind string, key string")).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == walked(links, set(seeds))
    empty = spark.createDataFrame([], "kind string, key string")
    assert lineage.trace(spark.createDataFrame(links, LINKS), empty).count() == 0
    where = os.path.dirname(scratch(spark, "x").removeprefix("file:"))
    kept = {n for n in os.listdir(where) if n.startswith("lineage-")}
    chain = spark.createDataFrame([("a", str(i), "a", str(i + 1)) for i in range(6)], LINKS)
    with pytest.raises(RuntimeError):
        lineage.trace(chain, spark.createDataFrame([("a", "0")], "kind string, key string"), most=3)
    assert {n for n in os.listdir(where) if n.startswith("lineage-")} == kept  # the one that failed left nothing


@pytest.fixture(scope="module")
def parts(spark):
    raw = spark.createDataFrame([("D", "a"), ("D", "b"), ("D", "c"), ("D", "lost")], "document_id string, block_id string")
    documents = spark.createDataFrame([("D", "a", "pa", True), ("D", "b", "pb", True), ("D", "c", None, False), ("D", "new", "pn", None)], "document_id string, block_id string, parent_id string, indexable boolean")
    parents = spark.createDataFrame([("pa",), ("px",), ("pn",)], "parent_id string")
    chunks = spark.createDataFrame([("c1", "pa"), ("c2", "pa"), ("c3", "gone")], "chunk_id string, parent_id string")
    rows = spark.createDataFrame([("r1", "c1", "pa"), ("r2", None, "pn"), ("r3", "c9", None), ("r4", "c3", None), ("r5", "c1", None)], "row_id string, chunk_id string, parent_id string")
    return raw, documents, parents, chunks, rows


def test_breaks(spark, parts):
    got = sorted(map(tuple, lineage.breaks(lineage.nodes(*parts), lineage.edges(*parts), parts[1]).collect()))
    assert got == sorted([
        ("missing", "raw", "D/new"), ("missing", "parent", "pb"), ("missing", "parent", "gone"), ("missing", "chunk", "c9"), ("orphan", "document", "D/new"), ("orphan", "parent", "px"), ("orphan", "chunk", "c3"), ("orphan", "row", "r3"),
        ("barren", "raw", "D/lost"), ("barren", "document", "D/b"), ("barren", "parent", "px"), ("barren", "chunk", "c2"),
    ])
    empty = [p.limit(0) for p in parts]
    assert lineage.breaks(lineage.nodes(*empty), lineage.edges(*empty), empty[1]).count() == 0


def test_counts_of_traces(spark, parts):
    seeds = spark.createDataFrame([("parent", "pa"), ("row", "r5")], "kind string, key string")
    got = {r.seed_key: (r.raw, r.document, r.parent, r.chunk, r.row) for r in lineage.trace_counts(lineage.trace(lineage.edges(*parts), seeds)).collect()}
    assert got == {"pa": (1, 1, 1, 2, 2), "r5": (1, 1, 1, 1, 1)}


def test_account_of_blocks(spark):
    xml = b"<response><status><code>200</code></status><data><texto><bloque id='a'><version id_norma='N'><p>Uno dos</p><p>tres</p></version><version id_norma='M'><p>x</p></version></bloque><bloque id='b'/></texto></data></response>"
    raw = stream.stream_norms(spark.createDataFrame([("D", xml)], "file string, content binary")).withColumnRenamed("file", "document_id")
    documents = spark.createDataFrame([("D", "a", "precepto", True), ("D", "z", "firma", False)], "document_id string, block_id string, block_type string, indexable boolean")
    chunks = spark.createDataFrame([("D", "a", "c2", "hello", 2, 2), ("D", "a", "c1", "hi", 1, 2), ("D", "q", "c", "x", 1, 1)], "document_id string, block_id string, chunk_id string, text string, position int, count_for_parent int")
    wanted = spark.createDataFrame([("D", "a"), ("D", "a"), ("D", "b"), ("D", "none")], "document_id string, block_id string")
    got = {r.block_id: r for r in lineage.trace_blocks(wanted, raw, documents, chunks, shown=3).collect()}
    assert len(got) == 3 and got["a"].n_versions == 2 and got["a"].snippet == "Uno" and got["a"].document.block_type == "precepto"
    assert [tuple(c) for c in got["a"].chunks] == [("c1", 2, 1, 2), ("c2", 5, 2, 2)]
    assert (got["b"].n_versions, got["b"].document, got["b"].chunks, got["none"].n_versions) == (0, None, [], 0)
    assert lineage.trace_blocks(wanted.where(F.lit(False)), raw, documents, chunks).count() == 0
