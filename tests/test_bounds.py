"""Figures that must not grow with the square of a row or with the whole table: tokens, files, patterns, single reads."""

import glob

import pyarrow as pa
from pyspark.sql import functions as F

from codexmill.functions import analysis, text
from codexmill.operators import generation, lineage, postings, windows


def test_files_of_postings_are_bounded_by_hits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RANGE_HITS", 100)
    rows = spark.range(400).select(F.col("id").alias("unit_id"), F.array(*[F.lit(f"t{i}") for i in range(40)]).alias("tokens"))
    postings.build(rows, str(tmp_path / "i"), block_rows=4)
    files = glob.glob(str(tmp_path / "i/postings/shard=*/*.parquet"))
    assert len(files) > 2 * postings.SHARDS


def test_windows_do_not_carry_the_tokens_of_their_text(spark):
    tokens = spark.createDataFrame([(1, [f"w{i}" for i in range(10)]), (2, []), (3, None)], "k long, tokens array<string>")
    made = windows.embedding_inputs(tokens, "k", 4, 1)
    assert [(r.k, r.window, r.n_tokens, r.text) for r in made.orderBy("row_index").collect()] == [(1, 0, 4, "w0 w1 w2 w3"), (1, 1, 4, "w3 w4 w5 w6"), (1, 2, 4, "w6 w7 w8 w9")]
    plan = made.drop("text")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert " tokens#" not in above


def test_stems_stay_in_arrow():
    got = list(analysis._stemmed.func(iter([pa.array([["casas", "casas", "12"], None, [], ["niñas"]])])))
    assert isinstance(got[0], pa.ListArray) and got[0].to_pylist() == [["cas", "cas", "12"], None, [], ["niñ"]]


def test_normal_forms_ask_ranges_not_letters():
    more = analysis._plain_letters()[2]
    classes = analysis._ranges(more)
    assert classes.count("-") < len(more) / 3
    codes = [int(x, 16) for x in classes.replace("\\x{", "").replace("}-", " ").replace("}", " ").split()]
    assert sum(b - a + 1 for a, b in zip(codes[::2], codes[1::2])) == len(more)


def test_terms_and_normal_forms(spark):
    rows = spark.createDataFrame([("El Ñandú ﬁno ½", "FINO"), ("plain  ASCII Text", "ascii"), ("casas", "casa"), ("a b", ""), ("a.b axb", "a.b"), ("é", "e"), (None, "x")], "t string, f string")
    got = rows.select(analysis.normalize_text(F.col("t")).alias("n"), generation.facts_present(F.col("t"), F.array("f")).alias("p"), text.contains_term(F.col("t"), F.col("f")).alias("c")).collect()
    assert [r.n for r in got] == ["el nandu fino 1⁄2", "plain ascii text", "casas", "a b", "a.b axb", "e", ""]
    assert [len(r.p) for r in got] == [1, 1, 0, 0, 1, 1, 0]
    assert [r.c for r in got] == [False, False, False, False, True, False, None]


def test_lineage_is_spread_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(lineage, "PARTITION_ROWS", 10)
    blocks = spark.range(200).select(F.lit("d").alias("document_id"), F.col("id").cast("string").alias("block_id"))
    none = blocks.where("false")
    found = lineage.nodes(blocks, none.withColumn("parent_id", F.lit("p")), none.select(F.lit("p").alias("parent_id")), none.select(F.lit("c").alias("chunk_id")), none.select(F.lit("r").alias("row_id")))
    assert found.rdd.getNumPartitions() > 20 and found.count() == 200


def test_editorial_parts_are_worked_out_once(spark):
    """What several joins read is stored: none goes back to the raw rows or to the given blocks."""
    from codexmill.operators import audit
    from codexmill.plans.audit import _editorial

    files = audit.editorial_state(*_editorial(spark, "/root/testdata/sf0.001")).inputFiles()
    assert files and not [f for f in files if "norm-rows" in f or "documents.parquet" in f]
