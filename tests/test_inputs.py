import duckdb
import pytest
from pyspark.sql import functions as F

from codexmill import registry
from codexmill.operators import generation, quality, windows
from codexmill.plans import inputs  # noqa: F401
from codexmill.sources import files, norms

DATA = "/root/testdata/sf0.001"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("name", ["embedding_inputs", "window_anchors", "answer_outcomes", "citation_scores", "stratum_latency", "dataset_checks"])
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = registry.QUERIES[name](spark, DATA)
    found = con.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(names)
    text = lambda r: tuple("" if x is None else f"{x:.5f}" if isinstance(x, float) else str(x) for x in r)
    assert sorted(map(text, got.select(*[f"`{n}`" for n in names]).collect())) == sorted(map(text, found.fetchall()))


def test_token_windows(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 10, 11, 19, 20)], "n int")
    got = [[tuple(w) for w in r[1]] for r in rows(df.select("n", windows.token_windows(F.col("n"), 10, 2)), "n")]
    assert got == [[], [(0, 1)], [(0, 10)], [(0, 10), (8, 11)], [(0, 10), (8, 18), (16, 19)], [(0, 10), (8, 18), (16, 20)]]


def test_numbering_is_dense(spark):
    df = spark.createDataFrame([(k, p) for k in (5, 9000, 9001, 20000) for p in range(k % 4 + 1)], "k long, p int")
    got = rows(windows.numbered(df, "k", "p").select("row_index", "k", "p"), "row_index")
    assert [r[0] for r in got] == list(range(len(got))) and [r[1:] for r in got] == sorted(r[1:] for r in got)


def test_paragraph_roles(spark):
    xml = """<response><status><code>200</code></status><data><texto><bloque id="a1" tipo="precepto" titulo="T"><version id_norma="N" fecha_publicacion="20200101">
      <p class="articulo">Art. <b>1</b></p><blockquote><p class="parrafo">old</p><table><tr><td>x</td></tr></table><p class="nota_pie">note</p></blockquote>
      <table><tr><th>h</th><th/></tr><tr><td><p>a</p></td><td>b</td></tr><tr><td> </td></tr></table><p>(*) Téngase en cuenta que</p></version></bloque></texto></data></response>"""
    df = spark.createDataFrame([("f", xml.encode()), ("bad", b"<x"), ("none", None), ("no", b"<response><status><code>404</code></status></response>")], "file string, content binary")
    got = norms.parse_norms(df)
    assert rows(got.where("error is null").select("place", "text", "role", "class"), "place") == [
        (0, "Art. 1", "kept", "articulo"), (1, "old", "dropped", "parrafo"), (2, "x", "dropped", "cuerpo_tabla_izq"), (3, "note", "note", "nota_pie"),
        (4, "h", "kept", "cabeza_tabla"), (5, "a | b", "kept", "cuerpo_tabla_izq"), (6, "(*) Téngase en cuenta que", "note", ""),
    ]
    assert [r[0] for r in rows(got.where("error is not null").select("file"), "file")] == ["bad", "no", "none"]


def test_publish_audits_and_never_overwrites(spark, tmp_path):
    df, path = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string"), f"file://{tmp_path}/one"
    audit = lambda r: quality.rule_findings(r, F.col("id"), [("no_text", quality.ERROR, F.col("id") > 5)])
    files.publish(df, path, audit, {"view": "v"})
    assert rows(files.load(spark, path), "id") == [(1, "a"), (2, None)]
    with pytest.raises(files.PublishError):
        files.publish(df, path, audit)
    with pytest.raises(files.PublishError):
        files.publish(df.withColumn("id", F.col("id") + 5), path + "2", audit)
    assert not (tmp_path / "one2").exists()
    spark.createDataFrame([(3, "x")], "id long, t string").write.mode("append").parquet(path + "/rows")
    with pytest.raises(files.PublishError):
        files.load(spark, path)


def test_json_lines_and_csv(spark, tmp_path):
    assert files.json_lines(spark, f"file://{tmp_path}/no.jsonl", "a int").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert rows(files.json_lines(spark, f"file://{tmp_path}/x.jsonl", "a int").where("a is not null"), "a") == [(1,), (2,)]
    files.ragged_csv([spark.createDataFrame([(1,)], "b int"), spark.createDataFrame([(2,)], "a int")], f"file://{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").columns == ["a", "b"]
    assert rows(files.manifest(spark, f"file://{tmp_path}/x.jsonl").select("name", "size"), "name") == [("x.jsonl", 19)]


def test_failed_prompts_cost_their_own_answer(spark):
    def model(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "query_id long, prompt string").coalesce(1)
    assert rows(generation.ask(df, model), "query_id") == [(1, "A", None), (2, None, "ValueError: no"), (3, None, None)]


def test_set_scores_and_facts(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["b"]), (2, [], ["b"]), (3, ["a"], [])], "i int, c array<string>, g array<string>")
    s = generation.set_scores(F.col("c"), F.col("g"))
    assert rows(df.select("i", *s.values()), "i") == [(1, 0.5, 1.0, 2 / 3), (2, 0.0, 0.0, 0.0), (3, None, None, None)]
    r = df.limit(1).select(generation.fact_recall(F.lit("pay 40 now"), F.array(F.lit("40"), F.lit("140"))), generation.allowed_ids(F.lit(2)), generation.allowed_ids(F.lit(0))).first()
    assert tuple(r) == (0.5, "E1, E2", "")
