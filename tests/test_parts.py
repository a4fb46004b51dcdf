import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexmill.functions import analysis, text
from codexmill.operators import answering, artifacts, context, evaluation, generation, metrics, preparation, postings, retrieval, stats
from codexmill.sources import norms, reports


def test_analyzer(spark):
    df = spark.createDataFrame([("El contrato de 40.000 euros y 1,5 años, la Constitución",), ("canción niño pingüino",), (None,), ("x a 5",)], "t string")
    got = [r[0] for r in df.select(analysis.analyze(F.col("t"))).collect()]
    assert got[0] == ["contrat", "40.000", "eur", "1,5", "años", "constitu"]
    assert got[2] == [] and got[3] == ["5"]
    plain = [r[0] for r in df.select(analysis.analyze(F.col("t"), stemmed=False)).collect()]
    assert plain[1] == ["canción", "niño", "pingüino"]
    decomposed = spark.createDataFrame([("canción niño",)], "t string")
    assert decomposed.select(analysis.analyze(F.col("t"), stemmed=False)).first()[0] == ["canción", "niño"]


def test_stemmer_on_published_pairs():
    pairs = {"cheque": "chequ", "chicas": "chic", "torácicas": "torac", "toreros": "torer", "trabajando": "trabaj", "constitución": "constitu", "rápidamente": "rapid", "haciéndola": "hac", "contribuyeron": "contribu", "distinguen": "disting", "posibilidad": "posibil", "tecnologías": "tecnolog"}
    assert {w: analysis.stem(w) for w in pairs} == pairs


def test_normal_form(spark):
    import unicodedata

    texts = ["Año  ÁÉÍ ñ", "ﬁn ½ … ª", "café \x1f x", "", None, "ÅŞ ǅ ™"]
    want = [" ".join("".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)).lower().split()) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[1] for r in df.select("i", analysis.normalize_text(F.col("t"))).orderBy("i").collect()] == want


def test_facts_and_quoted_needles(spark):
    df = spark.createDataFrame([("Son 140.000 euros y 50% más", ["40.000", "50%", "MAS", ""], ["euros"])], "a string, k array<string>, f array<string>")
    r = df.select(generation.facts_present(F.col("a"), F.col("k")), generation.fact_recall(F.col("a"), F.col("f")), text.contains_term(F.lit(r"a \E b"), F.lit(r"\E"))).first()
    assert r[0] == ["50%", "MAS"] and r[1] == 1.0 and r[2]


def test_agreement_counts_unseen_labels(spark):
    pairs = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", "zz")], "human string, judge string")
    r = metrics.agreement(pairs, ["a", "b"]).first()
    assert (r.n, round(r.agreement, 6)) == (3, 0.666667)


def test_agreement_intervals_against_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.choice("abc")) for i in range(40)]
    got = {r.measure: r for r in evaluation.agreement_intervals(spark.createDataFrame(rows, "query_id long, human string, judge string"), ["a", "b", "c"], resamples=50).collect()}

    def kappa(pairs):
        n, h, j = len(pairs), Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
        chance = sum(h[x] * j[x] for x in "abc") / n / n
        return 1.0 if chance == 1 else (sum(a == b for a, b in pairs) / n - chance) / (1 - chance)

    pairs, draw = [(a, b) for _, a, b in rows], random.Random(42)
    boot = sorted(kappa([pairs[draw.randrange(40)] for _ in range(40)]) for _ in range(50))
    assert got["kappa"].value == pytest.approx(kappa(pairs))
    assert (got["kappa"].lo, got["kappa"].hi) == pytest.approx((boot[1], boot[48]))


def test_margin_must_be_positive():
    with pytest.raises(ValueError):
        stats.tost([1.0], [1.0], 0)


def test_means_of_resamples_do_not_depend_on_slices():
    v = np.arange(50.0)
    assert stats._means(v, 5, 100).tolist() == v[np.random.default_rng(5).integers(0, 50, size=(100, 50))].mean(axis=1).tolist()


def test_query_metrics_with_no_hits(spark):
    hits = spark.createDataFrame([("s", 1, 5, 1, 1, 2)], "strategy string, query_id long, parent_id long, rank int, start int, end int")
    judged = spark.createDataFrame([(1, 5, 2), (2, 7, 1)], "query_id long, parent_id long, relevance int")
    evidence = spark.createDataFrame([(1, 5, 2), (1, 5, 9)], "query_id long, parent_id long, order int")
    got = {r.query_id: r for r in evaluation.query_metrics(hits, judged, evidence).collect()}
    assert (got[1].hit_at_1, got[1].mrr, got[1].ndcg, got[1].evidence_recall_1, got[1].duplicate_rate_3) == (1, 1, 1, 0.5, 0)
    assert got[2].recall_10 == got[2].unique_parents_1 == 0
    with pytest.raises(KeyError):
        evaluation.paired_vs_baseline(evaluation.long_form(evaluation.query_metrics(hits, judged, evidence)), "none")


def _context(spark, strategy, budget, start, end, retrieved, texts):
    df = spark.createDataFrame([(1, [(i + 1, t) for i, t in enumerate(texts)], start, end, retrieved)], "parent_id long, paragraphs array<struct<order:int,text:string>>, start int, end int, text string")
    return context.assemble(df, strategy, budget).first().context


def test_contexts(spark):
    p = ["aa", "bbb", "c", "dddd"]
    assert _context(spark, context.K_ONLY, 9, 2, 3, "", p).text == "bbb\nc"
    assert _context(spark, context.K_ONLY, 9, None, None, "got", p)[:4] == ("got", [], 3, 1)
    assert _context(spark, context.FULL, 9, 2, 2, "", p).text == "aa\nbbb\nc\ndddd"
    # the next one first, then the one before
    assert _context(spark, context.BOUNDED, 6, 2, 2, "", p).orders == [2, 3]
    assert _context(spark, context.BOUNDED, 8, 2, 2, "", p).orders == [1, 2, 3]
    over = _context(spark, context.BOUNDED, 2, 2, 2, "r", p)
    assert (over.text, over.over_budget, over.fallback) == ("r", False, context.ANCHOR_TOO_LONG_TEXT)
    assert _context(spark, context.BOUNDED, 2, 2, 2, "", p).over_budget
    assert _context(spark, context.BOUNDED, 5, 9, 9, "", p).failed


def test_evidences_and_oracle(spark):
    parents = spark.createDataFrame([("a", [(1, "x" * 10)]), ("b", [(1, "y" * 30)]), ("c", [(1, "z" * 5), (2, "w")])], "parent_id string, paragraphs array<struct<order:int,text:string>>")
    hits = spark.createDataFrame([(1, "a", 1, 1, 1, ""), (1, "a", 2, 1, 1, ""), (1, "gone", 3, 1, 1, ""), (1, "b", 4, 1, 1, ""), (1, "c", 5, 1, 1, "")], "query_id long, parent_id string, rank int, start int, end int, text string")
    got = {r.parent_id: (r.evidence_id, r.reason) for r in context.build_evidences(hits, parents, item_chars=100, total_chars=20).collect()}
    assert got == {"a": ("E1", None), "gone": (None, "parent_not_found"), "b": (None, "exceeds_total_context_budget"), "c": ("E2", None)}
    gold = spark.createDataFrame([(1, "c", 1, [2]), (1, "a", 2, None), (1, "none", 3, None), (1, "b", 0, None)], "query_id long, parent_id string, relevance int, orders array<int>")
    assert {r.parent_id: r.evidence_id for r in context.oracle_evidences(gold, parents).collect()} == {"a": "E1", "c": "E2"}
    with pytest.raises(ValueError):
        context.build_evidences(hits, parents, max_evidences=0)


def test_answers(spark):
    parents = spark.createDataFrame([("a", [(1, "alpha")]), ("e", [(1, " ")])], "parent_id string, paragraphs array<struct<order:int,text:string>>")
    hits = spark.createDataFrame([(q, p, 1, 1, 1, "") for q, p in ((1, "a"), (2, "a"), (3, "a"), (4, "e"), (6, "a"))], "query_id long, parent_id string, rank int, start int, end int, text string")
    questions = spark.createDataFrame([(i, f"q{i}") for i in range(1, 7)], "query_id long, query string")

    def model(prompts):
        out = []
        for p in prompts:
            if "q3" in p:
                raise RuntimeError("down")
            cited = ["E9"] if "q2" in p else ["E1", "E1"]
            out.append("no json" if "q6" in p else json.dumps({"answered": True, "answer": "yes", "citations": cited}))
        return out

    got = {r.query_id: r for r in answering.answer(questions, hits, parents, model, "s", "{question} {evidences} {allowed_ids}")[0].collect()}
    assert got[1].answered and [c.parent_id for c in got[1].citations] == ["a"]
    assert (got[2].answered, got[2].reason, got[2].text) == (False, answering.INVALID, None)
    assert got[3].error == "RuntimeError: down" and got[6].error == "invalid answer"
    assert (got[4].reason, got[5].reason, got[5].asked_model) == (answering.NO_EVIDENCE, answering.NO_HITS, False)
    closed = {r.query_id: r for r in answering.answer_closed_book(questions, lambda ps: ['{"answered": false, "reason": "unknown"}'] * len(ps), "s").collect()}
    assert closed[1].reason == "unknown" and not closed[1].answered
    texts = spark.createDataFrame([(1, "t", "ev", "ref")], "query_id long, text string, evidences string, reference string")
    assert answering.judge_faithfulness(texts, lambda ps: ['{"claims": [{"supported": true}, {"supported": false}]}'], "{answer}{evidences}").first().claims == [True, False]
    assert answering.judge_correctness(texts, lambda ps: ['{"verdict": "good"}'], "{answer}{reference}").first().error == "invalid verdict"


def test_model_contracts():
    c = answering.ModelContract("m", "org/m", 4, 512, "a" * 40, "b" * 40, profiles=("p1", "p2", "p1"))
    assert c.pinned() and c.profile_ids() == ("p1", "p2") and c.resolve_profile() == "p1" and c.resolve_profile("p2") == "p2"
    with pytest.raises(ValueError):
        c.resolve_profile("p3")
    with pytest.raises(ValueError):
        answering.assert_compatible(c, {"alias": "m", "dim": 3})
    with pytest.raises(ValueError):
        answering.GenerationConfig(top_k=0)


def test_chunk_anchors_with_repeated_lines(spark):
    parents = spark.createDataFrame([(1, ["a", "b", "a", "b", "c"]), (2, ["x"])], "parent_id long, paragraphs array<string>")
    chunks = spark.createDataFrame([(1, 1, "a\nb"), (1, 2, "b\na"), (1, 3, "a\nb"), (1, 4, "b\nc"), (2, 1, "gone")], "parent_id long, place int, text string")
    got = {(r.parent_id, r.place): (r.first, r.last) for r in preparation.chunk_anchors(chunks, parents).collect()}
    assert got == {(1, 1): (1, 2), (1, 2): (2, 3), (1, 3): (3, 4), (1, 4): (4, 5), (2, 1): (None, None)}


def test_prepared_inputs(spark):
    texts = spark.createDataFrame([(1, 1, "a b c", ["a b c"]), (2, 3, "a b c\nd e\nf g h i", ["a b c", "d e", "f g h i"])], "key long, first int, text string, paragraphs array<string>")
    got = [(r.row_index, r.key, r.window, r.n_tokens, r.first, r.last) for r in preparation.prepare_inputs(texts, str.split, " ".join, 5, 1, 1).orderBy("row_index").collect()]
    assert got == [(0, 1, 0, 3, 1, 1), (1, 2, 0, 4, 3, 4), (2, 2, 1, 4, 4, 5), (3, 2, 2, 3, 5, 5)]
    with pytest.raises(ValueError):
        preparation.prepare_inputs(texts, str.split, " ".join, 2, 1, 2)


def test_encoding(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    got = {r.id: r.vector for r in preparation.encoded(rows, "text", lambda ts: [[float(len(t)), 0.0] for t in ts], 2, "p: {text}").collect()}
    assert got == {1: [1.0, 0.0], 2: [1.0, 0.0]}
    with pytest.raises(Exception, match="values, not 3"):
        preparation.encoded(rows, "text", lambda ts: [[1.0, 0.0] for _ in ts], 3).collect()


def test_sheets_round_trip(spark):
    df = spark.createDataFrame([("# h\n\n## q1 x\nFIDELIDAD: Sí\nCORRECCION: partial\nNOTAS: a b\n\n## q2\nFIDELIDAD: quizá\nCORRECCION: bad\n",)], "text string")
    a, b = reports.parse_annotations(df).collect()
    assert (a.query_id, a.faithful, a.correctness, a.notes, a.warnings) == ("q1", True, "partial", "a b", [])
    assert (b.query_id, b.faithful, b.correctness, len(b.warnings)) == ("q2", None, "", 2)


def test_reports_and_artefacts(spark, tmp_path):
    folder = str(tmp_path / "run")
    m = [spark.createDataFrame([(1, 2.0)], "q int, b double"), spark.createDataFrame([(2, 3.0)], "q int, a double")]
    reports.write_report(spark, folder, {"pre_embedding_readiness": {"ready": True}}, m, per_query=m[0])
    assert reports.readiness_section(spark, f"{folder}/report") == {"ready": True} and reports.readiness_section(spark, f"{folder}/none") is None
    assert spark.read.option("header", True).csv(f"{folder}/metrics").columns == ["a", "b", "q"]
    schemas = {"parents": m[0].schema}
    reports.export_schemas(spark, schemas, str(tmp_path / "s"))
    assert reports.schema_drift(spark, schemas, str(tmp_path / "s")) == [] and reports.schema_drift(spark, {"parents": m[1].schema, "x": m[0].schema}, str(tmp_path / "s")) == ["parents", "x"]
    parents = spark.createDataFrame([("p", "d", "old"), ("r", "d", "t")], "parent_id string, document_id string, text string")
    reports.write_artefacts(str(tmp_path / "a"), parents=parents)
    back = reports.read_artefacts(spark, str(tmp_path / "a"), {"parents": parents.schema, "chunks": parents.schema})
    assert sorted(tuple(r) for r in back["parents"].collect()) == [("p", "d", "old"), ("r", "d", "t")] and back["chunks"].count() == 0
    assert [r.v for r in reports.first_by_priority([spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")], "k").orderBy("k").collect()] == ["a", "c"]
    assert reports.run_id("x", "0123456789").endswith("_01234567")


META = """<response><status><code>200</code></status><data><metadatos><identificador>BOE-A-2015-1</identificador><titulo> Ley   x </titulo><rango codigo="1">Ley</rango><numero_oficial>39/2015</numero_oficial>
<fecha_publicacion>20151002</fecha_publicacion><fecha_vigencia>x</fecha_vigencia><fecha_actualizacion>20200101T101112Z</fecha_actualizacion></metadatos>
<analisis><materias><materia codigo="7">Agua</materia></materias><notas><nota>n  1</nota></notas><referencias><anteriores><anterior><id_norma>BOE-A-1</id_norma><relacion codigo="3">DEROGA</relacion><texto>t</texto></anterior></anteriores></referencias></analisis>
<bloque><id>a1</id><titulo>Art. 1</titulo><fecha_actualizacion>20200101</fecha_actualizacion></bloque><bloque><id>a2</id><fecha_actualizacion>later</fecha_actualizacion></bloque></data></response>"""


def test_metadata_analysis_index(spark):
    files = spark.createDataFrame([("f", bytearray(META.encode())), ("bad", bytearray(b"<x>"))], "file string, content binary")
    m = {r.file: r for r in norms.parse_metadata(files).collect()}
    assert (m["f"].title, m["f"].short_title, m["f"].rank.code, m["f"].publication_date, m["f"].effective_date, m["f"].last_update, m["f"].scope) == ("Ley x", "Ley 39/2015", "1", "2015-10-02", None, "2020-01-01T10:11:12Z", None)
    assert m["bad"].error.startswith("invalid XML")
    a = norms.parse_analysis(files).where("file = 'f'").first()
    assert (a.subjects[0].label, a.notes, a.previous[0].relation.label, a.next) == ("Agua", ["n 1"], "DEROGA", [])
    i = norms.parse_index(files).where("file = 'f'").orderBy("order").collect()
    assert [(r.block_id, r.order, r.last_update, r.last_update_raw) for r in i] == [("a1", 0, "2020-01-01", "20200101"), ("a2", 1, None, "later")]


def test_titles(spark):
    kind = "k string, p array<struct<class:string,text:string>>"
    rows = [("encabezado", [("libro_num", "LIBRO I"), ("libro_tit", "De x"), ("parrafo", "z")]), ("encabezado", [("parrafo", "z"), ("libro_num", "LIBRO I")]), ("precepto", [("articulo", "Art. 1")]), ("precepto", [("seccion", "S")]), ("encabezado", []), ("encabezado", [("seccion", "S"), ("anexo", "A")])]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(artifacts.full_title(F.col("k"), F.col("p"))).collect()]
    assert got == ["LIBRO I. De x", None, "Art. 1", None, None, "S"]
    assert [r[0] for r in spark.createDataFrame([("", [("articulo", "Art."), ("p", "(Sin  contenido).")]), ("", [])], kind).select(artifacts.is_without_content(F.col("p"))).collect()] == [True, False]


def test_stored_index_and_unknown_names(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "unit_id long, tokens array<string>")
    asked = spark.createDataFrame([(1, ["b"])], "query_id long, tokens array<string>")
    index = postings.build(rows, str(tmp_path / "i"))
    stored = postings.search(postings.read(spark, str(tmp_path / "i")), asked)
    assert stored.collect() == postings.search(index, asked).collect() == retrieval.bm25_search(rows, asked).collect()
    with pytest.raises(ValueError):
        retrieval.active_filters(colour="red")
    with pytest.raises(ValueError):
        retrieval.strategies(["x"], {})
    with pytest.raises(Exception, match="blank query"):
        retrieval.checked_queries(spark.createDataFrame([(1, " ")], "query_id long, query string"), 1).collect()
