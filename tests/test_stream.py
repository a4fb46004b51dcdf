"""The stream of a norm's events against a walk of its tree, and the editorial audit against a loop."""

import random
import tracemalloc
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from codexmill.operators import audit
from codexmill.sources import norms, stream

CSS = ["parrafo", "articulo", "titulo_num", "nota_pie", "cita", ""]


def some_xml(rng, depth=0):
    parts = []
    for _ in range(rng.randint(0, 4)):
        kind = rng.choice(["p", "p", "blockquote", "table", "div", "text"])
        if kind == "text":
            parts.append(rng.choice(["loose ", "\n", "x"]))
        elif kind == "p":
            css = rng.choice(CSS)
            body = rng.choice(["Uno dos", " ", "(*) Téngase en cuenta que", "a<b>negra</b> c", "x &lt; y", "a<p>dentro</p>z", "t<table><tr><td>en p</td></tr></table>u"])
            parts.append(f'<p class="{css}">{body}</p>' if css else f"<p>{body}</p>")
        elif depth < 4:
            parts.append(f"<{kind}>{some_xml(rng, depth + 1)}</{kind}>" if kind != "table" else f"<table>{some_rows(rng, depth + 1)}</table>")
    return "".join(parts)


def some_rows(rng, depth):
    out = []
    for _ in range(rng.randint(0, 3)):
        cells = "".join(f"<{t}>{rng.choice(['', 'celda una', '12', '<p>con p</p>', some_xml(rng, depth + 1)])}</{t}>" for t in rng.choices(["td", "th"], k=rng.randint(0, 3)))
        row = f"<tr>{cells}</tr>"
        out.append(rng.choice([row, row, f"<blockquote>{row}</blockquote>", f"<tbody>{row}</tbody>"]))
    return "".join(out)


def norm(blocks):
    made = "".join(f'<bloque id="{b}" tipo="precepto" titulo="t">' + "".join(f'<version id_norma="{n}" fecha_publicacion="{d}">{body}</version>' for n, d, body in versions) + "</bloque>" for b, versions in blocks)
    return f"<response><status><code>200</code></status><data><texto>{made}</texto></data></response>".encode()


def cells_by_tree(version):
    quoted = {id(x) for q in version.iter("blockquote") for x in q.iter()}
    return [(c.tag, norms._text(c)) for c in version.iter() if c.tag in ("td", "th") and id(c) not in quoted and c.find(".//p") is None]


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_events_against_a_tree(monkeypatch, piece):
    monkeypatch.setattr(stream, "PIECE", piece)
    rng = random.Random(8)
    for _ in range(400 if piece > 7 else 60):
        content = norm([("a", [("N", "20200101", some_xml(rng)), ("M", "20210101", some_xml(rng))]), ("b", [])])
        got = list(stream.fold("f", content))
        assert [r for r in got if r[9]] == []
        want = [(r[1], r[4], r[9], r[10], r[11]) for r in norms.parse("f", content)]
        assert [(r[1], r[2], r[6], r[7], r[8]) for r in got if r[8] not in ("block", "version", "cell")] == want, content
        assert [r[1] for r in got if r[8] == "block"] == ["a", "b"] and [(r[1], r[3]) for r in got if r[8] == "version"] == [("a", "N"), ("a", "M")]
        trees = ElementTree.fromstring(content).findall("data/texto/bloque/version")
        for n, tree in enumerate(trees):
            assert sorted((r[6], r[7]) for r in got if r[8] == "cell" and r[2] == n) == sorted(cells_by_tree(tree)), content


@pytest.mark.parametrize("content, error", [(b"", "invalid XML"), (b"<response><a>", "invalid XML"), (b"<x/>", "no answer"), (b"<response><status><code>404</code></status><data/></response>", "no answer"), (b"<response><status><code>200</code></status></response>", "no answer")])
def test_errors_are_rows(spark, content, error):
    (row,) = stream.stream_norms(spark.createDataFrame([("f", content)], "file string, content binary")).collect()
    assert row.error.startswith(error) and row.role is None
    assert stream.stream_norms(spark.createDataFrame([("f", None)], "file string, content binary")).count() == 1
    assert stream.stream_norms(spark.createDataFrame([], "file string, content binary")).count() == 0


def test_memory_does_not_follow_the_norm():
    """Twenty times the norm, in one block, one table: the state stays as it is."""
    peaks = []
    for n in (2_000, 40_000):
        body = "<table>" + "<tr><td>celda de la tabla</td><td>otra</td></tr>" * n + "</table>" + "<p class='parrafo'>Un párrafo.</p>" * n
        content = norm([("a", [("N", "20200101", body)])])
        tracemalloc.start()
        rows = sum(1 for _ in stream.fold("f", content))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == 2 + 4 * n
    assert peaks[1] < 60 << 20  # a tree of the larger norm takes over 100 MB; pieces of 1 MB hold some 100,000 row tuples


STORED = "document_id string, block_id string, index_date string, latest struct<publication_date:string,source_norm_id:string,text:string,paragraphs:array<struct<class:string,text:string>>>"


def test_editorial_audit(spark):
    p = lambda *texts: "".join(f"<p class='parrafo'>{t}</p>" for t in texts)
    quote = "<blockquote><p class='articulo'>Viejo</p><p>b</p><p>c</p></blockquote>"
    blocks = {
        "ok": p("uno", "dos") + "<p class='nota_pie'>nota</p>", "leak": p("uno") + "<blockquote>" + p("viejo") + "</blockquote>", "over": p("uno", "dos"), "changed": p("uno", "dos", "tres"), "quotes": p("uno") + quote,
        "cells": p("uno") + "<table><tr><th>Cabeza</th><td>celda perdida</td><td>1234</td><td>abc</td></tr></table>", "none": "", "disputed": p("uno"),
    }
    content = norm([(b, [("N", "20200101", body), ("M", "20190101", p("otro"))]) for b, body in blocks.items()])
    raw = stream.stream_norms(spark.createDataFrame([("D", content), ("BAD", b"<x")], "file string, content binary")).withColumnRenamed("file", "document_id")
    latest = lambda *texts, norm="N": ("2020-01-01", norm, " ".join(texts), [("parrafo", t) for t in texts])
    row = "Cabeza | celda perdida | 1234 | abc"
    stored = [("D", "ok", latest("uno", "dos")), ("D", "leak", latest("uno", "viejo")), ("D", "over", latest("uno")), ("D", "changed", latest("uno", "DOS", "tres")), ("D", "quotes", latest("uno")), ("D", "none", latest()), ("D", "disputed", latest("x", norm="M")), ("D", "gone", latest("x")), ("D", "held", None), ("BAD", "ok", latest("x"))]
    stored = [(d, b, "2020-01-01", x) for d, b, x in stored] + [("D", "cells", "2020-01-01", ("2020-01-01", "N", "uno", [("parrafo", "uno"), ("cabeza_tabla", row)]))]
    state = audit.editorial_state(raw, spark.createDataFrame(stored, STORED)).cache()
    got = sorted((r.ref, r.check_name.removeprefix("block."), r.evidence or "", r.severity) for r in audit.editorial_findings(state).collect())
    assert got == sorted([
        ("leak", "editorial_invariant", "None | viejo", "ERROR"), ("over", "editorial_invariant", "dos | None", "ERROR"), ("changed", "editorial_invariant", "dos | DOS", "ERROR"), ("gone", "editorial_invariant", "", "ERROR"),
        ("quotes", "editorial_drop_structural", "Viejo", "WARN"), ("quotes", "editorial_drop_fraction", "Viejo", "WARN"), ("cells", "table_cell_dropped", "celda perdida | Cabeza", "ERROR"),
    ])
    records = {r.block_id: r for r in audit.drop_records(state).collect()}
    assert set(records) == {"leak", "quotes"} and records["quotes"].dropped_classes == {"articulo": 1, "": 2} and records["quotes"].anomaly == ["high_fraction", "structural_class"]
    assert records["quotes"].dropped_fraction == 0.75 and records["leak"].anomaly == [] and state.where(F.col("block_id") == "ok").first().n_notes == 1
