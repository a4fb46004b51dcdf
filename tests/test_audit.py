"""Rules of the audit on norms made for them."""

import pytest

from codexmill.operators import audit

BLOCK = (
    "document_id string, block_id string, order int, block_type string, semantic_role string, is_annex boolean, parent_id string, html_url string, source_url string, indexable boolean,"
    " hierarchy struct<book:string,title:string,chapter:string,section:string,subsection:string,annex:string>, index_date string,"
    " versions array<struct<publication_date:string,source_norm_id:string,is_latest:boolean,text:string>>,"
    " latest struct<publication_date:string,source_norm_id:string,validity_date:string,text:string,paragraphs:array<struct<class:string,text:string>>,modification_notes:array<struct<text:string>>>"
)
NONE = (None,) * 6


def block(**change):
    good = {
        "document_id": "D", "block_id": "a1", "order": 1, "block_type": "precepto", "semantic_role": "precept", "is_annex": False, "parent_id": "D__a1", "html_url": "h", "source_url": "h#a1", "indexable": True,
        "hierarchy": NONE, "index_date": "2020-01-01", "versions": [("2020-01-01", "N", True, None)], "latest": ("2020-01-01", "N", "2020-01-02", "Texto", [("parrafo", "Texto")], []),
    }
    return tuple((good | change).values())


def checks(spark, rows, rules=None):
    found = audit.audit_blocks(spark.createDataFrame(rows, BLOCK), "2021-01-01", rules).collect()
    return sorted((r.check_name.removeprefix("block."), r.ref, r.evidence) for r in found)


CASES = {
    "clean": ({}, []),
    "held back": ({"index_date": None, "latest": None, "indexable": False}, [("temporal_quarantine", "a1", "missing_index_date")]),
    "not held back": ({"index_date": "2019-01-01"}, [("temporal_inconsistent", "a1", None), ("temporal_quarantine", "a1", "unresolved")]),
    "two on a day": ({"versions": [("2020-01-01", "N", True, None), ("2020-01-01", "M", False, None)], "latest": None, "indexable": False}, [("temporal_quarantine", "a1", "ambiguous")]),
    "not the newest": ({"versions": [("2020-01-01", "N", True, None), ("2020-05-01", "M", False, None)], "latest": None, "indexable": False}, [("temporal_quarantine", "a1", "index_not_max")]),
    "wrong version": ({"latest": ("2018-01-01", "N", None, "T", [("parrafo", "T")], None)}, [("temporal_mismatch", "a1", "2018-01-01 != 2020-01-01")]),
    "from tomorrow": ({"latest": ("2020-01-01", "N", "2022-01-01", "T", [("parrafo", "T")], None)}, [("future_effective", "a1", None)]),
    "no versions": ({"versions": [], "index_date": None}, []),
    "null versions": ({"versions": None, "index_date": None}, []),
    "no latest mark": ({"versions": [("2020-01-01", "N", None, None)]}, [("is_latest", "a1", None)]),
    "texts in versions": ({"versions": [("2020-01-01", "N", True, "t")]}, [("versions_metadata", "a1", None)]),
    "no parent": ({"parent_id": None}, []),
    "no type": ({"block_type": None}, [("type", "a1", None)]),
    "a label indexed": ({"block_type": "encabezado", "semantic_role": "structural_heading", "latest": ("2020-01-01", "N", None, "T", [("titulo_num", "T")], [])}, [("indexable", "a1", None), ("structural_indexed", "a1", None)]),
    "a body left out": ({"block_type": "encabezado", "semantic_role": "structural_heading", "indexable": None}, [("heading_body_not_indexed", "a1", None), ("indexable", "a1", None), ("semantic_role", "a1", None)]),
    "annex": ({"block_type": "encabezado", "semantic_role": "annex", "is_annex": True}, [("annex_local_context_missing", "a1", None)]),
    "annex of another role": ({"block_type": "encabezado", "semantic_role": "content_heading", "is_annex": True, "hierarchy": ("L", None, None, None, None, "A")}, [("annex_dragged", "a1", None), ("semantic_role", "a1", None)]),
    "tags": ({"latest": ("2020-01-01", "N", None, "a <b> c < d", [("parrafo", "T")], [])}, [("text_tags", "a1", None)]),
    "no tags": ({"latest": ("2020-01-01", "N", None, "agudeza <P20 o menor < que", [("parrafo", "T")], [])}, []),
    "two notes": ({"latest": ("2020-01-01", "N", None, "x nota y otra", [("parrafo", "T")], [(" nota\n",), ("otra",), ("",), (None,), ("ajena",)])}, [("note_leak", "a1", "nota"), ("note_leak", "a1", "otra")]),
    "formula": ({"latest": ("2020-01-01", "N", None, "x REDACCIÓN anterior : y", [("parrafo", "T")], [])}, [("editorial_leak", "a1", "REDACCIÓN anterior :")]),
    "prose": ({"latest": ("2020-01-01", "N", None, "la redacción anterior sigue", [("parrafo", "T")], [])}, []),
    "no address": ({"html_url": None, "source_url": None}, []),
    "wrong address": ({"source_url": None}, [("source_url", "a1", None)]),
}


@pytest.mark.parametrize("name", CASES)
def test_block_rules(spark, name):
    change, want = CASES[name]
    assert checks(spark, [block(**change)]) == want


def test_repeated_and_no_rows(spark):
    assert checks(spark, []) == []
    assert checks(spark, [block(block_type="x")] * 2) == [("type", "a1", None)] * 2


def state_by_loop(rows):
    levels, now, out = list(audit.LEVELS), dict.fromkeys(audit.LEVELS), []
    for kind, paragraphs in rows:
        if kind == "encabezado" and paragraphs is not None:
            texts = dict(paragraphs)
            for k, level in enumerate(levels):
                if audit.LEVELS[level] in texts:
                    closed = levels[k + 1 :] if level != "annex" else levels[:-1]
                    now = {x: None if x in closed else v for x, v in now.items()} | {level: texts[audit.LEVELS[level]]}
                    break
        out.append(tuple(now.values()))
    return out


def test_heading_state_against_a_loop(spark):
    import random

    rng, css = random.Random(3), [*audit.LEVELS.values(), "titulo_tit", "parrafo"]
    rows = [(rng.choice(["encabezado", "encabezado", "precepto"]), None if rng.random() < 0.1 else [(rng.choice(css), f"t{i}.{j}") for j in range(rng.randint(0, 3))]) for i in range(120)]
    made = [block(document_id=f"D{i // 60}", block_id=str(i), order=i, block_type=kind, latest=None if p is None else ("2020-01-01", "N", None, "T", p, [])) for i, (kind, p) in enumerate(rows)]
    df = spark.createDataFrame(made, BLOCK).repartition(4)
    got = {r.block_id: tuple(r.recomputed) for r in audit.with_hierarchy(df).collect()}
    want = [*state_by_loop(rows[:60]), *state_by_loop(rows[60:])]
    assert [got[str(i)] for i in range(120)] == want
    right = [row[:10] + (want[i],) + row[11:] for i, row in enumerate(made)]
    assert checks(spark, right, audit.HIERARCHY_RULES) == []
    wrong = [*right[:5], right[5][:10] + (("other", *want[5][1:]),) + right[5][11:]]
    assert checks(spark, wrong, audit.HIERARCHY_RULES) == [("hierarchy_stale", "5", want[5][0])]


def test_document_rules(spark):
    kind = "document_id string, schema_version string, keys array<string>, manifest_ref string, metadata struct<identifier:string,publication_date:string,document_date:string,effective_date:string,last_update_datetime:string>"
    keys = list(audit.DOCUMENT_KEYS)
    rows = [
        ("A", audit.SCHEMA_VERSION, keys, "data/m.json", ("A", "2020-01-01", None, "", "2020-01-01T00:00:00Z")),
        ("B", None, keys[1:], "/abs/m.json", ("X", "20200101", "2020-1-1", None, "2020-01-01")),
        ("C", "v1", keys, "c:m.json", (None, None, None, None, None)),
        (None, audit.SCHEMA_VERSION, keys, None, ("A", None, None, None, None)),
    ]
    found = audit.audit_documents(spark.createDataFrame(rows, kind)).collect()
    got = sorted((r.document_id or "", r.check_name, r.ref or "", r.severity) for r in found)
    assert got == sorted(
        [("B", "doc.schema", "", "ERROR"), ("B", "doc.keys", "", "ERROR"), ("B", "doc.identity", "", "ERROR"), ("B", "doc.date", "publication_date", "WARN"), ("B", "doc.date", "document_date", "WARN")]
        + [("B", "doc.date", "last_update_datetime", "WARN"), ("B", "doc.manifest_ref", "", "ERROR"), ("C", "doc.schema", "", "ERROR"), ("C", "doc.manifest_ref", "", "ERROR"), ("", "doc.identity", "", "ERROR")]
    )
    assert all(r.classification == audit.REVIEW and r.message for r in found)
