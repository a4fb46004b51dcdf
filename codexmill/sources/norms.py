"""Paragraphs of versioned norms in XML, in document order, with their role."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Classes of paragraphs that are notes, the opening of an editorial notice, and marks that may stand before it (fixed values).
NOTE_CLASSES = ("nota_pie", "nota_pie_2")
NOTICE = "téngase en cuenta"
NOTICE_MARKS = "(*)[]·•—-. \t"

SCHEMA = (
    "file string, block_id string, block_type string, block_title string, version int, norm_id string, published string, effective string, "
    "place int, class string, text string, role string, error string"
)


def _text(node: ElementTree.Element) -> str:
    return " ".join("".join(node.itertext()).split())


def _rows(table: ElementTree.Element) -> Iterator[tuple[str, str]]:
    """(class, line) of each table row that has text: cells with text, parted by ' | '."""
    for row in table.iter("tr"):
        cells = [c for c in row if c.tag in ("td", "th")]
        line = " | ".join(t for t in map(_text, cells) if t)
        if line:
            yield ("cabeza_tabla" if any(c.tag == "th" for c in cells) else "cuerpo_tabla_izq"), line


def paragraphs(node: ElementTree.Element, quoted: bool = False, tabled: bool = False) -> Iterator[tuple[str, str, str]]:
    """(class, text, role) below a version, depth first; role is kept, note or dropped. What a quote holds is dropped, notes
    apart; paragraphs in a table are told by its rows."""
    for child in node:
        inside = quoted or child.tag == "blockquote"
        if child.tag == "table":
            for css, line in _rows(child):
                yield css, line, "dropped" if quoted else "kept"
        elif child.tag == "p" and not tabled and (text := _text(child)):
            css = child.get("class") or ""
            note = css in NOTE_CLASSES or text.lstrip(NOTICE_MARKS).lower().startswith(NOTICE)
            yield css, text, "note" if note else "dropped" if quoted else "kept"
        yield from paragraphs(child, inside, tabled or child.tag == "table")


def parse(name: str, content: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA of one file. A file that is no XML or no answer with status 200 gives one row with an error."""
    blank = (None,) * 11
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError as e:
        yield (name, *blank, f"invalid XML: {e}")
        return
    if root.tag != "response" or (root.findtext("status/code") or "").strip() != "200" or root.find("data") is None:
        yield (name, *blank, "no answer with status 200 and data")
        return
    for block in root.iterfind("data/texto/bloque"):
        head = (name, block.get("id"), block.get("tipo"), block.get("titulo"))
        for n, version in enumerate(block.iterfind("version")):
            dated = (n, version.get("id_norma"), version.get("fecha_publicacion"), version.get("fecha_vigencia"))
            for place, found in enumerate(paragraphs(version)):
                yield (*head, *dated, place, *found, None)


def read_norms(spark: SparkSession, path: str) -> DataFrame:
    """All paragraphs of the XML files under a path, one row each; a file is read whole by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(path)
    return parse_norms(files.select(F.col("path").alias("file"), "content"))


def parse_norms(files: DataFrame) -> DataFrame:
    """The same of a table of files(file, content binary)."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["file"], frame["content"]):
                out = pd.DataFrame(list(parse(name, content or b"")), columns=names, dtype=object)
                yield out

    return files.select("file", "content").mapInPandas(run, SCHEMA)


#: Single-valued metadata tags and coded ones, by the names given to them (fixed values).
TEXT_TAGS = {
    "title": "titulo", "identifier": "identificador", "eli_url": "url_eli", "html_url": "url_html_consolidada", "official_number": "numero_oficial", "derogation_status": "estatus_derogacion",
    "annulment_status": "estatus_anulacion", "expired_validity": "vigencia_agotada",
}
CODED_TAGS = {"scope": "ambito", "department": "departamento", "rank": "rango", "consolidation_status": "estado_consolidacion"}
DATE_TAGS = {"publication_date": "fecha_publicacion", "document_date": "fecha_disposicion", "effective_date": "fecha_vigencia"}
_CODED = "struct<code:string,label:string>"
_REFERENCES = f"array<struct<target_norm_id:string,relation:{_CODED},text:string>>"
METADATA = ", ".join(["file string", *(f"{n} string" for n in TEXT_TAGS), *(f"{n} {_CODED}" for n in CODED_TAGS), *(f"{n} string" for n in DATE_TAGS), "last_update string", "error string"])
ANALYSIS = f"file string, subjects array<{_CODED}>, notes array<string>, previous {_REFERENCES}, next {_REFERENCES}, error string"
INDEX = "file string, block_id string, title string, last_update string, url string, order int, error string"


def _read(name: str, content: bytes) -> tuple[ElementTree.Element | None, str | None]:
    """(data, error) of one answer."""
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError as e:
        return None, f"invalid XML: {e}"
    if root.tag != "response" or (root.findtext("status/code") or "").strip() != "200" or root.find("data") is None:
        return None, "no answer with status 200 and data"
    return root.find("data"), None


def _tag(node: ElementTree.Element, tag: str) -> str | None:
    found = node.findtext(tag)
    return " ".join(found.split()) if found else None


def _coded(node: ElementTree.Element | None) -> dict | None:
    return None if node is None else {"code": node.get("codigo"), "label": " ".join((node.text or "").split())}


def _parsed(files: DataFrame, schema: str, one) -> DataFrame:
    """Rows of schema that `one` makes of each file's data; a file that cannot be read gives one row with its error."""
    names = [f.strip().split(" ")[0] for f in files.sparkSession.createDataFrame([], schema).columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["file"], frame["content"]):
                data, error = _read(name, content or b"")
                rows = [{}] if data is None else one(data)
                yield pd.DataFrame([{n: r.get(n) for n in names} | {"file": name, "error": error} for r in rows], columns=names, dtype=object)

    return files.select("file", "content").mapInPandas(run, schema)


def parse_metadata(files: DataFrame) -> DataFrame:
    """METADATA of files(file, content), dates in ISO form by their digits and short_title: rank and official number if both exist."""
    from codexmill.functions.text import normalize_date, normalize_datetime

    def one(data: ElementTree.Element) -> list[dict]:
        meta = data.find("metadatos")
        if meta is None:
            return [{}]
        plain = {n: _tag(meta, t) for n, t in TEXT_TAGS.items()} | {n: meta.findtext(t) for n, t in DATE_TAGS.items()}
        return [plain | {n: _coded(meta.find(t)) for n, t in CODED_TAGS.items()} | {"last_update": meta.findtext("fecha_actualizacion")}]

    rows = _parsed(files, METADATA, one)
    short = F.when((F.col("rank.label") != "") & (F.col("official_number") != ""), F.concat_ws(" ", "rank.label", "official_number"))
    return rows.withColumns({n: normalize_date(F.col(n)) for n in DATE_TAGS} | {"last_update": normalize_datetime(F.col("last_update")), "short_title": short})


def parse_analysis(files: DataFrame) -> DataFrame:
    """ANALYSIS of files(file, content); what is absent is an empty list."""

    def references(node: ElementTree.Element | None, tag: str) -> list[dict]:
        return [{"target_norm_id": _tag(r, "id_norma"), "relation": _coded(r.find("relacion")), "text": _tag(r, "texto") or ""} for r in (node.findall(tag) if node is not None else ())]

    def one(data: ElementTree.Element) -> list[dict]:
        found = data.find("analisis")
        if found is None:
            return [{"subjects": [], "notes": [], "previous": [], "next": []}]
        return [{
            "subjects": [_coded(m) for m in found.findall("materias/materia")], "notes": [" ".join((n.text or "").split()) for n in found.findall("notas/nota")],
            "previous": references(found.find("referencias/anteriores"), "anterior"), "next": references(found.find("referencias/posteriores"), "posterior"),
        }]

    return _parsed(files, ANALYSIS, one)


def parse_index(files: DataFrame) -> DataFrame:
    """INDEX of files(file, content), blocks numbered from 0 in document order; last_update_raw keeps the date as it stood."""
    from codexmill.functions.text import normalize_date

    def one(data: ElementTree.Element) -> list[dict]:
        return [{"block_id": _tag(b, "id") or "", "title": _tag(b, "titulo"), "last_update": _tag(b, "fecha_actualizacion"), "url": _tag(b, "url"), "order": i} for i, b in enumerate(data.findall("bloque"))]

    return _parsed(files, INDEX, one).withColumn("last_update_raw", F.col("last_update")).withColumn("last_update", normalize_date(F.col("last_update")))


def suspicious_drops(rows: DataFrame) -> DataFrame:
    """(file, block_id, version, class, n) of dropped paragraphs whose class says that they are no quote."""
    from codexmill.operators.artifacts import suspicious_quote_class

    return rows.where((F.col("role") == "dropped") & suspicious_quote_class(F.col("class"))).groupBy("file", "block_id", "version", "class").agg(F.count("*").alias("n"))
