"""Norms in XML read as a stream of events: paragraphs, table rows and loose cells of every version, without a tree."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.sources.norms import NOTE_CLASSES, NOTICE, NOTICE_MARKS

#: Where versions stand in an answer (fixed names); bytes given to the parser and rows sent on at a time.
_PLACE = ["response", "data", "texto", "bloque", "version"]
PIECE, BATCH = 1 << 20, 4_096
SCHEMA = "file string, block_id string, version int, norm_id string, published string, place long, class string, text string, role string, error string"
_KINDS = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]


class _Text:
    """Text of an open element, and what is to be said of it once it ends."""

    def __init__(self, tag: str, css: str, quoted: bool) -> None:
        self.tag, self.css, self.quoted, self.parts, self.holds_p = tag, css, quoted, [], False

    def words(self) -> str:
        return " ".join("".join(self.parts).split())


class _Row:
    """A table row: the texts of its own cells, known when it ends."""

    def __init__(self) -> None:
        self.cells, self.open = [], True

    def line(self) -> tuple[str, str] | None:
        text = " | ".join(t for t in (c.words() for c in self.cells) if t)
        return (("cabeza_tabla" if any(c.tag == "th" for c in self.cells) else "cuerpo_tabla_izq"), text) if text else None


class _Table:
    def __init__(self, quoted: bool) -> None:
        self.quoted, self.rows, self.nested, self.open = quoted, [], [], True


class _Version:
    """The state between the start and the end of a version. What has begun waits in `slots` until all before it has ended."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, object]] = []
        self.slots: list = []
        self.tables: list[_Table] = []
        self.quotes = 0
        self.collecting: list[_Text] = []

    def start(self, tag: str, css: str) -> None:
        held = None
        if tag == "blockquote":
            self.quotes += 1
        elif tag == "table":
            held = _Table(self.quotes > 0)
            (self.tables[0].nested if self.tables else self.slots).append(held)
            self.tables.append(held)
        elif tag == "p":
            for c in self.collecting:
                c.holds_p = True
            if not self.tables:
                held = _Text(tag, css, self.quotes > 0)
                self.slots.append(held)
                self.collecting.append(held)
        elif tag == "tr" and self.tables:
            held = _Row()
            for t in self.tables:
                t.rows.append(held)
        elif tag in ("td", "th"):
            held = _Text(tag, css, self.quotes > 0)
            self.collecting.append(held)
            if self.stack and isinstance(self.stack[-1][1], _Row):
                self.stack[-1][1].cells.append(held)
        self.stack.append((tag, held))

    def end(self) -> Iterator[tuple[str, str, str]]:
        """(class, text, role) of what is known now, in document order; loose cells as they end."""
        tag, held = self.stack.pop()
        if tag == "blockquote":
            self.quotes -= 1
        elif isinstance(held, _Text):
            self.collecting.remove(held)
            if held.tag == "p":
                held.done = True
            elif not held.quoted and not held.holds_p:
                yield held.tag, held.words(), "cell"
        elif isinstance(held, _Row):
            held.open = False
        elif isinstance(held, _Table):
            self.tables.pop()
            held.open = False
        if tag in ("p", "tr", "table"):
            yield from self.ready()

    def ready(self) -> Iterator[tuple[str, str, str]]:
        while self.slots:
            first = self.slots[0]
            if isinstance(first, _Text):
                if not getattr(first, "done", False):
                    return
                text = first.words()
                if text:
                    note = first.css in NOTE_CLASSES or text.lstrip(NOTICE_MARKS).lower().startswith(NOTICE)
                    yield first.css, text, "note" if note else "dropped" if first.quoted else "kept"
            else:
                yield from self._lines(first)
                if first.open or first.rows:
                    return
                for inner in first.nested:
                    yield from self._lines(inner)
            self.slots.pop(0)

    @staticmethod
    def _lines(table: _Table) -> Iterator[tuple[str, str, str]]:
        """Rows that have ended, up to the first that has not; they leave the table."""
        ended = next((i for i, r in enumerate(table.rows) if r.open), len(table.rows))
        for line in filter(None, (r.line() for r in table.rows[:ended])):
            yield *line, "dropped" if table.quoted else "kept"
        del table.rows[:ended]


class _Failed(Exception):
    pass


def fold(name: str, content: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA of one file, in document order within a version; role is block or version (marks without text, one for each),
    kept, note, dropped, or cell: a cell's whole text where neither a quote nor a paragraph is around or in it.

    Memory holds what is open: a paragraph, a row, and tables inside a table; never a tree. A file that is no XML, or no answer
    with status 200 and data, gives a row with an error, last, whatever came before it."""
    out: list[tuple] = []
    path: list[str] = []
    state: dict = {"version": None, "block": None, "number": -1, "status": [], "data": False, "place": 0, "head": (None, None, None, None)}

    def emit(css, text, role) -> None:
        out.append((name, *state["head"], state["place"], css, text, role, None))
        state["place"] += 1

    def start(tag: str, attributes: dict) -> None:
        path.append(tag)
        if state["version"] is not None:
            state["version"].start(tag, attributes.get("class") or "")
        elif path == _PLACE[:1] or len(path) == 1:
            if tag != _PLACE[0]:
                raise _Failed("no answer with status 200 and data")
        elif path == _PLACE[:2]:
            state["data"] = True
        elif path == _PLACE[:4]:
            state["block"], state["number"] = attributes.get("id"), -1
            out.append((name, state["block"], None, None, None, None, attributes.get("tipo"), attributes.get("titulo"), "block", None))
        elif path == _PLACE:
            state["number"] += 1
            state["version"], state["place"] = _Version(), 0
            state["head"] = (state["block"], state["number"], attributes.get("id_norma"), attributes.get("fecha_publicacion"))
            out.append((name, *state["head"], None, None, attributes.get("fecha_vigencia"), "version", None))

    def end(tag: str) -> None:
        if path == _PLACE:
            state["version"] = None
        elif state["version"] is not None:
            for found in state["version"].end():
                emit(*found)
        path.pop()

    def text(data: str) -> None:
        if state["version"] is not None:
            for held in state["version"].collecting:
                held.parts.append(data)
        elif path == ["response", "status", "code"]:
            state["status"].append(data)

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    error = None
    try:
        for at in range(0, max(len(content), 1), PIECE):
            parser.Parse(content[at : at + PIECE], at + PIECE >= len(content))
            yield from out
            out.clear()
        if "".join(state["status"]).strip() != "200" or not state["data"]:
            error = "no answer with status 200 and data"
    except expat.ExpatError as e:
        error = f"invalid XML: {e}"
    except _Failed as e:
        error = str(e)
    yield from out
    if error:
        yield (name, *[None] * 8, error)


def stream_norms(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA of files(file, content binary); a task holds one file's bytes and BATCH rows. Null content is no XML."""
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held = []
                for row in fold(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""):
                    held.append(row)
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), _KINDS)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), _KINDS)], names)

    return files.select(F.col("file").cast("string"), "content").mapInArrow(run, SCHEMA)
