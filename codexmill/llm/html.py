"""HTML extraction by layout: a tree with implied tags, visibility rules, and rendering with block spacing, lists and tables."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never shown.
UNSEEN = frozenset("head script style template noscript iframe datalist audio video canvas title annotation annotation-xml".split())
#: Of a drawing only these are read.
_DRAWN = frozenset(["text", "title", "foreignobject"])
#: Marks between the parts of a formula that stand above each other.
_STACKED = {"mfrac": "/", "msup": "^", "msub": "_"}
#: Void elements of a head.
_HEAD = frozenset("base link meta".split())
#: Elements on lines of their own; those in SPACED have a blank line around them.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr".split())
#: A start tag of the first ends an open element of the second, up to the nearest of the third.
_CLOSES_P = BLOCK - frozenset("html body dd dt li tr tbody thead tfoot".split())
_IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "datalist"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tr", "td", "th"]), frozenset(["table"])),
}
#: What an end tag does not reach across.
_WALLS = frozenset(["td", "th", "table", "caption"])
_TABULAR = frozenset("table tr tbody thead tfoot td th".split())
#: Lists, quotes and tables in more than so many others are laid out as plain blocks; their text and visibility stay the same.
LEVELS = 40
#: Lines of a cell with another one after it are broken at spaces to this length, as a browser breaks them.
CELL = 60
#: Modes of rendering, with the level of nesting above them: white space is kept; text is not shown.
_PRE, _VEILED, _LEVEL = 1, 2, 4
_SPACES = re.compile(r"[ \t\n\r\f]+")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: Selectors that style rules are read of: an element, a class or an id, or an element with one of them.
_SELECTOR = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children", "shown")

    def __init__(self, tag: str, attrs: dict) -> None:
        self.tag, self.attrs, self.children, self.shown = tag, attrs, [], ""


class TreeBuilder(HTMLParser):
    """Builds a tree from tags as they come: ends implied elements, ignores stray end tags, closes what is left open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each name, in self.open

    def _last(self, names: frozenset) -> int:
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def _push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.open))
        self.open.append(node)

    def _pop_to(self, size: int) -> None:
        while len(self.open) > size:
            self.places[self.open.pop().tag].pop()

    def _end_implied(self, names: frozenset, walls: frozenset) -> None:
        """Ends the named elements above the last wall; of paragraphs only the last."""
        wall = self._last(walls)
        if names == frozenset(["p"]):
            at = [k for k in self.places["p"][-1:] if k > wall]
        else:
            at = [held[k] for held in (self.places[n] for n in names) if (k := bisect_right(held, wall)) < len(held)]
        if at:
            self._pop_to(min(at))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSES_P:
            self._end_implied(frozenset(["p"]), _WALLS)
        if tag in _IMPLIED:
            self._end_implied(*_IMPLIED[tag])
        if tag in ("body", "html") and self.open[-1].tag == "head":
            self._pop_to(len(self.open) - 1)
        elif self.open[-1].tag == "head" and tag not in UNSEEN and tag not in _HEAD:
            self._pop_to(len(self.open) - 1)
        if tag == "html":
            return
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self._push(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and (self.places["svg"] or self.places["math"]):
            self._pop_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
            return
        at = self._last(frozenset([tag]))
        if at and (tag in _TABULAR or at > self._last(_WALLS - {tag})):
            self._pop_to(at)

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._pop_to(len(self.open) - 1)
        self.open[-1].children.append(data)


def _declared(style: str) -> dict[str, str]:
    """The last values of display and visibility in a list of declarations."""
    return {name.lower(): value.lower() for name, value in _DECLARED.findall(style)}


class Sheet:
    """Style rules of a page that set display or visibility for an element, a class or an id. Rules in at-blocks (media, and
    so on) and of other selectors are not read; an id outdoes a class, a class an element's name, and a later rule an earlier one."""

    def __init__(self, css: str) -> None:
        self.rules: dict[tuple[str, str, str], dict[str, str]] = {}
        depth, at, head = 0, 0, ""
        css = _COMMENT.sub(" ", css)
        for brace in re.finditer(r"[{}]", css):
            if brace[0] == "{":
                if depth == 0:
                    head = css[at : brace.start()].rpartition(";")[2]
                depth += 1
            elif depth:
                depth -= 1
                if depth == 0 and not head.strip().startswith("@"):
                    self._add(head, css[at : brace.start()])
            at = brace.end()

    def _add(self, head: str, body: str) -> None:
        found = _declared(body)
        for selector in head.split(",") if found else ():
            parts = _SELECTOR.fullmatch(selector.strip())
            if parts and parts[0]:
                key = ((parts[1] or "").lower(), parts[2] or "", parts[3] or "")
                self.rules[key] = self.rules.pop(key, {}) | found

    def of(self, node: Node) -> dict[str, str]:
        """The values that hold for a node by rules and its own style."""
        found: dict[str, str] = {}
        if self.rules:
            names = [("", "")] + [(".", c) for c in str(node.attrs.get("class") or "").split()] + [("#", str(node.attrs.get("id") or ""))]
            order = {key: k for k, key in enumerate(self.rules)}
            keys = {(tag, kind, name) for kind, name in names for tag in ("", node.tag)} & order.keys()
            for key in sorted(keys, key=lambda k: (k[1] == "#", k[1] == ".", k[0] != "", order[k])):
                found |= self.rules[key]
        style = node.attrs.get("style")
        return found | _declared(style) if style else found


def _settle(root: Node) -> None:
    """Sets `shown` of all nodes: None if the node is left out with all it holds, else what it says of visibility (True, False) or "" if nothing."""
    css, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag == "style":
            css.append("".join(c for c in node.children if isinstance(c, str)))
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    sheet = Sheet("\n".join(css))
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag in UNSEEN or "hidden" in node.attrs or node.tag == "input":
            node.shown = None
        elif sheet.rules or "style" in node.attrs:
            found = sheet.of(node)
            node.shown = None if found.get("display") == "none" else "" if "visibility" not in found else found["visibility"] == "visible"
        if node.tag == "details" and "open" not in node.attrs:
            node.children = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
        stack += [c for c in node.children if isinstance(c, Node)]


def hidden(node: Node) -> bool:
    return node.shown is None


class _Page:
    """Lines so far; white space collapses, breaks add up to the larger one."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks, self.space, self.fresh = 0, False, True

    def gap(self, lines: int) -> None:
        self.breaks, self.space = max(self.breaks, lines), False

    def flush(self) -> None:
        if self.breaks and not self.fresh:
            self.parts.append("\n" * self.breaks)
        elif self.space and not self.fresh:
            self.parts.append(" ")
        self.breaks, self.space, self.fresh = 0, False, False

    def text(self, s: str) -> None:
        flat = _SPACES.sub(" ", s)
        body = flat.strip(" ")
        if not body:
            self.space = self.space or (bool(flat) and not self.breaks)
            return
        if flat[0] == " ":
            self.space = not self.breaks
        self.flush()
        self.parts.append(body)
        self.space = flat[-1] == " "

    def raw(self, s: str) -> None:
        self.flush()
        self.parts.append(s)

    def kept(self, s: str) -> None:
        """Text of a pre element: line feeds at its end become breaks, which end with the text around it."""
        body = s.replace("\r\n", "\n")
        lead = len(body) - len(body.lstrip("\n"))
        body = body.strip("\n")
        if lead or not body:
            self.breaks, self.space = self.breaks + lead, False
        if body:
            self.flush()
            self.parts.append(body)
            self.breaks = len(s.replace("\r\n", "\n")) - lead - len(body)

    def result(self) -> str:
        return "".join(self.parts)


def _indented(text: str, mark: str) -> str:
    pad = " " * len(mark)
    return mark + "\n".join(x if not k or not x else pad + x for k, x in enumerate(text.split("\n")))


def _done(step):
    """The value of a generator that yields the generators whose values it needs; nesting takes no Python frames."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def _rendered(nodes: list, mode: int = 0):
    page = _Page()
    yield _render(nodes, page, mode)
    return page.result()


def _render(nodes: list, page: _Page, outer: int):
    for node in nodes:
        mode = outer
        if isinstance(node, str):
            if mode & _VEILED:
                continue
            if not mode & _PRE:
                page.text(node)
            else:
                page.kept(node)
            continue
        tag = node.tag
        if hidden(node):
            continue
        if node.shown != "":
            mode = mode & ~_VEILED if node.shown else mode | _VEILED
        if tag == "br":
            page.breaks += 1
            page.space = False
            continue
        if tag == "img":
            continue
        if tag == "hr":
            page.gap(2)
            continue
        if tag == "svg":
            for part in _parts(node, _DRAWN, frozenset(["defs"])):
                page.space = True
                yield _render(part.children, page, mode & ~_PRE)
                page.space = True
            continue
        if tag == "select":
            if mode & _VEILED:
                continue
            options = _options(node)
            for option in options:
                if len(options) > 1:
                    page.gap(1)
                page.text(str(option.attrs.get("label") or (yield _rendered(option.children))))
            page.gap(1 if len(options) > 1 else 0)
            continue
        if tag in _STACKED:
            for k, part in enumerate(x for x in node.children if isinstance(x, Node)):
                if k and not mode & _VEILED:
                    page.space = False
                    page.text(_STACKED[tag])
                yield _render([part], page, mode & ~_PRE)
            continue
        around = 2 if tag in SPACED else 1 if tag in BLOCK else 0
        if around:
            page.gap(around)
        deep = mode >= LEVELS * _LEVEL
        if tag in ("ul", "ol", "menu") and not deep:
            yield _list(node, page, mode)
        elif tag == "table" and not deep:
            yield _table(node, page, mode)
        elif tag in ("blockquote", "dd") and not deep:
            inner = yield _rendered(node.children, mode + _LEVEL)
            if inner:
                page.raw(_indented(inner, "  " if tag == "blockquote" else "    "))
        elif tag == "q" and not mode & _VEILED:
            page.text("“")
            page.space = False
            yield _render(node.children, page, mode)
            page.space = False
            page.text("”")
        else:
            inner = node.children
            if tag in ("pre", "textarea") and inner and isinstance(inner[0], str):  # the line feed after the start tag is none
                inner = [re.sub(r"^\r?\n", "", inner[0]), *inner[1:]]
            yield _render(inner, page, mode | _PRE if tag in ("pre", "textarea") else mode)
            if deep and tag in ("td", "th"):
                page.space = True
        if around:
            page.gap(around)


def _parts(node: Node, wanted: frozenset, unseen: frozenset) -> list[Node]:
    """The outermost wanted elements under a node, in order."""
    out: list[Node] = []
    stack = list(reversed(node.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str) or child.tag in unseen or (hidden(child) and child.tag not in wanted) or "hidden" in child.attrs:
            continue
        if child.tag in wanted:
            if child.tag == "title" or not hidden(child):
                out.append(child)
        else:
            stack += reversed(child.children)
    return out


def _options(node: Node) -> list[Node]:
    """The options that a select shows: all of a list box, else the last one selected, else the first."""
    options = _parts(node, frozenset(["option"]), frozenset())
    size = str(node.attrs.get("size") or "1")
    if "multiple" in node.attrs or (re.fullmatch(r"\d{1,9}", size) and int(size) > 1):
        return options
    chosen = [o for o in options if "selected" in o.attrs]
    return chosen[-1:] or [o for o in options if "disabled" not in o.attrs][:1] or options[:1]


def _list(node: Node, page: _Page, mode: int):
    start = str(node.attrs.get("start") or "1")
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            if hidden(child):
                continue
            veil = mode if child.shown == "" else mode & ~_VEILED if child.shown else mode | _VEILED
            inner = yield _rendered(child.children, veil + _LEVEL)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            if inner:
                page.gap(1)
                page.raw(_indented(inner, mark))
                page.gap(1)
        else:
            yield _render([child], page, mode)


def _rows(table: Node, mode: int) -> tuple[list[list[tuple[Node, int]]], list]:
    """(rows of cells, each with the mode around it, what stands outside of cells)."""
    out: list[list[tuple[Node, int]]] = []
    loose: list = []
    stack = [(c, mode) for c in reversed(table.children)]
    while stack:
        child, around = stack.pop()
        if isinstance(child, str):
            if child.strip():
                loose.append(child)
            continue
        if hidden(child):
            continue
        own = around if child.shown == "" else around & ~_VEILED if child.shown else around | _VEILED
        if child.tag == "tr":
            out.append([(c, own) for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and not hidden(c)])
            loose += [c for c in child.children if (isinstance(c, str) and c.strip()) or (isinstance(c, Node) and c.tag not in ("td", "th"))]
        elif child.tag in ("tbody", "thead", "tfoot"):
            stack += [(c, own) for c in reversed(child.children)]
        elif child.tag in ("td", "th"):
            out.append([(child, around)])
        elif child.tag not in ("colgroup", "col"):
            loose.append(child)
    return out, loose


def _span(cell: Node, name: str, most: int) -> int:
    """colspan or rowspan; 0 rows are all that follow."""
    given = str(cell.attrs.get(name) or "1")
    given = given if given.strip() != "0" or name != "rowspan" else str(most)
    return min(most, max(1, int(given))) if re.fullmatch(r"\d{1,9}", given) else 1


def _broken(lines: list[str]) -> list[str]:
    """Lines of CELL characters or less, broken at spaces; a longer word is a line."""
    out = []
    for line in lines:
        while len(line) > CELL:
            at = line.rfind(" ", 1, CELL + 1)
            if at <= 0 or not line[:at].strip():
                at = line.find(" ", CELL)
                if at < 0:
                    break
            out.append(line[:at].rstrip())
            line = line[at + 1 :].lstrip(" ")
        out.append(line)
    return out


def _table(node: Node, page: _Page, mode: int):
    """Cells lie on a grid: one of several rows or columns keeps their places free of others. Cells of a column begin at the
    same place; a cell of several columns widens the last of them if it needs more room. Text stands in a cell's first row."""
    rows, loose = _rows(node, mode)
    if loose:  # what is no cell stands above the table, as browsers show it
        yield _render(loose, page, mode)
        page.gap(1)
    laid: list[list[tuple[int, int, list[str]]]] = []
    free_from: dict[int, int] = {}  # of a column, the next row that no cell above reaches into
    for r, row in enumerate(rows):
        at, cells = 0, []
        for cell, around in row:
            while free_from.get(at, 0) > r:
                at += 1
            wide, high = _span(cell, "colspan", 1000), _span(cell, "rowspan", len(rows) - r)
            own = around if cell.shown == "" else around & ~_VEILED if cell.shown else around | _VEILED
            text = yield _rendered(cell.children, own + _LEVEL)
            if high > 1:
                free_from.update((c, r + high) for c in range(at, at + wide))
            cells.append((at, wide, text.split("\n")))
            at += wide
        laid.append([(c, w, _broken(lines) if k + 1 < len(cells) else lines) for k, (c, w, lines) in enumerate(cells)])
    widths: dict[int, int] = defaultdict(int)
    # the last cell of a row needs no room after it
    placed = sorted(((w, c, min(CELL, max(map(len, lines)))) for cells in laid for c, w, lines in cells[:-1]), key=lambda x: x[:2])
    for wide, at, need in placed:
        room = sum(widths[c] for c in range(at, at + wide)) + 2 * (wide - 1)
        widths[at + wide - 1] += max(0, need - room)
    starts, here = [], 0
    for at in range(max((c + w for cells in laid for c, w, _ in cells), default=0)):
        starts.append(here)
        here += widths[at] + 2
    for cells in laid:
        height = max((len(lines) for *_, lines in cells), default=0)
        for k in range(height):
            line = ""
            for at, _, lines in cells:
                if k < len(lines) and lines[k]:
                    line = line.ljust(starts[at]) if len(line) < starts[at] else line + ("  " if line else "")
                    line += lines[k]
            if line.strip():
                page.raw(line.rstrip())
            page.gap(1)


def extract(html: str | None) -> str:
    """All visible text of a page, laid out; nesting may go to any depth. Null and empty pages give ''."""
    if not html:
        return ""
    tree = TreeBuilder()
    tree.feed(html)
    tree.close()
    _settle(tree.root)
    return _done(_rendered(tree.root.children))


def title(html: str | None) -> str:
    found = re.search(r"<title[^>]*>(.*?)</title", html or "", re.I | re.S)
    return _SPACES.sub(" ", found[1]).strip() if found else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines) for every row of pages.

    Null and empty html gives an empty text; unclosed, stray and misnested tags are tolerated; pages of any length are
    read whole; repeated rows are rendered each; extra columns are ignored; an empty table gives an empty result."""

    def run(batches):
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    made = pages.select("page_id", "url", "html").mapInArrow(run, pages.select("page_id", "url").schema.add("text", "string"))
    lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))
