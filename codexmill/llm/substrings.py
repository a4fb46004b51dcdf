"""Substring dedup by compact windows: passages of 50 words or more that repeat, exactly or nearly, across the corpus."""

from __future__ import annotations

import re
import sys
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.llm.common import discard, free_name, materialize, mix, mix_into, numbered, reading, released, values, with_given_ids

SHINGLE = 5
MIN_WORDS = 50
SIMILARITY = 0.8
HASHES = 6
#: Shingles of the shortest passage, and the reach of a window clipped around its centre.
WIDTH = MIN_WORDS - SHINGLE + 1
REACH = WIDTH - 1
HALF = WIDTH // 2 - 1
#: Shingles of a passage that must be found in its partner: m of WIDTH with m / (2 WIDTH - m) >= SIMILARITY.
MATCHED = int(np.ceil(WIDTH * 2 * SIMILARITY / (1 + SIMILARITY)))
#: Places by which edits may move a shingle against its run's diagonal.
DRIFT = 8
#: Grades of place of a centre in its passage: those of one grade have a block of MATCHED places in common.
GRADE = WIDTH - MATCHED + 1
#: Places of a text that a candidate run may span besides its reach: what one task holds of a long text is bounded.
BLOCK = 1024
_P = np.uint64(0x9E3779B97F4A7C15)
#: Places of zeros before and after an array of which runs are asked.
_EDGE = 1 << REACH.bit_length()
#: The upper half of a 64-bit number among its two 32-bit halves.
_HIGH = 1 if sys.byteorder == "little" else 0


#: Bytes of text whose words are hashed at once, and of short texts that are laid out together.
_PIECE = 1 << 18
_GROUP = 1 << 19


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers 0.._PIECE of _P modulo 2 ** 64, and those of its inverse."""
    made = []
    for base in (int(_P), pow(int(_P), -1, 1 << 64)):
        steps = np.full(_PIECE + 1, base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    return made[0], made[1]


def _piece_hashes(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first bytes) of the words of a piece."""
    up, down = _powers()
    blank = (piece == 32) | ((piece >= 9) & (piece <= 13))
    edge = np.empty(len(piece) + 1, bool)
    edge[0], edge[-1] = not blank[0], not blank[-1]
    np.not_equal(blank[1:], blank[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    total = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum(up[: len(piece)] * (piece.astype(np.uint16) + 1), out=total[1:])
    first = at[::2]
    return (total[at[1::2]] - total[first]) * down[first], first


def placed_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, first bytes) of the words, runs of bytes other than white space: byte k of a word, plus one, counts times _P ** k, modulo 2 ** 64."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) <= _PIECE:
        return _piece_hashes(raw) if len(raw) else (np.empty(0, np.uint64), np.empty(0, np.int64))
    out, first, at = [], [], 0
    while at < len(raw):
        stop = min(len(raw), at + _PIECE)
        if stop < len(raw):
            gaps = np.flatnonzero((raw[at:stop] == 32) | ((raw[at:stop] >= 9) & (raw[at:stop] <= 13)))
            if not len(gaps):  # a word longer than a piece: its pieces' sums, moved to their places
                value, moved = 0, 0
                rest = raw[at:]
                after = re.search(rb"[ \t-\r]", text[at:])
                rest = rest[: after.start()] if after else rest
                for k in range(0, len(rest), _PIECE):
                    value += int(_piece_total(rest[k : k + _PIECE])) * pow(int(_P), moved, 1 << 64)
                    moved += _PIECE
                out.append(np.array([value % (1 << 64)], np.uint64))
                first.append(np.array([at], np.int64))
                at += len(rest)
                continue
            stop = at + int(gaps[-1]) + 1
        hashes, begins = _piece_hashes(raw[at:stop])
        out.append(hashes)
        first.append(begins + at)
        at = stop
    return np.concatenate(out), np.concatenate(first)


def word_hashes(text: bytes) -> np.ndarray:
    return placed_words(text)[0]


def _piece_total(piece: np.ndarray) -> np.uint64:
    return (_powers()[0][: len(piece)] * (piece.astype(np.uint16) + 1)).sum(dtype=np.uint64)


def shingles_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends): 64-bit hashes of all 5-word shingles of the texts, A-Z lowered, one to a word; those of text
    i begin at starts[i], the last SHINGLE - 1 places before ends[i] hold nothing of use. Many short texts are one array."""
    h, first = placed_words(b" ".join(texts).lower())
    bounds = np.searchsorted(first, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    h += np.uint64(1)
    mix_into(h)
    n = max(0, len(h) - SHINGLE + 1)
    out = h.copy()
    for k in range(1, SHINGLE):
        out[:n] *= _P
        out[:n] += h[k : k + n]
    return mix_into(out), bounds[:-1], bounds[1:]


def _own(flat: np.ndarray, start: int, end: int) -> np.ndarray:
    return flat[start : max(start, end - SHINGLE + 1)]


def shingle_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of all 5-word shingles of a text, A-Z lowered."""
    flat, _, ends = shingles_of([text])
    return _own(flat, 0, int(ends[0]))


def _shingled(column: pa.Array, rows: int = 256):
    """The texts of an Arrow column as (row of the first, hashes, starts, ends), about _GROUP bytes at a time."""
    at, group, size = 0, [], 0
    for raw in values(column, rows):
        group.append(raw)
        size += len(raw)
        if size >= _GROUP:
            yield (at, *shingles_of(group))
            at, group, size = at + len(group), [], 0
    if group:
        yield (at, *shingles_of(group))


def _each(column: pa.Array):
    """The shingle hashes of each text of an Arrow column."""
    for _, flat, starts, ends in _shingled(column, 16):
        for start, end in zip(starts.tolist(), ends.tolist()):
            yield _own(flat, start, end)


def _slide(v: np.ndarray, width: int, take) -> np.ndarray:
    """take (minimum or maximum) over each run of `width` values, by doubling."""
    at, reach = v, 1
    while reach * 2 <= width:
        at = take(at[: len(at) - reach], at[reach:])
        reach *= 2
    rest = width - reach
    return take(at[: len(at) - rest], at[rest:]) if rest else at


def _extents(tables: list[np.ndarray], at: np.ndarray, fits) -> np.ndarray:
    """How many places on from each of `at` fit, REACH at most: tables[i] holds the least of 2 ** i places, halved steps add up."""
    out = np.zeros(len(at), np.int64)
    for i in reversed(range(len(tables))):
        out += np.where(fits(tables[i], at, out, 1 << i), 1 << i, 0)
    return np.minimum(out, REACH)


def _doubled(v: np.ndarray, width: int, held: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """The least of 1, 2, 4 .. places from each place on, up to `width`; in the arrays `held`, if given, of an earlier table of this length."""
    tables = [v]
    while 1 << len(tables) <= width:
        half = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:], out=held[len(tables)] if held else None))
    return tables


def _least(tables: list[np.ndarray], width: int) -> np.ndarray:
    """The least of each run of `width` places, from two entries of a doubled table."""
    top = width.bit_length() - 1
    rest = width - (1 << top)
    return np.minimum(tables[top][: len(tables[top]) - rest], tables[top][rest:]) if rest else tables[top]


def compact_windows(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, left ends, right ends): the nodes of v's Cartesian tree (least value on top, leftmost among equals) that
    span WIDTH places or more, cut to REACH places around their centre. Every run of WIDTH places has its least value at
    the centre of exactly one of these that holds it. Zeros part documents and are no part of any window."""
    if len(v) < WIDTH:
        return (np.empty(0, np.int64),) * 3
    edge = np.zeros(_EDGE, v.dtype)
    tables = _doubled(np.concatenate([edge, v, edge]), REACH)
    centres = _centres(v, tables)
    left, right = _reaches(tables, centres)
    wide = left + right + 1 >= WIDTH
    return centres[wide], (centres - left)[wide], (centres + right)[wide]


def _centres(v: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Places that are a least value of some run of WIDTH places, from the doubled table of v between two edges of zeros."""
    inside = _least(tables, WIDTH)[_EDGE - REACH : _EDGE + len(v)]  # over all runs that hold a place of v; 0 across an end
    return np.flatnonzero((_slide(inside, WIDTH, np.maximum) == v) & (v > 0))


def _reaches(tables: list[np.ndarray], centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the windows of centres go to the left and to the right."""
    at = centres + _EDGE
    value = tables[0][at]
    left = _extents(tables, at, lambda t, p, done, step: t[p - done - step] > value)
    return left, _extents(tables, at, lambda t, p, done, step: t[p + done + 1] >= value)


def _window_centres(v: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """The centres of `compact_windows`. Only an equal value before it in its run, then the centre before it, can make a centre's window too short."""
    c = _centres(v, tables)
    tied = np.flatnonzero((np.diff(c) <= REACH) & (np.diff(v[c]) == 0)) + 1
    if len(tied):
        left, right = _reaches(tables, c[tied])
        c = np.delete(c, tied[left + right + 1 < WIDTH])
    return c


def signatures(flat: np.ndarray, hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """(keys, centres) of all compact windows of the parted shingle hashes `flat`.

    A signature is the least shingle and, on a side where the window goes on for half a passage, the least shingle of that
    side's outer quarter: of a passage of WIDTH places around the centre, one half lies whole on one side, so two texts
    that share the passage share that signature."""
    keys, where = [], []
    quarter = HALF // 2
    if len(flat) < WIDTH:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    gaps = np.flatnonzero(flat == 0)
    mixed = np.empty_like(flat)
    held = np.zeros(len(flat) + 2 * _EDGE, np.uint32)
    v, tables = held[_EDGE:-_EDGE], None
    for k in range(hashes):
        np.add(flat, np.uint64((2 * k + 1) * int(_P) % (1 << 64)), out=mixed)
        v[:] = mix_into(mixed).view(np.uint32)[_HIGH::2]
        np.maximum(v, np.uint32(1), out=v)
        v[gaps] = 0
        tables = _doubled(held, REACH, tables)
        c = _window_centres(v, tables)
        if not len(c):
            continue
        value, half = v[c], _least(tables, HALF)[_EDGE - HALF :]  # half[i]: of the HALF places before i
        outer = _least(tables, HALF - quarter)[_EDGE:]
        for side, fits, at in ((1, half[c + HALF + 1] >= value, c + quarter + 1), (2, half[c] > value, c - HALF)):
            fit_c, fit_at = c[fits], at[fits]
            keys.append(mix(v[fit_c].astype(np.uint64) * _P + mix(outer[fit_at].astype(np.uint64)) + np.uint64(side)))
            where.append(fit_c)
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(where)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def _windows(texts: DataFrame, hashes: int) -> DataFrame:
    """(doc_id, c, key) of all compact windows of the texts; a batch of documents is laid out as one parted array.

    Cheaper to make than to store, so it is made from the texts wherever it is read."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, flat, starts, ends in _shingled(batch.column(1)):
                flat |= np.uint64(1)
                for k in range(1, SHINGLE):  # places of no shingle part the texts
                    flat[np.maximum(ends - k, starts)[ends > starts]] = 0
                keys, at = signatures(flat, hashes)
                row = np.searchsorted(starts, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + row]), pa.array((at - starts[row]).astype(np.int32)), pa.array(keys.view(np.int64))], ["doc_id", "c", "key"])

    return texts.mapInArrow(released(run), "doc_id long, c int, key long")


class _Places:
    """Places (doc_id, c) as one ordered column: a packed long where ids and lengths leave room for it, else a struct.

    Both order alike; a long lets the least place of a signature be found by hashing instead of sorting."""

    def __init__(self, docs: DataFrame) -> None:
        sized = _texts(docs).agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text")), F.count("doc_id") - F.count_distinct("doc_id")).first()
        self.repeated = sized[3] > 0
        self.bits = ((sized[2] or 0) // 2 + 1).bit_length()
        self.packed = (sized[0] or 0) >= 0 and (sized[1] or 0).bit_length() + self.bits <= 63

    def of(self, windows: DataFrame) -> DataFrame:
        at = F.shiftleft("doc_id", self.bits).bitwiseOR(F.col("c").cast("long")) if self.packed else F.struct("doc_id", "c")
        return windows.withColumn("at", at).drop("doc_id", "c")

    def doc(self, at: str) -> Column:
        return F.shiftright(at, self.bits) if self.packed else F.col(at)["doc_id"]

    def c(self, at: str) -> Column:
        return (F.col(at).bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int") if self.packed else F.col(at)["c"])


def _links(held: DataFrame, asked: Column | None = None) -> DataFrame:
    """A stored table (key, first, at): each window, or each `asked` one, with the first of its signature, if that is another one.

    A signature's windows are never paired with each other: firsts are pre-aggregated, the join back may be split where a
    signature is hot."""
    first = held.groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1").select("key", "first")
    # stored, so that both sides of the join come from plain exchanges and a hot signature's windows can be split
    first = materialize(first, "first-windows")
    asking = held if asked is None else held.where(asked)
    # each signature is once in `first`: a table of it needs no sort of the windows
    made = materialize(asking.join(first.hint("shuffle_hash"), "key").where(F.col("at") > F.col("first")).select("key", "first", "at"), "window-links")
    discard(first)
    return made


def _named(links: DataFrame, places: _Places) -> DataFrame:
    return links.select("key", places.doc("first").alias("a_id"), places.doc("at").alias("b_id"), places.c("at").alias("c"), (places.c("at") - places.c("first")).alias("shift"))


def _runs(links: DataFrame, places: _Places) -> DataFrame:
    """A stored table of candidate runs (a_id, b_id, shift, least, most, a_lo, a_hi, b_lo, b_hi), in shingle places: the
    windows of a pair on one diagonal and in one block of the text, from their least centre to their most."""
    grouped = _named(links, places).groupBy("a_id", "b_id", "shift", F.floor(F.col("c") / BLOCK).cast("int").alias("block"))
    lo, hi = F.col("least") - REACH, F.col("most") + REACH
    runs = grouped.agg(F.min("c").alias("least"), F.max("c").alias("most")).select(
        "a_id", "b_id", "shift", "least", "most", F.greatest(lo - F.col("shift"), F.lit(0)).alias("a_lo"), (hi - F.col("shift")).alias("a_hi"), F.greatest(lo, F.lit(0)).alias("b_lo"), hi.alias("b_hi")
    )
    return materialize(runs, "window-runs")


def _spread(into: np.ndarray, at: np.ndarray, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
    """into[at[i] : at[i] + sizes[i]] = values[starts[i] : starts[i] + sizes[i]] for every i."""
    before = np.cumsum(sizes) - sizes
    step = np.arange(int(sizes.sum()))
    into[np.repeat(at - before, sizes) + step] = values[np.repeat(starts - before, sizes) + step]


def verified_runs(a: np.ndarray, a_at, a_len, b: np.ndarray, b_at, b_len, off, above, least, most) -> tuple[tuple, tuple]:
    """((run, first, last), (run, first, last)): spans that runs repeat, and intervals of centres least..most in no span; places count in b's part.

    Part i of b is b[b_at[i] : b_at[i] + b_len[i]], its first place stands at off[i] in part i of a. A place of b is matched
    if its shingle is among a's within DRIFT places of their diagonal, above[i] at most after it. A span is a run of places
    of which any WIDTH in a row have MATCHED matched ones or more, without the unmatched at its ends. All runs are laid out
    in one array, a cell each, so that a diagonal of all of them is compared at once."""
    cell = b_len + 2 * DRIFT
    ends = np.cumsum(cell)
    starts = ends - cell
    total = int(ends[-1]) if len(ends) else 0
    if total < WIDTH:
        none = (np.empty(0, np.int64),) * 3
        return none, none
    # 0 and 1 stand for no place, on one side each
    left, right = np.zeros(total, np.uint32), np.ones(total, np.uint32)
    a, b = np.maximum(a, np.uint32(2)), np.maximum(b, np.uint32(2))
    _spread(right, starts + DRIFT, b, b_at, b_len)
    lo = off - DRIFT
    skip = np.maximum(0, -lo)
    _spread(left, starts + skip, a, a_at + lo + skip, np.maximum(0, np.minimum(cell, a_len - lo) - skip))
    inner = right[DRIFT : total - DRIFT]
    same = np.zeros(total, bool)
    near = same[DRIFT : total - DRIFT]
    bounded = bool((above < DRIFT).any())
    limit = np.repeat(above, cell)[DRIFT : total - DRIFT] if bounded else None
    for e in range(2 * DRIFT + 1):
        equal = inner == left[e : e + len(inner)]
        if bounded and e > DRIFT:
            equal &= limit >= e - DRIFT
        near |= equal
    owner = np.repeat(np.arange(len(cell)), cell)
    counts = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(counts[WIDTH:] - counts[:-WIDTH] >= MATCHED)
    base = starts + DRIFT
    good = good[(good >= base[owner[good]]) & (good + WIDTH <= (base + b_len)[owner[good]])]
    begins = good[np.diff(good, prepend=-2) > 1] if len(good) else good
    stops = good[np.diff(good, append=total + 2) > 1] if len(good) else good
    where = np.flatnonzero(same)
    first = where[np.searchsorted(where, begins)] if len(begins) else begins
    last = where[np.searchsorted(where, stops + WIDTH) - 1] if len(begins) else begins
    run = owner[begins]
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, base + least, 1)
    np.add.at(change, base + most + 1, -1)
    asked = np.cumsum(change[:-1]) > 0
    change[:] = 0
    np.add.at(change, first, 1)
    np.add.at(change, last + 1, -1)
    lost = asked & (np.cumsum(change[:-1]) == 0)
    edge = np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8))
    x, y = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return (run, first - base[run], last - base[run]), (owner[x], x - base[owner[x]], y - base[owner[x]])


def verified_spans(a: np.ndarray, b: np.ndarray, a_lo: int, b_lo: int, shift: int, same_text: bool = False) -> list[tuple[int, int]]:
    """Word spans (first, last) of b's text that one run repeats; in the same text only of places strictly before."""
    one = lambda x: np.array([x], np.int64)
    spans, _ = verified_runs(a, one(0), one(len(a)), b, one(0), one(len(b)), one(b_lo - shift - a_lo), one(min(DRIFT, shift - 1) if same_text else DRIFT), one(0), one(-1))
    return [(x + b_lo, y + b_lo + SHINGLE - 1) for x, y in zip(spans[1].tolist(), spans[2].tolist())]


_FOUND = "kind int, doc_id long, a_id long, shift int, lo int, hi int, end int"
_SPAN, _SOURCE, _OPEN = 0, 1, 2


def _found_rows(b_id, a_id, shift, b_lo, b_len, spans, lost) -> pa.RecordBatch:
    """Rows of _FOUND: merged word spans of each document, sources of each, intervals of centres left open with the last place of their part."""
    run, first, last = spans
    doc, first, last = b_id[run], first + b_lo[run], last + b_lo[run] + SHINGLE - 1
    order = np.lexsort((first, doc))
    doc_s, first_s, last_s = doc[order], first[order], last[order]
    if len(order):
        number = np.cumsum(np.diff(doc_s, prepend=doc_s[0]) != 0)
        lift = number * (int(last_s.max()) + 2)
        reach = np.maximum.accumulate(last_s + lift)
        new = np.ones(len(order), bool)
        new[1:] = (first_s + lift)[1:] > reach[:-1] + 1
        at = np.flatnonzero(new)
        doc_s, first_s, last_s = doc_s[at], first_s[at], (reach - lift)[np.append(at[1:], len(order)) - 1]
    source = np.unique(np.stack([doc, a_id[run]], axis=1), axis=0) if len(run) else np.empty((0, 2), np.int64)
    o_run, o_first, o_last = lost
    sizes = (len(doc_s), len(source), len(o_run))
    void = [np.zeros(n, np.int64) for n in sizes]
    parts = [
        (doc_s, void[0], void[0], first_s, last_s, void[0]),
        (source[:, 0], source[:, 1], void[1], void[1], void[1], void[1]),
        (b_id[o_run], a_id[o_run], shift[o_run], o_first + b_lo[o_run], o_last + b_lo[o_run], (b_lo + b_len - 1)[o_run]),
    ]
    columns = [np.repeat([_SPAN, _SOURCE, _OPEN], sizes).astype(np.int32)] + [np.concatenate(c) for c in zip(*parts)]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], ["kind", "doc_id", "a_id", "shift", "lo", "hi", "end"])


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, sizes) of a column of parts."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[: len(held) // 4 * 4].view("<u4"), ends[:-1], np.diff(ends)


_RUN = 3
_PARTS = f"part binary, {_FOUND}, least int, most int, a_lo int, a_hi int"


def _slices(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of _PARTS. Of every range that runs over two documents name in their first one: the 32-bit shingle hashes of places
    lo..hi, kind null. Of every such run: its hashes in the second document, kind _RUN. Runs inside one document are
    verified here, where its text is: rows of _FOUND, part null."""
    apart = runs.where("a_id <> b_id")
    # distinct first: a document of which many others repeat a passage still has few ranges of its own
    names = ("shift", "least", "most", "a_id", "a_lo", "a_hi")
    none = [F.lit(None).cast("long" if n == "a_id" else "int").alias(n) for n in names]
    ranges = apart.select(F.col("a_id").alias("doc_id"), F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")).distinct().select("doc_id", F.struct("lo", "hi", *none).alias("w"))
    own = runs.select(F.col("b_id").alias("doc_id"), F.struct(F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"), *names).alias("w"))
    wanted = ranges.unionAll(own).groupBy("doc_id").agg(F.collect_list("w").alias("wanted"))
    columns = [f.split(" ")[0] for f in _PARTS.split(", ")]
    n_found = len(_FOUND.split(", "))

    def rows(held):
        """One batch of the blocks (doc_id, parts, values of the fields, which of them are of runs)."""
        parts = [p for block in held for p in block[1]]
        doc = np.concatenate([np.full(len(block[1]), block[0], np.int64) for block in held]) if held else np.empty(0, np.int64)
        of_run = np.concatenate([block[3] for block in held]) if held else np.empty(0, bool)
        at = {f: np.concatenate([block[2][f] for block in held]) if held else np.empty(0, np.int64) for f in ("lo", "hi", *names)}
        whole = lambda f, mask=None: pa.array(at[f].astype(np.int32), pa.int32(), mask=mask)
        kind = pa.array(np.full(len(doc), _RUN, np.int32), mask=~of_run)
        a_id = pa.array(at["a_id"], pa.int64(), mask=~of_run)
        return pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.binary()), kind, pa.array(doc), a_id, whole("shift", ~of_run), whole("lo"), whole("hi"), pa.nulls(len(doc), pa.int32()), *(whole(f, ~of_run) for f in ("least", "most", "a_lo", "a_hi"))], columns
        )

    def run(batches):
        for batch in batches:
            held, size = [], 0
            inner, ends = batch.column(2).flatten(), np.cumsum([0, *batch.column(2).value_lengths().to_pylist()]).tolist()
            field = {f: inner.field(f).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("lo", "hi", *names)}
            of_run = inner.field("a_id").is_valid().to_numpy(zero_copy_only=False)
            for k, (i, h) in enumerate(zip(batch.column(0).to_pylist(), _each(batch.column(1)))):
                h = (h >> np.uint64(32)).astype("<u4")
                mine = slice(ends[k], ends[k + 1])
                own = of_run[mine] & (field["a_id"][mine] == i)
                if own.any():
                    at, to, move, least, most = (field[f][mine][own] for f in ("lo", "hi", "shift", "least", "most"))
                    a_lo = np.maximum(0, at - move)
                    b_len = np.minimum(to + 1, len(h)) - at
                    args = (h, a_lo, np.minimum(to - move + 1, len(h)) - a_lo, h, at, b_len, at - move - a_lo, np.minimum(DRIFT, move - 1), least - at, most - at)
                    me = np.full(len(at), i, np.int64)
                    found = _found_rows(me, me, move, at, b_len, *verified_runs(*args))
                    void = pa.nulls(found.num_rows, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.nulls(found.num_rows, pa.binary()), *found.columns[:n_found], void, void, void, void], columns)
                rest = ~own
                if rest.any():
                    block = {f: v[mine][rest] for f, v in field.items()}
                    raw_h, lo, hi = h.tobytes(), (4 * block["lo"]).tolist(), (4 * block["hi"] + 4).tolist()
                    held.append((i, [raw_h[x:y] for x, y in zip(lo, hi)], block, of_run[mine][rest]))
                    size += sum(hi) - sum(lo)
                    if size > 8 << 20:
                        yield rows(held)
                        held, size = [], 0
            yield rows(held)

    # a table of what is wanted, so that texts are not sorted
    return texts.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "wanted").mapInArrow(released(run), _PARTS)


def _verified(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """A stored table of _FOUND: what the runs repeat and what they leave open."""
    parts = materialize(_slices(texts, runs), "window-slices")
    firsts = parts.where("kind is null").select(F.col("doc_id").alias("a_id"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.col("part").alias("a"))
    seconds = parts.where(F.col("kind") == _RUN).select("a_id", "a_lo", "a_hi", F.col("part").alias("b"), F.col("doc_id").alias("b_id"), F.col("lo").alias("b_lo"), "shift", "least", "most")
    paired = seconds.join(firsts, ["a_id", "a_lo", "a_hi"])

    def run(batches):
        for batch in batches:
            (a, a_at, a_len), (b, b_at, b_len) = _parts(batch.column(0)), _parts(batch.column(1))
            a_id, b_id, a_lo, b_lo, shift, least, most = (batch.column(c).to_numpy().astype(np.int64) for c in range(2, 9))
            piece = np.cumsum(b_len + 2 * DRIFT) // 300_000
            for at, to in zip(*(np.searchsorted(piece, np.unique(piece), side=x) for x in ("left", "right"))):
                k = slice(at, to)
                spans, lost = verified_runs(a, a_at[k], a_len[k], b, b_at[k], b_len[k], (b_lo - shift - a_lo)[k], np.full(to - at, DRIFT), (least - b_lo)[k], (most - b_lo)[k])
                yield _found_rows(b_id[k], a_id[k], shift[k], b_lo[k], b_len[k], spans, lost)

    apart = paired.select("a", "b", "a_id", "b_id", "a_lo", "b_lo", "shift", "least", "most").mapInArrow(released(run), _FOUND)
    own = parts.where(F.col("part").isNull()).select(*(f.split(" ")[0] for f in _FOUND.split(", ")))
    made = materialize(apart.unionAll(own), "verified-runs")
    discard(parts)
    return made


def _merged(found: DataFrame) -> DataFrame:
    """(doc_id, spans): sorted, joined where they touch or overlap."""
    by = Window.partitionBy("doc_id").orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.where(F.col("kind") == _SPAN).select("doc_id", "lo", "hi", (before.isNull() | (F.col("lo") > before + 1)).cast("int").alias("new"))
    spans = marked.withColumn("n", F.sum("new").over(by)).groupBy("doc_id", "n").agg(F.min("lo").cast("long").alias("first"), F.max("hi").cast("long").alias("last"))
    return spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))


def _settled(spans: str, lo: Column, hi: Column) -> Column:
    """Whether places lo..hi are all in one of the spans: nothing more can be marked there."""
    return F.coalesce(F.exists(spans, lambda s: (s["first"] <= F.greatest(lo, F.lit(0))) & (s["last"] >= hi + SHINGLE - 1)), F.lit(False))


def _open_places(found: DataFrame, links: DataFrame, places: _Places) -> DataFrame:
    """(doc_id, places array<struct<c, open>>): the centres of all windows that are linked under a signature under which
    some window failed against the first. Those of failed windows are open, unless all places that a passage around them
    can reach are in one span already: such a window can mark no further word, but may be the first holder of others."""
    spans = materialize(_merged(found), "first-spans")
    lost = found.where(F.col("kind") == _OPEN).join(spans, "doc_id", "left").where(~_settled("spans", F.col("lo") - REACH, F.least(F.col("hi") + REACH, F.col("end"))))
    lost = lost.select("a_id", F.col("doc_id").alias("b_id"), "shift", "lo", "hi", "end").hint("shuffle_hash")
    failed = _named(links, places).join(lost, ["a_id", "b_id", "shift"]).where("c between lo and hi").join(spans.withColumnRenamed("doc_id", "b_id"), "b_id", "left")
    failed = failed.where(~_settled("spans", F.col("c") - REACH, F.least(F.col("c") + REACH, F.col("end"))))
    failed = materialize(failed.select("key", F.col("b_id").alias("doc_id"), "c"), "open-windows")
    keys = materialize(failed.select("key").distinct(), "open-signatures")
    members = links.join(keys.hint("shuffle_hash"), "key", "left_semi").select(places.doc("at").alias("doc_id"), places.c("at").alias("c"))
    members = members.withColumn("open", F.lit(False))
    every = members.unionAll(failed.select("doc_id", "c", F.lit(True))).groupBy("doc_id", "c").agg(F.max("open").alias("open"))
    made = materialize(every.groupBy("doc_id").agg(F.collect_list(F.struct("c", "open")).alias("places")), "open-places")
    discard(failed, keys, spans)
    return made


def block_keys(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, indices in c): second signatures of the centres c in the shingle hashes h of a text.

    A passage of WIDTH places around a centre has its centre in one of several grades, and holds the block of MATCHED
    places that all passages of its grade share: texts with that block are similar, so the first holder of the block's
    hash always verifies. For near passages there are also two least hashes of coarser blocks, four to a centre."""
    n = len(h)
    powers = np.full(n + 1, _P, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[:n])])
    keys, where = [], []
    for g in range(0, WIDTH, GRADE):
        lo = c - g
        fits = (lo >= 0) & (lo + MATCHED <= n)
        lo = lo[fits]
        # the block's sum, moved to the same power for every place
        keys.append(mix((total[lo + MATCHED] - total[lo]) * powers[n - lo]))
        where.append(np.flatnonzero(fits))
    step = GRADE * 2
    size = WIDTH - step + 1
    if n >= size:
        tops = [_slide(mix(h ^ np.uint64(0xA0761D6478BD642F + k)), size, np.minimum) for k in range(2)]
        for g in range(0, WIDTH, step):
            lo = c - g
            fits = (lo >= 0) & (lo + size <= n)
            lo = lo[fits]
            keys.append(mix(tops[0][lo] * _P + mix(tops[1][lo]) + np.uint64(g + 1)))
            where.append(np.flatnonzero(fits))
    return np.concatenate(keys), np.concatenate(where)


def _blocks(texts: DataFrame, opened: DataFrame) -> DataFrame:
    """(doc_id, c, key, open) of the second signatures of places."""

    def run(batches):
        for batch in batches:
            inner, ends = batch.column(2).flatten(), np.cumsum([0, *batch.column(2).value_lengths().to_pylist()]).tolist()
            centres, opened = inner.field("c").to_numpy().astype(np.int64), inner.field("open").to_numpy(zero_copy_only=False)
            for k, (i, h) in enumerate(zip(batch.column(0).to_pylist(), _each(batch.column(1)))):
                own = slice(ends[k], ends[k + 1])
                keys, row = block_keys(h, centres[own])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), i, np.int64)), pa.array(centres[own][row].astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(opened[own][row])], ["doc_id", "c", "key", "open"])

    return texts.join(opened.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "places").mapInArrow(released(run), "doc_id long, c int, key long, open boolean")


def repeated_spans(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """(doc_id, spans array<struct<first, last>>, sources), stored, of the documents that repeat a passage of an earlier
    place; ends included, merged, in words of the whole text. doc_id must tell rows apart; rows without one are not searched.

    The first place is the one of the smallest doc_id (then the first in the text); it is never in a span for that passage.
    A window is held against the first of its signature. Where a window fails, all windows of its signature go on to
    second signatures, under which an exact repeat cannot fail: no repeat of MIN_WORDS words is lost, and no two windows
    of a signature are ever paired beyond its first."""
    places, rounds = _Places(docs), []
    texts = _texts(docs).where(F.col("doc_id").isNotNull())
    if places.repeated:
        raise ValueError("doc_id must tell rows apart")
    windows, opened = _windows(texts, hashes), None
    for turn in range(2):
        links = _links(places.of(windows), F.col("open") if turn else None)
        runs = _runs(links, places)
        rounds.append(_verified(texts, runs))
        discard(runs)
        if turn == 0:
            opened = _open_places(rounds[0], links, places)
            windows = _blocks(texts, opened)
        discard(links)
    found = reduce(DataFrame.unionAll, rounds)
    sources = found.where(F.col("kind") == _SOURCE).groupBy("doc_id").agg(F.array_sort(F.collect_set("a_id")).alias("sources"))
    spans = materialize(_merged(found).join(sources, "doc_id"), "repeated-spans")
    discard(opened, *rounds)
    return spans


def _word_count(raw: np.ndarray) -> int:
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    return int(np.count_nonzero(blank[:-1] & ~blank[1:])) + int(len(raw) > 0 and not blank[0])


def _counted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words) of every row."""

    def run(batches):
        for batch in batches:
            counts = [_word_count(np.frombuffer(raw, np.uint8)) for raw in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_words"])

    return _texts(docs).mapInArrow(released(run), "doc_id long, n_words long")


def substring_duplicates(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """(doc_id, n_words, n_repeated, spans, sources) for every row of docs.

    n_repeated words lie in passages of MIN_WORDS or more that an earlier place of the corpus has too, with a Jaccard
    similarity of 5-word shingles of SIMILARITY or more; sources are the doc_ids of rows that have the first place of one.
    Null and empty texts and texts under MIN_WORDS repeat nothing. Rows are searched each: one that shares its id with
    others has the spans of its own text, and earlier means by doc_id, then by a hash of the text; rows with a null id come
    last, and are not named as sources. Extra columns are ignored; an empty table gives an empty result."""
    rows, given = numbered(docs.select("doc_id", "text"))
    spans = repeated_spans(rows, hashes)
    count = F.aggregate("spans", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    found, sources, row_id = _counted(rows), spans.select("doc_id", "sources"), F.col("doc_id")
    if given is not None:
        ids = rows.select("doc_id", F.col(given).cast("long").alias("id"))
        named = sources.select(F.col("doc_id").alias("row"), F.explode("sources").alias("doc_id")).join(ids, "doc_id")
        sources = named.groupBy(F.col("row").alias("doc_id")).agg(F.array_sort(F.collect_set("id")).alias("sources"))
        found, row_id = found.join(ids, "doc_id"), F.col("id").alias("doc_id")
    found = found.join(spans.drop("sources").join(sources, "doc_id") if given is not None else spans, "doc_id", "left")
    return found.select(row_id, "n_words", F.coalesce(count, F.lit(0).cast("long")).alias("n_repeated"), "spans", "sources")


def remove_repeats(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """docs without its repeated passages: each goes from all texts but the first that has it. Words outside spans, and the
    white space between them, stay as they are; n_chars, if there, is counted anew.

    The first text is that of the least doc_id, then of the least hash of the text; rows with a null id come last. Rows are
    cut each by their own text, also where they share an id; of equal rows the first stays whole. A row that is left without
    words goes; rows that had none before stay, null texts too, as do rows under MIN_WORDS words. Other columns are kept,
    whatever their names; an empty table stays empty; a text may be as long as a row may."""
    rows, given = numbered(docs)
    held = free_name(rows, "spans")
    spans = repeated_spans(rows.select("doc_id", "text"), hashes)
    cut = rows.join(spans.select("doc_id", F.col("spans").alias(held)), "doc_id", "left")
    others = rows.columns

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(values(batch.column("text")), values(batch.column(held))):
                texts.append(without_spans(text, spans) if spans else text)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in others]
            made = pa.RecordBatch.from_arrays(columns, others)
            yield made.filter(pa.array([not h or bool(t.split()) for t, h in zip(texts, batch.column(held).to_pylist())], pa.bool_()))

    out = with_given_ids(cut.mapInArrow(released(run), rows.schema), given, docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)
    return reading(out, spans, *[rows] * (given is not None))


def without_spans(text: str, spans: list[dict]) -> str:
    raw, keep, at = text.encode(), [], 0
    marks = np.frombuffer(raw, np.uint8)
    blank = (marks == 32) | ((marks >= 9) & (marks <= 13))
    starts = np.nonzero(~blank & np.concatenate([[True], blank[:-1]]))[0]
    for s in spans:
        keep.append(raw[at : starts[s["first"]]])
        at = int(starts[s["last"] + 1]) if s["last"] + 1 < len(starts) else len(raw)
    keep.append(raw[at:])
    return b"".join(keep).decode()
