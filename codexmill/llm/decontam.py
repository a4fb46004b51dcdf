"""Benchmark decontamination over a stored positional inverted index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.llm.common import LARGE_ROWS, alnum_words, materialize, reading, released, values

WINDOW = 8
#: Words that one index segment gathers (a longer document has a segment of its own).
SEGMENT_WORDS = 400_000
#: Text bytes of test items that are looked up together and sent to every task; more items go in more blocks.
BLOCK_BYTES = 16 << 20
#: Unused positions between two documents of a segment.
GAP = 64

_INDEX = "ids array<long>, starts array<long>, sizes array<long>, terms array<binary>, offsets binary, postings binary"


class ItemBlock:
    """Windows of test items over one coded text: what is sent to every task is a word list and arrays, some 30 bytes a window."""

    def __init__(self, rows: list[tuple[int, str]], window: int = WINDOW) -> None:
        number: dict[bytes, int] = {}
        codes, at, sizes, owners, place = [], [], [], [], 0
        for item, text in rows:
            words = alnum_words(text.encode())
            if not words:
                continue
            codes.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
            n = max(1, len(words) - window + 1)
            at.append(place + np.arange(n))
            sizes.append(np.full(n, min(window, len(words))))
            owners.append(np.full(n, item))
            place += len(words)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        self.terms, self.codes = list(number), join(codes, np.int32)
        self.at, self.sizes, self.owners = join(at, np.int32), join(sizes, np.int32), join(owners, np.int64)

    def present(self, number: dict[bytes, int]):
        """(terms' numbers, owner) of the windows all of whose words are numbered."""
        found = np.fromiter((number.get(t, -1) for t in self.terms), np.int64, len(self.terms))[self.codes]
        lacking = np.concatenate([[0], np.cumsum(found < 0)])
        whole = np.flatnonzero(lacking[self.at + self.sizes] == lacking[self.at])
        for a, n, owner in zip(self.at[whole].tolist(), self.sizes[whole].tolist(), self.owners[whole].tolist()):
            yield tuple(found[a : a + n].tolist()), owner


def _segment(rows: list[tuple[int, list[bytes]]]) -> list:
    """One index row: document ids with their first positions and word counts, and each term's sorted positions."""
    starts, at = [], 0
    for _, words in rows:
        starts.append(at)
        at += len(words) + GAP
    number: dict[bytes, int] = {}
    coded = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for _, words in rows]
    codes = np.concatenate(coded) if coded else np.empty(0, np.int64)
    where = np.concatenate([s + np.arange(len(c)) for s, c in zip(starts, coded)]) if coded else codes
    order = np.argsort(codes, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(number)))])
    return [[i for i, _ in rows], starts, [len(w) for _, w in rows], list(number), offsets.astype("<u4").tobytes(), where[order].astype("<u4").tobytes()]


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """A stored index of all words of all texts: one row per segment of documents, so no term's postings meet in one task. Repeated doc_ids keep a place each. segment is a stored id of the row."""

    def run(batches):
        held, total = [], 0
        names = [f.split(" ")[0] for f in _INDEX.split(", ")]
        kinds = [pa.list_(pa.int64())] * 3 + [pa.list_(pa.binary()), pa.binary(), pa.binary()]
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), values(batch.column(1))):
                words = alnum_words(raw)
                held.append((i, words))
                total += len(words) + GAP
                if total >= segment_words:
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(_segment(held), kinds)], names)
                    held, total = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(_segment(held), kinds)], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return materialize(texts.mapInArrow(released(run), _INDEX).withColumn("segment", F.expr("uuid()")), "positional-index", **LARGE_ROWS)


class Segment:
    """Look-ups in one index row."""

    def __init__(self, terms: list[bytes], offsets: bytes, postings: bytes) -> None:
        self.number = {t: i for i, t in enumerate(terms)}
        self.offsets = np.frombuffer(offsets, "<u4")
        self.postings = np.frombuffer(postings, "<u4")

    def positions(self, n: int) -> np.ndarray:
        return self.postings[self.offsets[n] : self.offsets[n + 1]]

    def phrase(self, numbers: tuple[int, ...]) -> np.ndarray:
        """First positions of exact occurrences: lists moved by their word's offset, intersected from the rarest on."""
        lists = sorted(((self.positions(w), k) for k, w in enumerate(numbers)), key=lambda x: len(x[0]))
        first = lists[0][0].astype(np.int64) - lists[0][1]
        for found, k in lists[1:]:
            if not len(first):
                break
            at = np.searchsorted(found, first + k)
            at[at == len(found)] = 0
            first = first[found[at] == first + k]
        return first

    def proximity(self, numbers: tuple[int, ...], span: int) -> np.ndarray:
        """Positions of the rarest word where all words lie within `span` words around it, in any order."""
        distinct = sorted(set(numbers), key=lambda w: len(self.positions(w)))
        here = self.positions(distinct[0]).astype(np.int64)
        for w in distinct[1:]:
            found = self.positions(w).astype(np.int64)
            at = np.searchsorted(found, here - span)
            here = here[(at < len(found)) & (found[np.minimum(at, len(found) - 1)] <= here + span)]
        return here


def _item_blocks(items: DataFrame, block_bytes: int):
    """Items (id, windows) in blocks of bounded text; one block at a time is on the driver."""
    sized = items.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).where(F.col("item_id").isNotNull())
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(total // block_bytes)
    for b in range(blocks):
        part = sized if blocks == 1 else sized.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        yield blocks, [(r["item_id"], r["text"]) for r in part.collect()]


def matches(index: DataFrame, items: DataFrame, window: int = WINDOW, span: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every document of the index: doc_id, n_words, hits array<struct<first, last>> (word positions of merged
    occurrences), items array<long> (item_ids with occurrences). With span, proximity matches instead of exact phrases."""
    spark, found = index.sparkSession, None
    schema = "segment string, place int, doc_id long, n_words long, hits array<struct<first:long,last:long>>, items array<long>"
    for blocks, rows in _item_blocks(items, block_bytes):
        shared = spark.sparkContext.broadcast(ItemBlock(rows, window))

        def run(batches, shared=shared):
            wanted = shared.value
            for batch in batches:
                for at in range(batch.num_rows):
                    yield _search(batch.slice(at, 1).to_pylist()[0], wanted, span)

        part = index.mapInArrow(released(run), schema)
        found = part if found is None else found.unionAll(part)
        if blocks == 1:
            return found.select("doc_id", "n_words", "hits", "items")
    merged = found.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    return merged.select("doc_id", "n_words", "hits", "items")


def _search(row: dict, wanted: ItemBlock, span: int | None) -> pa.RecordBatch:
    seg = Segment(row["terms"], row["offsets"], row["postings"])
    starts, sizes = np.array(row["starts"], np.int64), np.array(row["sizes"], np.int64)
    hits: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[int]] = {}
    known: dict[tuple[int, ...], list[int]] = {}
    for numbers, owner in wanted.present(seg.number):
        docs = known.get(numbers)
        if docs is None:
            at = seg.phrase(numbers) if span is None else seg.proximity(numbers, span)
            docs = (np.searchsorted(starts, at, side="right") - 1).tolist()
            for doc, p in zip(docs, at.tolist()):
                first = p - int(starts[doc])
                hits.setdefault(doc, []).append((first, first + (len(numbers) if span is None else 1) - 1))
            docs = known[numbers] = sorted(set(docs))
        for doc in docs:
            items.setdefault(doc, set()).add(owner)
    n = len(starts)
    merged = [[{"first": a, "last": b} for a, b in merge_spans(hits.get(i, []))] for i in range(n)]
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row["segment"]] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(row["ids"], pa.int64()), pa.array(sizes),
            pa.array(merged, kind), pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.int64())),
        ],
        ["segment", "place", "doc_id", "n_words", "hits", "items"],
    )


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, joined where they touch or overlap; ends included."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs.

    Null and empty texts have no words and no hits; items without words or with a null id never match; items that
    share an id count once; repeated documents are judged each; a document with occurrences of two or more items is
    contaminated; extra columns are ignored; empty tables give an empty result or no hits."""
    index = build_index(docs)
    found = matches(index, items, window, block_bytes=block_bytes)
    # hits of one block are merged already; several blocks' spans are merged by their covered positions
    covered = F.aggregate(
        F.array_sort("hits"), F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, h: F.struct(F.greatest(acc["last"], h["last"]).alias("last"), (acc["n"] + F.greatest(F.lit(0).cast("long"), h["last"] - F.greatest(acc["last"], h["first"] - 1))).alias("n")),
        lambda acc: acc["n"],
    )
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    judged = found.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated")
    )
    return reading(judged, index)
