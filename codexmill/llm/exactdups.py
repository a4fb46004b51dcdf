"""Exact duplicates by an extendible-hash index on shared files."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.llm.common import materialize, reading, released, values

#: Bits of a key; a bucket holds the keys that share its leading bits.
KEY_BITS = 63
#: The directory doubles up to 2^16 slots: what is broadcast is 512 KB at most. A bucket that is still overfull then is
#: read like any other, as owners stream their keys in order and never hold a bucket.
MAX_DEPTH = 16
#: A bucket is overfull beyond this, or beyond a part of an owner's even share, so that shares come out even.
BUCKET_BYTES, SHARE = 32 << 20, 8
#: Text that an owner gets at most, on average; more owners than shuffle partitions are named where there is more.
OWNER_BYTES = 256 << 20
#: A task sends on what it has collapsed at so many bytes of text or ids; a record lists at most RECORD_IDS of its rows.
HELD_BYTES, RECORD_IDS = 32 << 20, 8_192
#: Records of one text that meet one copy of its entry when rows look up what became of them.
RECORDS_PER_COPY = 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def key_of(raw: bytes, bits: int = KEY_BITS) -> int:
    """The leading `bits` of the normalised text's hash, in the leading places of a key; fewer bits make keys collide."""
    return (xxhash.xxh64_intdigest(raw) >> 64 - bits) << KEY_BITS - bits


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


class _Collapsed:
    """Rows of a task by text: equal bytes are one record with the ids of its rows."""

    def __init__(self, bits: int) -> None:
        self.bits, self.records, self.size = bits, {}, 0

    def add(self, doc: int | None, text: bytes) -> None:
        ids = self.records.get(text)
        if ids is None:
            ids = self.records[text] = []
            self.size += len(text) + 200
        ids.append(doc)
        self.size += 8

    def taken(self):
        """(key, text, ids) of what is held; nothing is held afterwards."""
        held, self.records, self.size = self.records, {}, 0
        for text, ids in held.items():
            key = key_of(text, self.bits)
            for at in range(0, len(ids), RECORD_IDS):
                yield key, text, ids[at : at + RECORD_IDS]


def _collapsed(batches, bits: int):
    """Lists of (key, text, ids), each of bounded size, over the rows of a task."""
    held = _Collapsed(bits)
    for batch in batches:
        for doc, raw in zip(batch.column(0).to_pylist(), values(batch.column(1))):
            held.add(doc, raw.translate(_LOWER))
            if held.size >= HELD_BYTES:
                yield held.taken()
    yield held.taken()


class Directory:
    """Extendible hashing over cells: `slots` has 2^depth places, each naming a bucket; a bucket of local depth l has 2^(depth - l) places.

    cell, size, least, most: the cells (leading MAX_DEPTH bits of keys) that have records, in order, with the records' bytes
    and the least and greatest key."""

    def __init__(self, cell: np.ndarray, size: np.ndarray, least: np.ndarray, most: np.ndarray, capacity: int) -> None:
        self.cell, self.size, self.least, self.most = cell, size, least, most
        self.depth, self.slots, self.local = 0, np.zeros(1, np.int32), [0]
        overfull = [(0, 0)] if self._overfull(0, 0, capacity) else []
        while overfull:
            prefix, at = overfull.pop()
            for half in self._split(prefix, at):
                if self._overfull(*half, capacity):
                    overfull.append(half)

    def _cells(self, prefix: int, local: int) -> slice:
        shift = MAX_DEPTH - local
        return slice(*np.searchsorted(self.cell, [prefix << shift, (prefix + 1) << shift]))

    def load(self, prefix: int, local: int) -> int:
        return int(self.size[self._cells(prefix, local)].sum())

    def _overfull(self, prefix: int, local: int, capacity: int) -> bool:
        """Copies of one key are no reason to split: a bucket must hold two keys, and more than its capacity."""
        own = self._cells(prefix, local)
        return local < MAX_DEPTH and own.stop > own.start and self.load(prefix, local) > capacity and self.least[own].min() < self.most[own].max()

    def _split(self, prefix: int, local: int) -> list[tuple[int, int]]:
        if local == self.depth:  # every place stands twice now
            self.slots, self.depth = np.repeat(self.slots, 2), self.depth + 1
        width = 1 << self.depth - local
        first = prefix * width
        self.local[self.slots[first]] = local + 1
        self.slots[first + width // 2 : first + width] = len(self.local)
        self.local.append(local + 1)
        return [(2 * prefix, local + 1), (2 * prefix + 1, local + 1)]

    def owners(self, count: int) -> np.ndarray:
        """The owner of each slot: runs of whole buckets in key order, even by bytes."""
        heads = np.flatnonzero(np.diff(self.slots, prepend=-1))
        loads = np.array([self.load(h >> self.depth - self.local[self.slots[h]], self.local[self.slots[h]]) for h in heads], np.float64)
        middle = np.cumsum(loads) - loads / 2
        own = np.minimum((middle * count / max(loads.sum(), 1)).astype(np.int32), count - 1)
        return np.repeat(own, np.diff(np.append(heads, len(self.slots))))


def build_directory(docs: DataFrame, bits: int = KEY_BITS, capacity: int | None = None) -> tuple[Directory, int]:
    """(the directory for the records of docs, how many owners share it): one pass counts bytes by cell; cells are at most
    2^MAX_DEPTH rows, whatever docs hold."""

    def run(batches):
        for records in _collapsed(batches, bits):
            found = [(key, len(text) + 8 * len(ids)) for key, text, ids in records]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["key", "size"])

    sizes = _texts(docs).mapInArrow(released(run), "key long, size long")
    cell = F.shiftright("key", KEY_BITS - MAX_DEPTH).alias("cell")
    rows = sizes.groupBy(cell).agg(F.sum("size").alias("size"), F.min("key").alias("least"), F.max("key").alias("most")).toPandas().sort_values("cell")
    total = int(rows["size"].sum())
    owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // OWNER_BYTES))
    directory = Directory(*[rows[c].to_numpy(np.int64) for c in ("cell", "size", "least", "most")], capacity or min(BUCKET_BYTES, max(1, total // (SHARE * owners))))
    return directory, owners


def _routed(docs: DataFrame, directory: Directory, owners: int, bits: int) -> DataFrame:
    """(owner, bucket, key, text, ids): the records of docs, collapsed in each task."""
    shared = docs.sparkSession.sparkContext.broadcast((directory.depth, directory.slots, directory.owners(owners)))
    names, kinds = ["owner", "bucket", "key", "text", "ids"], [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def run(batches):
        depth, slots, owner = shared.value
        for records in _collapsed(batches, bits):
            rows, size = [], 0
            for key, text, ids in records:
                at = key >> KEY_BITS - depth
                rows.append((int(owner[at]), int(slots[at]), key, text, ids))
                size += len(text)
                if size >= HELD_BYTES // 8:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return _texts(docs).mapInArrow(released(run), "owner int, bucket int, key long, text binary, ids array<long>")


_INDEX = "bucket int, key long, chain int, record long, ids array<long>, text binary, group_size long, keep_id long, keep_record long, keep_at int, records long, sha256 string"
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]


class _Entry:
    """A text of a chain: rows so far, and the row that stays: the largest id, null below all, the first of equals."""

    def __init__(self, text: bytes) -> None:
        self.text, self.rows, self.records, self.best, self.keep = text, 0, 0, None, (0, 0)

    def insert(self, ids: list[int | None]) -> int:
        record = self.records
        known = [i for i in ids if i is not None]
        most = max(known) if known else None
        if most is not None and (self.best is None or most > self.best):
            self.best, self.keep = most, (record, ids.index(most))
        self.rows += len(ids)
        self.records += 1
        return record


def _chained(batches):
    """An owner's records, in the order of keys: each is compared, byte by byte, with the texts chained under its key.

    Gives a row for each record (the place of its text in the chain, its ids) and, when a key is done, one for each of its
    texts (the text, its totals). Only the texts of one key are held."""
    names = [f.split(" ")[0] for f in _INDEX.split(", ")]
    rows, size, now, bucket, chain = [], 0, None, None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names)

    def closed() -> int:
        for place, e in enumerate(chain):
            rows.append((bucket, now, place, None, None, e.text, e.rows, e.best, *e.keep, e.records, hashlib.sha256(e.text).hexdigest()))
        return sum(len(e.text) for e in chain)

    for batch in batches:
        columns = (values(batch.column(n)) for n in range(1, 5))
        for own, key, text, ids in zip(*columns):
            if key != now:
                size += closed()
                now, bucket, chain = key, own, []
            place = next((n for n, e in enumerate(chain) if e.text == text), len(chain))
            if place == len(chain):
                chain.append(_Entry(text))
            rows.append((bucket, key, place, chain[place].insert(ids), ids, *[None] * 7))
            size += 8 * len(ids) + 100
            if size >= HELD_BYTES // 8:
                yield made()
                rows, size = [], 0
    closed()
    if rows:
        yield made()


def build_index(docs: DataFrame, bits: int = KEY_BITS, capacity: int | None = None) -> DataFrame:
    """The stored index of docs(doc_id, text): entries (a text of a bucket's chain, with totals) and records (rows of it), see _INDEX.

    A first pass sizes the directory: a bucket over its capacity splits on the next bit of its keys, and the directory
    doubles where the bucket is as deep as itself. Owners take runs of whole buckets, even by bytes; they get their records
    in one shuffle, ordered by key, and write their files in the shared folder. Equal texts of a task are one record before they
    are shuffled, so a text that a third of all rows repeat reaches its owner once from each task, not from each row."""
    directory, owners = build_directory(docs, bits, capacity)
    dealt = _routed(docs, directory, owners, bits).repartitionById(owners, F.col("owner")).sortWithinPartitions("key")
    return materialize(dealt.mapInArrow(released(_chained), _INDEX), "exact-index")


def exact_duplicates(docs: DataFrame, bits: int = KEY_BITS, capacity: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs(doc_id, text), dropped ones too.

    Texts are equal if their bytes are after A-Z is lowered; of equal ones the row with the largest doc_id stays, rows with a
    null id only if there is no other (keep_id is null then), and of rows that share id and text exactly one. Null texts count
    as empty, empty ones are equal to each other; an empty table gives an empty result; extra columns are ignored, whatever
    their names; a text may be as long as a row may.

    Rows find their entry by key and place in its chain. An entry of many records stands in several copies, one for each
    RECORDS_PER_COPY of them, so the rows of a hot text are not gathered."""
    index = build_index(docs, bits, capacity)
    copies = F.sequence(F.lit(0).cast("long"), F.floor((F.col("records") - 1) / RECORDS_PER_COPY).cast("long"))
    entries = index.where("group_size is not null").select("key", "chain", F.explode(copies).alias("copy"), "group_size", "keep_id", "keep_record", "keep_at", "sha256")
    records = index.where("record is not null").select("key", "chain", F.floor(F.col("record") / RECORDS_PER_COPY).cast("long").alias("copy"), "record", "ids")
    rows = records.join(entries, ["key", "chain", "copy"]).select("*", F.posexplode("ids").alias("at", "doc_id"))
    kept = (F.col("record") == F.col("keep_record")) & (F.col("at") == F.col("keep_at"))
    return reading(rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha256").alias("text_sha256")), index)
