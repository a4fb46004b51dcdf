"""SimHash near-duplicates, compared in bit-sliced blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.llm.common import discard, materialize, reading, released, values
from codexmill.llm.graph import connected_components

SEED = 42
RADIUS = 2
#: Members of one bucket that a single task compares; larger buckets go the way of one-flip neighbours.
BUCKET_ROWS = 32_768
#: Rows that one bit-sliced batch may gather from small buckets.
BATCH_ROWS = 65_536
_CHUNK = 65_536
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(raw: bytes) -> int:
    """64 bits: bit i is set if over half of the 3-word shingles' XXH64 (seed 42) have it. No words: 0."""
    words = raw.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= 3:
        hashes = [h(flat, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.empty_like(ends)
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
        hashes = [h(flat[a:b], SEED) for a, b in zip(starts[:-2].tolist(), ends[2:].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[at : at + _CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp as a signed long) for every row of docs."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in values(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(released(run), "doc_id long, fp long")


def _block_bounds(blocks: int) -> list[tuple[int, int]]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return list(zip(edges[:-1], edges[1:]))


def block_count(rows: int, radius: int = RADIUS) -> int:
    """Blocks to cut 64 bits into, so that random fingerprints meet in buckets of few. Any choice links the same pairs."""
    for blocks in range(radius + 1, radius + 5):
        if rows / 2.0 ** (64 * (blocks - radius) // blocks) <= 16:
            return blocks
    return radius + 5


def _bucket_rows(nodes: DataFrame, blocks: int, radius: int) -> DataFrame:
    """(key, fp) once for each choice of blocks - radius blocks: fingerprints within the radius agree in all blocks of at least one choice."""
    bounds, keys = _block_bounds(blocks), []
    for i, choice in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (b - a)) - 1) << a for a, b in (bounds[c] for c in choice))
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(mask))))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")


class _Sets:
    """Union-find over row numbers with vectorised look-ups."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Pairs that really joined two sets, a spanning part of all given."""
        p, made = self.parent, []
        differ = p[a] != p[b]
        for i, j in zip(a[differ].tolist(), b[differ].tolist()):
            x, y = i, j
            while p[x] != x:
                x = p[x]
            while p[y] != y:
                y = p[y]
            if x != y:
                p[max(x, y)] = min(x, y)
                made.append((i, j))
        if made:
            while True:
                up = p[p]
                if (up == p).all():
                    break
                p = up
            self.parent = p
        return made


def bit_sliced_links(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Row pairs that span all links between fps of the same key (keys sorted) at `radius` or fewer differing bits.

    Plane k holds bit k of all rows, 64 rows a word. For each distance s between rows, plane k is compared with itself
    moved by s, and 64 distances at once are counted in binary counters, one word for each binary digit, by carry-save
    addition. Counters start so that the (radius + 1)-th difference carries out of the top digit. Words in which every
    pair has carried out (or lies in two buckets) are abandoned."""
    n = len(fps)
    if n < 2:
        return []
    last = np.searchsorted(keys, keys, side="right") - 1
    ahead = last - np.arange(n)
    words = (n + 63) // 64
    bits = np.unpackbits(np.ascontiguousarray(fps).astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.zeros((64, words * 8), np.uint8)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    planes[:, : packed.shape[1]] = packed
    planes = np.concatenate([planes.view("<u8"), np.zeros((64, 1), "<u8")], axis=1)
    reach = np.zeros(words * 64, np.int64)
    reach[:n] = ahead
    reach = reach.reshape(words, 64)
    furthest = reach.max(axis=1)
    digits = max(1, radius.bit_length())
    start = (1 << digits) - (radius + 1)
    sets, out = _Sets(n), []
    top = words
    for s in range(1, int(ahead.max()) + 1):
        live = np.nonzero(furthest >= s)[0]
        over = ~np.packbits(reach[live] >= s, axis=1, bitorder="little").view("<u8")[:, 0]
        q, r = divmod(s, 64)
        count = [np.full(len(live), _ALL if start >> d & 1 else 0, np.uint64) for d in range(digits)]
        for k in range(64):
            plane = planes[k]
            moved = plane[np.minimum(live + q, top)]
            if r:
                moved = (moved >> np.uint64(r)) | (plane[np.minimum(live + q + 1, top)] << np.uint64(64 - r))
            carry = plane[live] ^ moved
            for d in range(digits):
                count[d], carry = count[d] ^ carry, count[d] & carry
            over = over | carry
            if k % 6 == 5:
                alive = over != _ALL
                left = int(alive.sum())
                if not left:
                    live = live[:0]
                    break
                if left < 0.7 * len(live):
                    live, over, count = live[alive], over[alive], [c[alive] for c in count]
        if len(live):
            hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, b = np.nonzero(hit)
            if len(w):
                a = live[w] * 64 + b
                out += sets.join(a, a + s)
    return out


def _link_batches(batches, radius: int):
    """Streams sorted (key, fp) rows; compares whole buckets, holding back the last key until its end is seen."""

    def flush(keys, fps):
        for at, to in _cuts(keys):
            k, f = keys[at:to], fps[at:to]
            pairs = bit_sliced_links(k, f.view(np.uint64), radius)
            if pairs:
                i, j = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(f[i]), pa.array(f[j])], ["u", "v"])

    held_k, held_f = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        held_k = np.concatenate([held_k, batch.column(0).to_numpy()])
        held_f = np.concatenate([held_f, batch.column(1).to_numpy()])
        if len(held_k) >= BATCH_ROWS and held_k[0] != held_k[-1]:
            cut = int(np.searchsorted(held_k, held_k[-1], side="left"))
            yield from flush(held_k[:cut], held_f[:cut])
            held_k, held_f = held_k[cut:], held_f[cut:]
    yield from flush(held_k, held_f)


def _cuts(keys: np.ndarray):
    """Large buckets alone, runs of small ones together without their single rows' cost."""
    n = len(keys)
    if not n:
        return
    firsts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1])
    sizes = np.diff(np.concatenate([firsts, [n]]))
    at = 0
    for first, size in zip(firsts[sizes > 512].tolist(), sizes[sizes > 512].tolist()):
        if first > at:
            yield at, first
        yield first, first + size
        at = first + size
    if at < n:
        yield at, n


def _flip_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links inside over-full buckets without comparing pairs: each fingerprint goes to itself and to its 64 one-flip
    neighbours; two meet at a common neighbour exactly if they differ in at most 2 bits. Only for radius 2."""
    if radius != 2:
        raise ValueError("over-full buckets are resolved for radius 2 only")
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    met = rows.select("fp").distinct().select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("meet"))
    least = met.groupBy("meet").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    return met.join(least, "meet").select(F.col("fp").alias("u"), "v").where("u <> v").distinct()


def links(nodes: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(u, v): links that span the near-duplicate graph of distinct fingerprints nodes(fp)."""
    rows = _bucket_rows(nodes, block_count(nodes.count(), radius), radius)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    hot = sizes.where(F.col("n") > bucket_rows)
    over_full = not hot.isEmpty()
    if over_full:
        hot = materialize(hot.select("key"), "hot-buckets")
        cold = rows.join(hot, "key", "left_anti")
    else:
        cold = rows
    dealt = cold.repartition("key").sortWithinPartitions("key", "fp")
    found = dealt.mapInArrow(lambda batches: _link_batches(batches, radius), "u long, v long")
    if over_full:
        found = found.unionAll(_flip_links(rows.join(hot, "key", "left_semi"), radius))
    return found


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) for every row of docs.

    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows appear as often as given;
    component_id is the least non-null doc_id of the component (null if it has none); extra columns are ignored;
    an empty table gives an empty result."""
    fps = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprint-nodes")
    groups = connected_components(links(nodes.select("fp"), radius, bucket_rows))
    tagged = nodes.join(groups, nodes.fp == groups.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    tagged = materialize(tagged, "fingerprint-groups")
    discard(nodes, *groups.reads)
    heads = tagged.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = tagged.join(heads, "component").select("fp", "component_id")
    return reading(fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), fps, tagged)
