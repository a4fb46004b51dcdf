"""Training-order materialisation: token sequences in permuted global order, in fixed-stride binary shards."""

from __future__ import annotations

import hashlib
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.llm import bpe
from codexmill.llm.common import cleaned_shuffles, discard, materialize, released, shared_dir

SEQUENCE = 512
KEY = 20_240_229
ROUNDS = 4
#: Sequences in one shard file.
SHARD_ROWS = 8_192
#: Consecutive shards that one task writes at most, and tasks wanted for each core before shards share one.
TASK_SHARDS, CORE_TASKS = 16, 4
#: Rounds in which shards are written. Each reads the stored sequences again; only its own shuffle is on disk meanwhile.
ROUNDS_OF_SHARDS = 2
#: A record is the sequence as little-endian 16-bit ids, then one line feed: the stride of every shard.
STRIDE = 2 * SEQUENCE + 1


def _round_value(half: Column, key: int, turn: int, mask: int) -> Column:
    return F.xxhash64(half, F.lit(key), F.lit(turn)).bitwiseAND(F.lit(mask))


def _half_bits(n: int) -> int:
    bits = max(2, (max(1, n - 1)).bit_length())
    return (bits + 1) // 2


def feistel(index: Column, n: int, key: int = KEY) -> Column:
    """One pass of a balanced Feistel network: a permutation of the least even power of two not below n."""
    half = _half_bits(n)
    mask = (1 << half) - 1
    left, right = F.shiftright(index, half), index.bitwiseAND(F.lit(mask))
    for turn in range(ROUNDS):
        left, right = right, left.bitwiseXOR(_round_value(right, key, turn, mask))
    return F.shiftleft(left, half).bitwiseOR(right)


def permuted(df: DataFrame, index: str, n: int, key: int = KEY, out: str = "slot") -> DataFrame:
    """df plus the slot of each index: a permutation of 0..n-1 by cycle-walking. Values of n or more go through the
    network again until all lie below n; the domain is under 4 n, so each pass leaves few of them."""
    walk = feistel(F.col(index), n, key)
    df = df.withColumn(out, walk)
    domain = 1 << (2 * _half_bits(n))
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(_walks(n, domain))),
        F.col(out),
        lambda at, _: F.when(at < n, at).otherwise(feistel(at, n, key)),
    )
    df = df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(step))
    return df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(F.raise_error(F.lit("cycle-walk did not end"))))


def _walks(n: int, domain: int) -> int:
    """So many passes that an index still outside has odds under 2 ** -80 over all n (at most 512)."""
    inside = n / domain
    if inside >= 1:
        return 1
    return min(512, 1 + int((80 + n.bit_length()) * 0.6931 / -np.log1p(-inside)))


_PIECES = [("doc_id", pa.int64()), ("doc_offset", pa.int64()), ("first", pa.int32()), ("n", pa.int32())]


def sequences(docs: DataFrame, path: str, length: int = SEQUENCE) -> DataFrame:
    """(n_tokens, pieces, tokens binary, digest binary): the token stream of each partition of docs, cut into `length` ids.

    Every text gives its ids and one end id; a text goes on in the next sequence, and the next text follows it at once.
    Only the last sequence of a partition is filled up with end ids; n_tokens counts those before. digest is the SHA-256 of
    tokens. pieces, in stream order, are struct<doc_id, doc_offset, first, n>: n ids of a document from its id number
    doc_offset on stand from place first on. Null and empty texts have their end id only; rows with a null doc_id keep their null."""

    def run(batches):
        tokenizer = bpe.load(path)
        if tokenizer.code != "H":
            raise ValueError("records hold 16-bit ids")
        end = max(tokenizer.bytes_of).to_bytes(2, sys.byteorder)
        stride, now = 2 * length, bytearray()
        records, counts, ends = [], [], [0]
        pieces: tuple[list, ...] = ([], [], [], [])

        def cut() -> None:
            records.append(bytes(now) + end * (length - len(now) // 2))
            counts.append(len(now) // 2)
            ends.append(len(pieces[0]))
            now.clear()

        def made() -> pa.RecordBatch:
            inner = pa.StructArray.from_arrays([pa.array(v, k) for v, (_, k) in zip(pieces, _PIECES)], [f for f, _ in _PIECES])
            raw = records if sys.byteorder == "little" else [np.frombuffer(r, "u2").astype("<u2").tobytes() for r in records]
            digests = [hashlib.sha256(r).digest() for r in raw]
            columns = [pa.array(counts, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner), pa.array(raw, pa.binary()), pa.array(digests, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["n_tokens", "pieces", "tokens", "digest"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), tokenizer.encode_column(batch.column(1))):
                packed, at = ids + end, 0
                while at < len(packed):
                    take = min(stride - len(now), len(packed) - at)
                    for column, value in zip(pieces, (doc, at // 2, len(now) // 2, take // 2)):
                        column.append(value)
                    now += packed[at : at + take]
                    at += take
                    if len(now) == stride:
                        cut()
                if len(records) >= 4096:  # the open sequence's pieces wait for it
                    wait = tuple(column[ends[-1] :] for column in pieces)
                    for column in pieces:
                        del column[ends[-1] :]
                    yield made()
                    records, counts, ends, pieces = [], [], [0], wait
        if now:
            cut()
        if records:
            yield made()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(released(run), "n_tokens int, pieces array<struct<doc_id:long,doc_offset:long,first:int,n:int>>, tokens binary, digest binary")


def _numbered(stored: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """(rows of a stored Parquet table plus a dense index 0..n-1, n, a stored table that the rows read): the rows of the files
    before, and the row's place in its file.

    Both are properties of the files, so a task that runs again, or another job, gives the same index. What is joined has a
    row for each file, and so has the one window without a partition; it is broadcast only if Spark finds it small."""
    marked = stored.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = materialize(marked.groupBy("__file").agg(F.count("*").alias("n")), "sequence-files")
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rows = marked.join(starts, "__file").withColumn("index", F.col("start") + F.col("__row")).drop("__file", "__row", "start")
    return rows, sizes.agg(F.sum("n")).first()[0] or 0, sizes


def write_training_order(docs: DataFrame, path: str, folder: str | None = None, length: int = SEQUENCE, shard_rows: int = SHARD_ROWS, key: int = KEY) -> tuple[DataFrame, str]:
    """Writes the shards and returns (stored manifest, folder).

    Every sequence gets one of the slots 0..n-1 by a keyed permutation of a dense index. Slots s with s div shard_rows = k
    form shard k, in slot order, at offset (s mod shard_rows) * stride of its one file: a reader at any slot seeks there
    and reads on. A task writes some consecutive shards; they are written in rounds, so that a part of the records is
    shuffled at a time, and the last round leaves _SUCCESS. Files go through Spark's own writer and commit, so a lost
    executor's tasks are run again. manifest: slot, shard, offset, n_tokens, doc_ids, pieces, sha256 of the record's ids.
    The unpermuted sequences are deleted once shards and manifest stand.

    Repeated rows are written each; an empty table gives an empty manifest and no shards."""
    spark = docs.sparkSession
    stored = materialize(sequences(docs, path, length), "token-sequences", "zstd")
    numbered, n, sizes = _numbered(stored)
    folder = folder or f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    shards = -(-n // shard_rows)
    placed = permuted(numbered, "index", max(n, 1), key).withColumn("shard", F.floor(F.col("slot") / shard_rows).cast("long"))
    share = -(-shards // ROUNDS_OF_SHARDS)
    for first in range(0, shards, max(share, 1)):
        count = min(share, shards - first)
        tasks = max(-(-count // TASK_SHARDS), min(count, CORE_TASKS * spark.sparkContext.defaultParallelism))
        each = -(-count // tasks)
        # slots are dense, so equal ranges of slots need no sampling: range k goes to partition k
        # a filter would be pushed below the projections and work out each slot several times; an explode is not
        own = F.when((F.col("shard") >= first) & (F.col("shard") < first + count), F.array("slot"))
        chosen = placed.select("shard", "tokens", F.explode(own).alias("slot"))
        ranged = chosen.repartitionById(-(-count // each), F.floor((F.col("shard") - first) / each).cast("int")).sortWithinPartitions("shard", "slot")
        records = ranged.select("shard", F.col("tokens").cast("string").alias("value"))
        writer = records.write.mode("append" if first else "errorifexists").partitionBy("shard").option("lineSep", "\n")
        with cleaned_shuffles(spark):  # only the last round marks the folder as whole
            writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", str(first + count == shards).lower()).text(folder)
    manifest = materialize(
        placed.select("slot", "shard", ((F.col("slot") % shard_rows) * (2 * length + 1)).alias("offset"), "n_tokens", F.col("pieces.doc_id").alias("doc_ids"), "pieces", F.lower(F.hex("digest")).alias("sha256")),
        "token-manifest",
        "zstd",
    )
    discard(stored, sizes)
    return manifest, folder


def read_slots(spark, folder: str, first: int, count: int, length: int = SEQUENCE, shard_rows: int = SHARD_ROWS) -> list[np.ndarray]:
    """The sequences of slots first..first+count-1: each shard is opened once, read from the first slot's offset on."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf, out, stride = spark.sparkContext._jsc.hadoopConfiguration(), [], 2 * length + 1
    at, stop = first, first + count
    while at < stop:
        shard = at // shard_rows
        take = min(stop, (shard + 1) * shard_rows) - at
        where = hadoop.Path(f"{folder}/shard={shard}")
        fs = where.getFileSystem(conf)
        (name,) = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-")]
        stream = fs.open(name)
        try:
            stream.seek((at % shard_rows) * stride)
            raw = bytes(stream.readNBytes(take * stride))
        finally:
            stream.close()
        out += [np.frombuffer(raw[k * stride : k * stride + 2 * length], "<u2") for k in range(take)]
        at += take
    return out


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """The manifest of write_training_order over docs, for every sequence."""
    return write_training_order(docs, path)[0]
