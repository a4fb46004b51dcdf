"""Shared pieces: table access, shared-storage tables, held-out rule, byte-level word splitting."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of A-Z lowered; ASCII outside 0-9 and a-z becomes a space; bytes of non-ASCII characters stay.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else (b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32)
    for b in range(256)
)
#: Writer options for rows of megabytes: a row group is closed after few of them. By default sizes are first looked at after 100
#: rows, and a reader takes up to 4,096 rows of a row group at once.
LARGE_ROWS = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4}
#: Shuffle files go when the execution that wrote them ends (both names: the setting was renamed).
_CLEANUP = ("spark.sql.shuffleDependency.fileCleanup.enabled", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Unset on a local master, a local default is used; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return found.rstrip("/")


@contextmanager
def cleaned_shuffles(spark: SparkSession):
    """Shuffle files of what runs inside go when each execution ends."""
    before = {name: spark.conf.get(name, None) for name in _CLEANUP}
    for name in _CLEANUP:
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def materialize(df: DataFrame, label: str, codec: str = "snappy", **options: str | int) -> DataFrame:
    """Write df once as Parquet under the shared folder and return a scan of it; cuts lineage and survives lost executors.

    The shuffle files of the write go once it is done. The table stays until `discard` is called on what is returned. options
    are those of the Parquet writer, such as `LARGE_ROWS`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with cleaned_shuffles(spark):
        df.write.options(**options).parquet(path, compression=codec)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` returned, once nothing that is still to run reads them."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def reading(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df with the stored tables that it still reads named in `df.reads`: a caller who is done with df may discard them."""
    df.reads = tables
    return df


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind as keep it from the columns of df (compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str | None]:
    """(docs whose doc_id tells rows apart, the column that holds the ids given).

    Where ids are unique and none is null, docs are that already and come back as they are, with no such column. Else rows are
    stored with a row number for their id, in the order of doc_id, nulls last, then of a hash of the text, then of the row;
    texts are no sort keys, so none is sampled to the driver. Equal rows get numbers of their own."""
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if ids["n"] == ids["ids"]:
        return docs, None
    given = free_name(docs, "given_id")
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.xxhash64(*docs.columns))
    return materialize(ordered.withColumn(given, F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id()), "numbered-rows"), given


def with_given_ids(rows: DataFrame, given: str | None, columns: list[str]) -> DataFrame:
    """`columns` of numbered rows, doc_id being the id that was given."""
    return (rows if given is None else rows.withColumn("doc_id", F.col(given))).select(columns)


def values(column: pa.Array, rows: int = 256) -> Iterator:
    """The Python values of an Arrow column, a few at a time: a batch of long texts is never held twice."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def give_back() -> None:
    """Return freed memory of this process to the system; workers are kept for later tasks of other operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over the Arrow batches of a task, giving the worker's memory back when the task ends."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def held_out(id_col: Column) -> Column:
    """crc32 of the id's text is a multiple of 5; null ids are not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_labels(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(doc_id, label) of at most `rows` labelled documents outside the held-out fold, by a hash order of their ids.

    Rows with a null id or label are ignored; repeated ids take their largest label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, rows: int, *others: str) -> DataFrame:
    """(doc_id, text as bytes, others, label) of the bounded sample; the ids broadcast are at most `rows`.

    An id that rows repeat, however often, is one row here: the one with the least text."""
    picked = sample_labels(labels, column, rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *others)
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", *others, "label")).alias("r"))
    return found.select("doc_id", "r.*")


def alnum_words(raw: bytes) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII characters, A-Z lowered."""
    return raw.translate(_ALNUM).split()


class WordHasher:
    """32-bit hashes of words."""

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))


def mix_into(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) for uint64 arrays, in place."""
    moved = np.empty_like(h)
    for times in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        np.right_shift(h, np.uint64(33), out=moved)
        h ^= moved
        h *= np.uint64(times)
    np.right_shift(h, np.uint64(33), out=moved)
    h ^= moved
    return h


def mix(h: np.ndarray) -> np.ndarray:
    """`mix_into` of a copy."""
    return mix_into(np.array(h, np.uint64))
