"""Published tables of rows: write, audit, publish; JSON lines; ragged rows as CSV; manifests of raw files."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codexmill.operators.quality import ERROR


class PublishError(RuntimeError):
    """The audit found errors, or the place is taken."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def row_hash(rows: DataFrame) -> str:
    """One digest of all rows, whatever their order: sums of two hashes of each row, and the count."""
    both = [F.sum(F.xxhash64(F.lit(seed), F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")) for seed in (1, 2)]
    r = rows.agg(F.count("*").alias("n"), both[0].alias("a"), both[1].alias("b")).first()
    return f"{r['n']}:{int(r['a'] or 0)}:{int(r['b'] or 0)}"


def publish(rows: DataFrame, path: str, audit, facts: dict | None = None) -> dict:
    """Writes rows beside `path`, audits what was written (audit(rows) gives findings with a severity), then renames it
    to `path` with its manifest. Nothing appears at `path` if the audit finds an error; nothing there is ever overwritten."""
    spark, staged = rows.sparkSession, f"{path.rstrip('/')}.staging"
    fs, final = _fs(spark, path)
    if fs.exists(final):
        raise PublishError(f"{path} is there already")
    rows.write.mode("overwrite").parquet(f"{staged}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{staged}/rows")
    if errors := audit(stored).where(F.col("severity") == ERROR).count():
        raise PublishError(f"{errors} errors found in {staged}")
    manifest = {"schema": json.loads(rows.schema.json()), "row_hash": row_hash(stored), "n_rows": stored.count(), **(facts or {})}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{staged}/manifest")
    if not fs.rename(_fs(spark, staged)[1], final):
        raise PublishError(f"{path} could not be taken")
    return manifest


def load(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a published table, if they are those of its manifest."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    rows = spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(f"{path}/rows")
    if row_hash(rows) != manifest["row_hash"]:
        raise PublishError(f"the rows of {path} are not those of its manifest")
    return rows


def json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of JSON lines; blank lines are ignored; a missing file has none."""
    fs, where = _fs(spark, path)
    return spark.read.schema(schema).json(path) if fs.exists(where) else spark.createDataFrame([], schema)


def ragged_csv(parts: list[DataFrame], path: str) -> None:
    """One CSV table of parts with unlike columns: the header is the sorted union of all."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    whole.select(sorted(whole.columns)).write.option("header", True).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of the raw files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
