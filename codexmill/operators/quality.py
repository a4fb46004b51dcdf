"""Findings: rules over rows and relations, their counts, and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"


def rule_findings(rows: DataFrame, ref: Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(check_name, severity, ref): one row for each rule (name, severity, condition) that holds on a row. A null condition does not hold."""
    found = F.filter(F.array(*[F.when(test, F.struct(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"))) for name, severity, test in rules]), lambda x: x.isNotNull())
    return rows.select(ref.cast("string").alias("ref"), F.explode(found).alias("f")).select("f.check_name", "f.severity", "ref")


def missing_references(rows: DataFrame, key: str, other: DataFrame, other_key: str, name: str, severity: str = ERROR) -> DataFrame:
    """Findings for non-null keys of rows that other lacks."""
    lost = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct().join(other.select(F.col(other_key).alias("k")), "k", "left_anti")
    return lost.select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), F.col("k").cast("string").alias("ref"))


def repeated_keys(rows: DataFrame, keys: list[str], name: str, severity: str = ERROR) -> DataFrame:
    many = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return many.select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("ref"))


def summarise(findings: DataFrame) -> DataFrame:
    """(severity, check_name, n) by severity, by check and in all, in one pass; null stands for all."""
    return findings.groupingSets([["severity"], ["check_name"], []], "severity", "check_name").agg(F.count("*").alias("n"))


def vector_findings(rows: DataFrame, key: str, vector: str, dim: int, tolerance: float = 1e-2) -> DataFrame:
    """Gate over embeddings: length, NaN or infinite values, zero vectors, norms off one, equal vectors of several rows."""
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    own = rule_findings(rows, F.col(key), [("dimension", ERROR, F.size(v) != dim), ("not_finite", ERROR, bad), ("zero_vector", ERROR, norm == 0), ("norm", ERROR, (norm > 0) & (F.abs(norm - 1) > tolerance))])
    same = rows.groupBy(F.xxhash64(vector).alias("h"), v.alias("v")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")
    return own.unionByName(same.select(F.lit("equal_vectors").alias("check_name"), F.lit(WARNING).alias("severity"), F.col("first").cast("string").alias("ref")))


def ready(findings: DataFrame) -> DataFrame:
    """One row (n_errors, n_warnings, ready)."""
    return findings.agg(F.count_if(F.col("severity") == ERROR).alias("n_errors"), F.count_if(F.col("severity") == WARNING).alias("n_warnings")).withColumn("ready", F.col("n_errors") == 0)


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One row (n, fingerprint): sha256 over the sorted hashes of all rows, whatever their order.

    Hashes are sorted in buckets by their first two digits, so no task holds all of them; the 256 bucket hashes are hashed."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    one = rows.select(h.alias("h")).groupBy(F.left("h", F.lit(2)).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return one.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"))
