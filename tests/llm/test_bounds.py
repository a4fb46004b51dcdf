"""Stored tables whose rows are large: what a task holds at once is bounded by row groups, not by the size of a file."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from codexmill.llm import decontam


def test_an_index_file_has_small_row_groups(spark):
    """80 segments of some 100 KB in one file: fewer rows than the writer's first look at sizes used to wait for."""
    words = F.transform(F.sequence(F.lit(1), F.lit(6_000)), lambda k: F.sha1((F.col("doc_id") * 6_000 + k).cast("string")))
    docs = spark.range(80).select(F.col("id").alias("doc_id")).coalesce(1).withColumn("text", F.array_join(words, " "))
    index = decontam.build_index(docs, segment_words=6_000)
    files = glob.glob(index.stored_at.removeprefix("file://").removeprefix("file:") + "/*.parquet")
    groups = [m.row_group(k) for m in (pq.ParquetFile(f).metadata for f in files) for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 80 and sum(g.total_byte_size for g in groups) > 20 << 20
    assert max(g.total_byte_size for g in groups) < 8 << 20
