"""Corpus pipeline: toxicity, SimHash near-dedup, substring dedup, benchmark decontamination, BPE encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.llm import bpe, decontam, simhash, substrings, toxicity
from codexmill.llm.common import discard, materialize, numbered, reading, table, with_given_ids
from codexmill.llm.queries import vocabulary

#: Not expressible in SQL: the toxicity model is fitted and SimHash needs XXH64; tests hold SimHash links and planted near passages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents scored below the threshold; those at it go. The model is fitted on the labelled rows of the given
    documents. Rows are judged each, whatever their id; null and empty texts have the score of the bias alone. A column
    of docs keeps its values whatever its name. An empty table stays empty."""
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), name=name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each group by doc_id, then a hash of the text; rows with a null id come last in their group and
    stay if it has no other. An id held by texts of different groups keeps a row in each; of equal rows one stays. Null,
    empty and blank texts are one group. An empty table stays empty; other columns are kept whatever their names."""
    rows, given = numbered(docs)
    near = simhash.near_duplicates(rows)
    firsts = materialize(near.where("doc_id = component_id").select("doc_id"), "first-copies")
    discard(*near.reads)
    return reading(with_given_ids(rows.join(firsts, "doc_id", "left_semi"), given, docs.columns), firsts, *[rows] * (given is not None))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that an earlier row has, by doc_id (nulls last), then a hash of the text; a row left
    without words goes. Rows without words before stay, null texts too; of equal rows the first stays whole. n_chars, if
    there, is counted anew. An empty table stays empty; columns may have any name."""
    return substrings.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold windows of two or more benchmark items. Rows are judged each, also where they share an id or
    have none. Null and empty texts stay, as does an empty table; columns may have any name."""
    rows, given = numbered(docs)
    judged = decontam.decontaminate(rows, table(spark, sf_dir, "benchmark"))
    bad = materialize(judged.where("contaminated").select("doc_id"), "contaminated-rows")
    discard(*judged.reads)
    return reading(with_given_ids(rows.join(bad, "doc_id", "left_anti"), given, docs.columns), bad, *[rows] * (given is not None))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and their decoded text, as digests; one row for each of docs, null texts as empty ones."""
    return bpe.encode_decode(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again. What a stage read goes once its
    result stands, and so do the tables it wrote for itself where it names them."""
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES[:-1]):
        before, made = docs, stage(spark, docs, sf_dir)
        docs = materialize(made, f"stage-{name}")
        discard(*getattr(made, "reads", ()), *[before] * (place > 0))
    return STAGES[-1][1](spark, docs, sf_dir)
