"""Sinks and sources of runs: report folders, annotation worksheets in Markdown, pool records, artefacts, schemas."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codexmill.sources.files import _fs, ragged_csv

#: Words that an annotator may write for a verdict of faithfulness, and labels of correctness (fixed values).
TRUE, FALSE = ("true", "verdadero", "si", "sí", "1", "fiel"), ("false", "falso", "no", "0", "infiel")
LABELS = ("correct", "partial", "incorrect")
NO_REFERENCE, NO_EVIDENCE = "(sin referencia)", "(sin evidencia)"


def run_id(prefix: str, fingerprint: str | None = None, now: datetime | None = None) -> str:
    """prefix_time[_first 8 digits of a fingerprint], in UTC."""
    stamp = (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")
    return "_".join([prefix, stamp, *([fingerprint[:8]] if fingerprint else [])])


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON object with sorted names as a text file in a new folder."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The object that write_json wrote; None if there is none."""
    fs, where = _fs(spark, path)
    return json.loads(spark.read.text(path).first()["value"]) if fs.exists(where) else None


def write_report(spark: SparkSession, folder: str, summary: dict, metrics: list[DataFrame], **tables: DataFrame) -> str:
    """A report folder: report (JSON), metrics (CSV with the union of all columns) and each named table as JSON lines. A folder
    that is there already is an error."""
    write_json(spark, summary, f"{folder}/report")
    ragged_csv(metrics, f"{folder}/metrics")
    for name, rows in tables.items():
        rows.write.mode("errorifexists").json(f"{folder}/{name}")
    return folder


def readiness_section(spark: SparkSession, path: str) -> dict | None:
    """The readiness part of a stored audit report; None without report or part."""
    return (read_json(spark, path) or {}).get("pre_embedding_readiness")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The norms of a catalogue file {"norms": [..]}, one row each."""
    return spark.read.option("multiLine", True).json(path).select(F.inline("norms"))


def write_artefacts(folder: str, **tables: DataFrame) -> None:
    """documents, histories, parents and chunks as Parquet, parted by document where they have the column."""
    for name, rows in tables.items():
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy("document_id") if "document_id" in rows.columns else writer).parquet(f"{folder}/{name}")


def read_artefacts(spark: SparkSession, folder: str, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    """The tables of a folder under stated schemas; a missing one is empty. Of parents that share an id the one of the last file counts."""
    out = {}
    for name, schema in schemas.items():
        fs, where = _fs(spark, f"{folder}/{name}")
        found = spark.read.schema(schema).parquet(f"{folder}/{name}") if fs.exists(where) else spark.createDataFrame([], schema)
        if name == "parents" and fs.exists(where):
            found = found.select("*", F.col("_metadata.file_path").alias("__f")).groupBy("parent_id").agg(F.max_by(F.struct(*[c for c in schema.names if c != "parent_id"]), "__f").alias("r")).select("parent_id", "r.*").select(schema.names)
        out[name] = found
    return out


def export_schemas(spark: SparkSession, schemas: dict[str, StructType], folder: str) -> None:
    """Each schema as JSON."""
    for name, schema in schemas.items():
        write_json(spark, json.loads(schema.json()), f"{folder}/{name}")


def schema_drift(spark: SparkSession, schemas: dict[str, StructType], folder: str) -> list[str]:
    """Names of schemas that are not stored, or not as they are now."""
    return sorted(n for n, s in schemas.items() if read_json(spark, f"{folder}/{n}") != json.loads(s.json()))


def _or(c: str, other: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")), F.lit(other))


def annotation_block(rows: DataFrame) -> DataFrame:
    """(query_id, block): the Markdown of each of rows(query_id, question, answer, reference, evidence, faithful boolean, correctness, notes)."""
    none = F.trim(F.coalesce("reference", F.lit(""))) == ""
    verdict = F.when(F.col("faithful"), "true").when(~F.col("faithful"), "false").otherwise("")
    text = F.concat(
        F.lit("## "), F.col("query_id").cast("string"), F.lit("\n\n**Pregunta:** "), _or("question", ""), F.lit("\n\n**Respuesta:**\n\n"), _or("answer", ""), F.lit("\n\n**Referencia"),
        F.when(none, " — VACÍA: no anotes corrección").otherwise(""), F.lit(":**\n\n"), _or("reference", NO_REFERENCE), F.lit("\n\n**Evidencia:**\n\n"), _or("evidence", NO_EVIDENCE),
        F.lit("\n\nFIDELIDAD: "), verdict, F.lit("\nCORRECCION: "), F.coalesce("correctness", F.lit("")), F.lit("\nNOTAS: "), F.coalesce("notes", F.lit("")), F.lit("\n"),
    )
    return rows.select("query_id", text.alias("block"))


def parse_annotations(texts: DataFrame) -> DataFrame:
    """(query_id, faithful, correctness, notes, warnings array<string>) of texts(text): one row for each '## id' block. Words that
    are no verdict leave it open, with a warning."""
    block = texts.select(F.explode(F.slice(F.split(F.regexp_replace("text", r"(?m)^##\s+", "\u0000"), "\u0000"), 2, 1_000_000)).alias("b"))
    said = lambda key: F.trim(F.regexp_extract("b", rf"(?m)^{key}:[ \t]*(.*)$", 1))
    f, c = F.lower(said("FIDELIDAD")), F.lower(said("CORRECCION"))
    faithful = F.when(f.isin(*TRUE), True).when(f.isin(*FALSE), False)
    known = F.when(c.isin(*LABELS), c).otherwise("")
    warnings = F.filter(F.array(F.when((f != "") & faithful.isNull(), F.concat(F.lit("FIDELIDAD: "), f)), F.when((c != "") & (known == ""), F.concat(F.lit("CORRECCION: "), c))), lambda w: w.isNotNull())
    return block.select(F.regexp_extract("b", r"^\s*(\S+)", 1).alias("query_id"), faithful.alias("faithful"), known.alias("correctness"), said("NOTAS").alias("notes"), warnings.alias("warnings")).where("query_id <> ''")


def paragraph_lines(paragraphs: Column, text: Column, most: int = 0) -> Column:
    """array<string> of numbered paragraphs array<struct<order, text>>, white space collapsed, cut at `most` characters with an
    ellipsis (0: never); without paragraphs the text, or that there is none."""
    flat = lambda t: F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", " "))
    short = lambda t: F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("…"))).otherwise(t) if most else t
    lines = F.transform(paragraphs, lambda p: F.concat(F.lit("  ["), p["order"].cast("string"), F.lit("] "), short(flat(p["text"]))))
    alone = F.when(flat(text) != "", F.concat(F.lit("  (sin párrafos) "), short(flat(text)))).otherwise("  (Sin contenido)")
    return F.when(F.size(paragraphs) > 0, lines).otherwise(F.array(alone))


def worksheet(pool: DataFrame, parents: DataFrame, questions: DataFrame, top: int = 10, most: int = 0) -> DataFrame:
    """(query_id, text): a Markdown section for each question with its first `top` candidates and those judged beyond them.

    pool(query_id, parent_id, place, found_by, relevance), parents(parent_id, label, paragraphs, text), questions(query_id, query)."""
    shown = pool.where((F.col("place") <= top) | F.col("relevance").isNotNull()).join(parents, "parent_id", "left")
    mark = F.when(F.col("relevance").isNotNull(), F.concat(F.lit("[JUZGADO rel="), F.col("relevance").cast("string"), F.lit("]"))).otherwise("[sin juzgar]")
    found = F.coalesce(F.nullif("found_by", F.lit("")), F.lit("— (solo juzgado; ningún sistema lo recuperó)"))
    empty = F.array().cast("array<struct<order:int,text:string>>")
    lines = F.array_join(paragraph_lines(F.coalesce("paragraphs", empty), F.col("text"), most), "\n")
    one = F.concat(F.lit("\n### "), F.coalesce("label", F.col("parent_id").cast("string")), F.lit(" · `"), F.col("parent_id").cast("string"), F.lit("` "), mark, F.lit("\n_recuperado por:_ "), found, F.lit("\n```\n"), lines, F.lit("\n```"))
    sections = shown.select("query_id", F.struct("place", "parent_id", one.alias("s")).alias("x")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n").alias("s"))
    return questions.join(sections, "query_id").select("query_id", F.concat(F.lit("---\n\n## "), F.col("query_id").cast("string"), F.lit("\n**Pregunta:** "), F.coalesce("query", F.lit("")), F.lit("\n"), F.col("s")).alias("text"))


def pool_records(pool: DataFrame, questions: DataFrame) -> DataFrame:
    """One record for each question: its candidates in order and the judged parents that no system found."""
    found = F.coalesce("found_by", F.lit("")) != ""
    lists = pool.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(found, F.struct("place", "parent_id", "found_by", "relevance")))).alias("candidates"), F.array_sort(F.collect_list(F.when(~found, F.col("parent_id")))).alias("judged_not_pooled")
    )
    return lists.join(questions, "query_id", "left")


def load_template(folder: str, name: str) -> str:
    """A prompt template's text; names are letters, digits, dots, dashes and underscores."""
    if not re.fullmatch(r"[\w.-]+", name):
        raise ValueError(f"{name} is no template name")
    with open(f"{folder}/{name}", encoding="utf-8") as f:
        return f.read()


def first_by_priority(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of several sources, of each key that of the first source that has it."""
    marked = [p.withColumn("__source", F.lit(i)) for i, p in enumerate(parts)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    names = [c for c in union.columns if c not in (key, "__source")]
    return union.groupBy(key).agg(F.min_by(F.struct(*names), "__source").alias("r")).select(key, "r.*")
