"""Where every artefact comes from: edges from raw block to embedding row, traces both ways, and breaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.operators.stored import remove, scratch, store

#: Kinds of nodes, in the order in which one is made from the other.
RAW, DOCUMENT, PARENT, CHUNK, ROW = KINDS = ("raw", "document", "parent", "chunk", "row")
#: Rounds after which a trace raises: the artefacts make four steps, other tables of edges may make more.
MOST_ROUNDS = 64


#: Rows of a partition, about, in distinct rows and in the joins of breaks: what a task holds does not grow with the artefacts.
PARTITION_ROWS = 500_000


def _spread(df: DataFrame) -> int:
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(session, 1 + df.count() // PARTITION_ROWS)


def _once(df: DataFrame) -> DataFrame:
    return df.repartition(_spread(df), *df.columns).distinct()


def block_key() -> Column:
    return F.concat_ws("/", "document_id", "block_id")


def nodes(raw: DataFrame, documents: DataFrame, parents: DataFrame, chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """(kind, key), each once, of raw(document_id, block_id), documents(document_id, block_id, parent_id, indexable), parents(parent_id),
    chunks(chunk_id, parent_id) and rows(row_id, chunk_id, parent_id). Null keys are no nodes."""
    keys = ((RAW, raw, block_key()), (DOCUMENT, documents, block_key()), (PARENT, parents, F.col("parent_id")), (CHUNK, chunks, F.col("chunk_id")), (ROW, rows, F.col("row_id")))
    found = [df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key")) for kind, df, key in keys]
    return reduce(DataFrame.unionAll, found).where("key IS NOT NULL").transform(_once)


def edges(raw: DataFrame, documents: DataFrame, parents: DataFrame, chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """(from_kind, from_key, to_kind, to_key) as the artefacts name them, whether what they name exists or not: a document's block
    names its raw block and its parent, a chunk its parent, a row its chunk or, without one, its parent."""

    def named(df: DataFrame, from_kind: str, from_key: Column, to_kind: str, to_key: Column) -> DataFrame:
        return df.select(F.lit(from_kind).alias("from_kind"), from_key.cast("string").alias("from_key"), F.lit(to_kind).alias("to_kind"), to_key.cast("string").alias("to_key"))

    parts = (
        named(documents, RAW, block_key(), DOCUMENT, block_key()), named(documents, DOCUMENT, block_key(), PARENT, F.col("parent_id")), named(chunks, PARENT, F.col("parent_id"), CHUNK, F.col("chunk_id")),
        named(rows.where("chunk_id IS NOT NULL"), CHUNK, F.col("chunk_id"), ROW, F.col("row_id")), named(rows.where("chunk_id IS NULL"), PARENT, F.col("parent_id"), ROW, F.col("row_id")),
    )
    return reduce(DataFrame.unionAll, parts).where("from_key IS NOT NULL AND to_key IS NOT NULL").transform(_once)


def trace(links: DataFrame, seeds: DataFrame, most: int = MOST_ROUNDS) -> DataFrame:
    """(seed_kind, seed_key, kind, key, distance): all that the seeds(kind, key) are made from (negative distances) and all that is
    made from them, themselves at 0, at their shortest distance.

    All seeds walk at once: a round is one join of what was found last with the edges, less what a seed has already, and is
    written, so plans stay short and a lost executor costs a round at most. Cycles end; more than `most` rounds raise."""
    spark = links.sparkSession
    start = seeds.distinct().select(F.col("kind").alias("seed_kind"), F.col("key").alias("seed_key"), "kind", "key", F.lit(0).alias("distance"))
    path = scratch(spark, "lineage")
    there = ["seed_kind", "seed_key", "kind", "key"]
    for step, (a, b) in ((1, ("from", "to")), (-1, ("to", "from"))):
        side = f"{path}/side={step}"
        start.write.parquet(f"{side}/round=0")
        for turn in range(1, most + 2):
            known = spark.read.schema(start.schema).parquet(*[f"{side}/round={k}" for k in range(turn)])
            last = spark.read.schema(start.schema).parquet(f"{side}/round={turn - 1}")
            on = (F.col("kind") == F.col(f"{a}_kind")) & (F.col("key") == F.col(f"{a}_key"))
            new = last.join(links, on).select("seed_kind", "seed_key", F.col(f"{b}_kind").alias("kind"), F.col(f"{b}_key").alias("key"), F.lit(step * turn).alias("distance")).distinct()
            new.join(known, there, "left_anti").select(start.columns).write.parquet(f"{side}/round={turn}")
            if spark.read.schema(start.schema).parquet(f"{side}/round={turn}").isEmpty():
                break
        else:
            remove(spark, path)
            raise RuntimeError(f"a trace did not end in {most} rounds")
    found = spark.read.schema(start.schema).option("recursiveFileLookup", True).parquet(path)
    return found.distinct()


def trace_counts(traces: DataFrame) -> DataFrame:
    """(seed_kind, seed_key, one count for each kind) of traces; a node that is found both ways counts once."""
    return traces.groupBy("seed_kind", "seed_key").agg(*[F.count_distinct(F.when(F.col("kind") == k, F.col("key"))).alias(k) for k in KINDS])


def breaks(known: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """(problem, kind, key) of every place where lineage ends:

    missing: something names the node, which does not exist. orphan: a node, not raw, that nothing which exists leads to.
    barren: an indexable block without a parent, a parent without chunk or row, a chunk without row, a raw block without document."""
    known, links = store(known, "lineage-nodes"), store(links, "lineage-edges")
    parts, there = max(_spread(known), _spread(links)), ["kind", "key"]

    def marked(df: DataFrame, side: str, *marks: str) -> DataFrame:
        return df.select(F.col(f"{side}kind").alias("kind"), F.col(f"{side}key").alias("key"), F.array(*map(F.lit, marks)).alias("marks"))

    def real(side: str) -> DataFrame:
        """The links whose end on that side exists."""
        ends = [f"{side}_kind", f"{side}_key"]
        return links.repartition(parts, *ends).join(known.select(*[F.col(c).alias(f"{side}_{c}") for c in there]).repartition(parts, *ends), ends, "left_semi")

    idle = documents.where("NOT coalesce(indexable, false)").select(F.lit(DOCUMENT).alias("kind"), block_key().alias("key"))
    found = reduce(DataFrame.unionAll, (
        marked(known, "", "node"), marked(links, "from_", "named"), marked(links, "to_", "named"), marked(real("from"), "to_", "led"), marked(real("to"), "from_", "held"), marked(idle, "", "idle"),
    ))
    has = lambda mark: F.bool_or(F.array_contains("marks", mark)).alias(mark)
    seen = found.repartition(parts, *there).groupBy(*there).agg(*[has(m) for m in ("node", "named", "led", "held", "idle")])
    problems = F.array(
        F.when(~F.col("node") & F.col("named"), "missing"), F.when(F.col("node") & (F.col("kind") != RAW) & ~F.col("led"), "orphan"),
        F.when(F.col("node") & (F.col("kind") != ROW) & ~F.col("held") & ~F.col("idle"), "barren"),
    )
    return seen.select(F.explode(F.array_compact(problems)).alias("problem"), *there)


def trace_blocks(wanted: DataFrame, raw: DataFrame, documents: DataFrame, chunks: DataFrame, shown: int = 600) -> DataFrame:
    """wanted(document_id, block_id) with n_versions and snippet (the start of the text of its versions) of raw (rows of
    `sources.stream`, document_id for file), document (a struct of the other columns of its descriptor) and chunks
    array<struct<chunk_id, text_chars, position, count_for_parent>>, in the order of their positions, of chunks(document_id,
    block_id, chunk_id, text, position, count_for_parent). What is lacking is 0, null or an empty list."""
    keys = ["document_id", "block_id"]
    asked = wanted.select(*keys).distinct()
    own = raw.join(asked, keys)
    texts = own.where("role IN ('kept', 'note', 'dropped')").groupBy(*keys, "version").agg(F.min_by(F.left("text", F.lit(shown)), "place").alias("t"))
    heads = texts.groupBy(*keys).agg(F.min_by("t", "version").alias("snippet"))
    versions = own.where("role = 'version'").groupBy(*keys).agg(F.count("*").alias("n_versions"))
    rest = [c for c in documents.columns if c not in keys]
    described = documents.select(*keys, F.struct(*rest).alias("document"))
    item = F.struct("position", "chunk_id", F.length("text").alias("text_chars"), "count_for_parent")
    listed = chunks.join(asked, keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("c"))
    listed = listed.select(*keys, F.transform("c", lambda c: F.struct(c["chunk_id"], c["text_chars"], c["position"], c["count_for_parent"])).alias("chunks"))
    out = asked.join(versions, keys, "left").join(heads, keys, "left").join(described, keys, "left").join(listed, keys, "left")
    return out.withColumns({"n_versions": F.coalesce("n_versions", F.lit(0).cast("long")), "chunks": F.coalesce("chunks", F.array().cast(listed.schema["chunks"].dataType))})
