"""A stored inverted index for Okapi BM25: postings by term in blocks, searched with block maxima."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexmill.operators.stored import remove, scratch, store
from codexmill.sources import files

#: Okapi parameters (fixed values).
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rows of a block, on average. A block's postings of one term are one row, which a search reads or skips.
BLOCK_ROWS = 256
#: Folders by a hash of the term, and hits (a row's use of a term) that one file of such a folder holds, about.
SHARDS, RANGE_HITS = 16, 1 << 20
#: (query, term) pairs that meet the hits of one cell of a scan, about.
CELL_PAIRS = 1 << 17
#: Blocks of the highest bounds that are scored first for each query; their k-th score decides which others can be skipped.
SEEDS = 64


@dataclass
class Facts:
    """What a search needs of the whole index. Means of idf are over the terms of bodies, and of bodies or headings."""

    rows: int
    blocks: int
    words: int
    heading_words: int
    mean_idf: float
    mean_idf_any: float
    k1: float
    b: float
    boost: int

    def mean_length(self, boost: int) -> float:
        return (self.words + boost * self.heading_words) / self.rows if self.rows else 0.0


@dataclass
class Index:
    """postings(shard, term, block, n, n_any, hits, tf_max, ht_max, dl_min, hl_min, best), terms(shard, term, df, df_any) and facts.

    hits are struct<unit_id, tf, ht, dl, hl>: a row's frequency of the term in body and heading, and the lengths of both.
    best is the largest share of a score in the block under the index's own k1, b and boost; tf_max, ht_max, dl_min and hl_min
    bound it under any others."""

    postings: DataFrame
    terms: DataFrame
    facts: Facts


def _shard(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHARDS)).cast("int")


def _saturated(tf: Column, dl: Column, k1: float, b: float, mean: float) -> Column:
    """A term's part in a score before its idf; 0 where it does not occur."""
    return F.when(tf > 0, tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))).otherwise(0.0)


def _idf(rows: int, df: Column) -> Column:
    return F.log(rows - df + 0.5) - F.log(df + 0.5)


_HITS = pa.struct([("unit_id", pa.int64()), ("tf", pa.int32()), ("ht", pa.int32()), ("dl", pa.int32()), ("hl", pa.int32())])
_LISTS = (
    "block long, term string, n long, n_any long, hits array<struct<unit_id:long,tf:int,ht:int,dl:int,hl:int>>, words long, heading_words long, tf_max int, ht_max int, dl_min int, hl_min int"
)


def _block_lists(block: int, units: pa.Array, words: pa.ListArray, heads: pa.ListArray) -> pa.RecordBatch:
    """_LISTS of the rows of one block: a list for each term, in the order of the terms' first places."""
    n, body, head = len(units), words.value_lengths().to_numpy().astype(np.int64), heads.value_lengths().to_numpy().astype(np.int64)
    flat = pa.concat_arrays([words.flatten(), heads.flatten()]).dictionary_encode()
    codes, rows = flat.indices.fill_null(-1).to_numpy().astype(np.int64), np.concatenate([np.repeat(np.arange(n), body), np.repeat(np.arange(n), head)])
    known, in_body = codes >= 0, np.arange(len(codes)) < body.sum()
    pairs, at = np.unique(codes[known] * n + rows[known], return_inverse=True)
    tf = np.bincount(at[in_body[known]], minlength=len(pairs))
    ht = np.bincount(at[~in_body[known]], minlength=len(pairs))
    term, row = pairs // max(n, 1), pairs % max(n, 1)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    if not len(starts):
        return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)
    columns = [units.take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (tf, ht, body[row], head[row]))]
    hits = pa.ListArray.from_arrays(pa.array(np.append(starts, len(pairs)).astype(np.int32)), pa.StructArray.from_arrays(columns, fields=list(_HITS)))
    each = lambda f, x, kind=np.int64: pa.array(f.reduceat(x.astype(kind), starts))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(starts), block)), flat.dictionary.take(pa.array(term[starts])), each(np.add, tf > 0), pa.array(np.diff(np.append(starts, len(pairs)))), hits, each(np.add, tf), each(np.add, ht),
            each(np.maximum, tf, np.int32), each(np.maximum, ht, np.int32), each(np.minimum, body[row], np.int32), each(np.minimum, head[row], np.int32),
        ],
        schema=_SCHEMA,
    )


_SCHEMA = pa.schema(
    [("block", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("n_any", pa.int64()), ("hits", pa.list_(pa.field("item", _HITS))), ("words", pa.int64()), ("heading_words", pa.int64())]
    + [(c, pa.int32()) for c in ("tf_max", "ht_max", "dl_min", "hl_min")]
)


def build(rows: DataFrame, path: str, tokens: Column | None = None, heading: Column | None = None, k1: float = K1, b: float = B, boost: int = 0, block_rows: int = BLOCK_ROWS, spread: int | None = None, filed: bool = True) -> Index:
    """Writes the index of rows to a new path. tokens and heading are expressions over rows for array<string> of words (default:
    the column tokens, no heading); they are worked out once.

    Blocks are runs of rows as a task reads them, so their lists are made where the rows are. What is shuffled are these lists,
    once, each to the folder of its term and the file of its range of blocks: there are as many ranges as hits ask for, and a term
    of all rows is spread over as many tasks as there are ranges. spread, if given, deals the rows out to so many tasks first, for input of a few large row groups.
    Not filed, the lists stay in the files of the tasks that made them and are not shuffled: enough for `scan`, which reads all of
    them; `search` finds the same there but reads all of them too, and `read` does not open such an index.
    Rows with null words are counted but found by none; unit_id should be unique (of rows that share one, scores are added);
    an empty table gives an index that finds nothing."""
    spark, n = rows.sparkSession, rows.count()
    empty = F.array().cast("array<string>")
    words = F.coalesce(tokens if tokens is not None else F.col("tokens"), empty)
    heads = F.coalesce(heading, empty) if heading is not None else empty
    held = (rows.repartition(spread) if spread else rows).select(F.col("unit_id").cast("long").alias("unit_id"), words.alias("w"), heads.alias("h"))

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                yield _block_lists(block, *part.columns)
                block += 1

    staged = scratch(spark, "postings-by-block") if filed else f"{path}/lists"
    held.mapInArrow(run, _LISTS).write.parquet(staged)
    lists = spark.read.schema(_LISTS).parquet(staged).withColumn("shard", _shard())
    terms = lists.groupBy("shard", "term").agg(F.sum("n").alias("df"), F.sum("n_any").alias("df_any"), F.sum("words").alias("words"), F.sum("heading_words").alias("heading_words"))
    terms.repartition("shard").write.partitionBy("shard").parquet(f"{path}/terms")
    terms = spark.read.schema(terms.schema).parquet(f"{path}/terms")
    all_of = terms.agg(
        F.sum("words").alias("w"), F.sum("heading_words").alias("h"), F.avg(F.when(F.col("df") > 0, _idf(n, F.col("df")))).alias("idf"), F.avg(_idf(n, F.col("df_any"))).alias("idf_any"),
        F.sum("df_any").alias("hits"),
    ).first()
    blocks = lists.select("block").distinct().count()
    facts = Facts(n, blocks, all_of["w"] or 0, all_of["h"] or 0, all_of["idf"] or 0.0, all_of["idf_any"] or 0.0, k1, b, boost)
    part = lambda x: _saturated(x["tf"] + boost * x["ht"], x["dl"] + boost * x["hl"], k1, b, facts.mean_length(boost) or 1.0)
    ranges = max(1, -(-(all_of["hits"] or 0) // (SHARDS * RANGE_HITS)))
    postings = lists.drop("words", "heading_words").withColumn("best", F.array_max(F.transform("hits", part)))
    if not filed:
        return Index(postings, terms, facts)
    # the number is given: without one, tasks are as many as the session's shuffle partitions, whatever the postings weigh
    postings = postings.repartition(SHARDS * ranges, "shard", F.pmod(F.xxhash64("block"), F.lit(ranges))).sortWithinPartitions("shard", "term", "block")
    postings.write.partitionBy("shard").parquet(f"{path}/postings")
    spark.createDataFrame([(json.dumps(asdict(facts)),)], "value string").coalesce(1).write.text(f"{path}/facts")
    remove(spark, staged)
    return read(spark, path)


def read(spark: SparkSession, path: str) -> Index:
    """The index at a path."""
    facts = Facts(**json.loads(spark.read.text(f"{path}/facts").first()["value"]))
    hit = "array<struct<unit_id:long,tf:int,ht:int,dl:int,hl:int>>"
    postings = spark.read.schema(f"block long, term string, n long, n_any long, hits {hit}, tf_max int, ht_max int, dl_min int, hl_min int, best double, shard int").parquet(f"{path}/postings")
    return Index(postings, spark.read.schema("term string, df long, df_any long, shard int").parquet(f"{path}/terms"), facts)


def build_scratch(rows: DataFrame, **how) -> Index:
    """An index in the shared folder, for the searches of one session."""
    return build(rows, scratch(rows.sparkSession, "lexical-index"), **how)


def search(index: Index, queries: DataFrame, k: int = 10, digits: int = 6, k1: float | None = None, b: float | None = None, boost: int | None = None, allowed: DataFrame | None = None, seeds: int = SEEDS) -> DataFrame:
    """(query_id, unit_id, score, rank): the k best rows of each of queries(query_id, tokens), ties by unit_id; exact.

    A row is found if it shares a word, whatever its score; a word that a query repeats counts each time; a term in over half
    of the rows has a negative idf, replaced by EPSILON times the mean idf of all terms. k1, b and boost are the index's own
    unless given: one index serves all. allowed(unit_id), if given, narrows what is ranked, not the statistics.

    Only asked terms are read: their lists' bounds first, then, for each query, the lists of its `seeds` best blocks, and of the
    others only those whose bound reaches the k-th score found so far. A query without words finds nothing."""
    if k <= 0:
        raise ValueError("k must be positive")
    facts = index.facts
    k1, b, boost = (own if given is None else given for given, own in ((k1, facts.k1), (b, facts.b), (boost, facts.boost)))
    mean, df, floor = facts.mean_length(boost) or 1.0, F.col("df_any" if boost else "df"), EPSILON * (facts.mean_idf_any if boost else facts.mean_idf)
    asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")).withColumn("shard", _shard())
    idf = _idf(facts.rows, df)
    weighted = asked.join(index.terms.where(df > 0), ["shard", "term"]).select("query_id", "shard", "term", (F.col("times") * F.when(idf < 0, floor).otherwise(idf)).alias("weight"))
    if (k1, b, boost) == (facts.k1, facts.b, facts.boost):
        most = F.col("best")
    else:
        most = _saturated(F.col("tf_max") + boost * F.col("ht_max"), F.col("dl_min") + boost * F.col("hl_min"), k1, b, mean)
    listed = index.postings.where(F.col("n_any" if boost else "n") > 0)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("unit_id"))

    def top(scored: DataFrame) -> DataFrame:
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def scored(cells: DataFrame, *also: str) -> DataFrame:
        hits = listed.select("shard", "term", "block", "hits").join(cells, ["shard", "term", *also]).select("query_id", "weight", F.explode("hits").alias("x"))
        tf = F.col("x.tf") + boost * F.col("x.ht")
        part = F.col("weight") * _saturated(tf, F.col("x.dl") + boost * F.col("x.hl"), k1, b, mean)
        hits = hits.where(tf > 0).select("query_id", F.col("x.unit_id").alias("unit_id"), part.alias("part"))
        if allowed is not None:
            hits = hits.join(allowed.select("unit_id"), "unit_id", "left_semi")
        return hits.groupBy("query_id", "unit_id").agg(F.round(F.sum("part"), digits).alias("score"))

    if facts.blocks <= seeds:
        return top(scored(weighted)).select("query_id", "unit_id", "score", "rank")
    cells = listed.select("shard", "term", "block", most.alias("most")).join(weighted, ["shard", "term"])
    bounds = cells.groupBy("query_id", "block").agg(F.sum(F.greatest("weight", F.lit(0.0)) * F.col("most")).alias("bound"))
    placed = bounds.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")))
    of = lambda chosen: scored(cells.drop("most").join(chosen.select("query_id", "block"), ["query_id", "block"]), "block")
    first = top(of(placed.where(F.col("place") <= seeds)))
    reached = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    # scores are rounded, bounds are not
    rest = placed.where(F.col("place") > seeds).join(reached, "query_id", "left").where(F.col("reached").isNull() | (F.col("bound") + 10.0**-digits >= F.col("reached")))
    return top(first.drop("rank").unionByName(of(rest))).select("query_id", "unit_id", "score", "rank")


def _best(scores: np.ndarray, found: np.ndarray, k: int, margin: float) -> np.ndarray:
    """Places of those found that may be among the k best by rounded score and then place: scores not over margin below the k-th,
    and of equal scores the first k places."""
    at = np.flatnonzero(found)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k] - margin]
    at = at[np.argsort(-scores[at], kind="stable")]
    if len(at) > k:
        first = np.flatnonzero(np.diff(scores[at], prepend=np.inf))  # of each run of equal scores
        at = at[np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) < k]
    return at


def scan(index: Index, queries: DataFrame, settings: list[tuple[float | None, float | None, int | None]], k: int = 10, digits: int = 6, cell_hits: int = RANGE_HITS, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """(setting int, query_id, unit_id, score, rank): what `search` finds under each of settings (k1, b, boost), by place; exact.

    All lists are read once for all settings. Hits of asked terms are shuffled once, by their unit, to cells of about cell_hits hits and
    cell_pairs (query, term) pairs; a cell scores its units under every setting, and only what may be among the k best leaves it. So
    what is shuffled does not grow with the settings, nor with the pairs of a query and a row."""
    if k <= 0:
        raise ValueError("k must be positive")
    facts = index.facts
    settings = [tuple(own if given is None else given for given, own in zip(s, (facts.k1, facts.b, facts.boost))) for s in settings]

    def weight(df: str, mean: float) -> Column:
        idf = _idf(facts.rows, F.col(df))
        return F.when(F.col(df) > 0, F.col("times") * F.when(idf < 0, EPSILON * mean).otherwise(idf)).otherwise(0.0)

    asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")).withColumn("shard", _shard())
    weighted = asked.join(index.terms, ["shard", "term"]).select("query_id", "term", "df_any", weight("df", facts.mean_idf).alias("weight"), weight("df_any", facts.mean_idf_any).alias("weight_any"))
    weighted = store(weighted, "asked-terms")
    terms = weighted.select("term", "df_any").distinct()
    groups = lambda n, each: max(1, -(-(n or 0) // each))
    query_groups, unit_groups = groups(weighted.count(), cell_pairs), groups(terms.agg(F.sum("df_any")).first()[0], cell_hits)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hits = index.postings.select("term", "hits").join(terms.select("term"), "term").select("term", F.explode("hits").alias("x")).select("term", "x.*")
    left = hits.withColumn("ug", F.pmod(F.xxhash64("unit_id"), F.lit(unit_groups)).cast("int")).withColumn("qg", every(query_groups))
    right = weighted.drop("df_any").withColumn("qg", F.pmod(F.xxhash64("query_id"), F.lit(query_groups)).cast("int")).withColumn("ug", every(unit_groups))

    def cell(hits: pa.Table, pairs: pa.Table) -> pa.Table:
        pairs, known = pairs.combine_chunks(), pc.unique(pairs["term"])
        code = pc.index_in(hits["term"], value_set=known).fill_null(-1).to_numpy()
        hits, order = hits.drop_columns(["term"]), np.argsort(code, kind="stable")
        begins = np.searchsorted(code[order], np.arange(len(known) + 1))
        lowest = np.iinfo(np.int64).min  # null ids come first
        ids, first, unit = np.unique(hits["unit_id"].fill_null(lowest).to_numpy(), return_index=True, return_inverse=True)
        unit = unit[order]
        tf, ht, dl, hl = (hits[c].to_numpy()[order].astype(np.float64) for c in ("tf", "ht", "dl", "hl"))
        parts = []
        for k1, b, boost in settings:
            f, length = tf + boost * ht, dl + boost * hl
            below = f + k1 * (1 - b + b * length / (facts.mean_length(boost) or 1.0))
            parts.append(np.divide(f * (k1 + 1), below, out=np.zeros(len(f)), where=f > 0))
        term = pc.index_in(pairs["term"], value_set=known).to_numpy()
        names = pairs["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        query = names.indices.to_numpy()
        weights = {False: pairs["weight"].to_numpy(), True: pairs["weight_any"].to_numpy()}
        by_query = np.lexsort((term, query))
        ends = np.searchsorted(query[by_query], np.arange(len(names.dictionary) + 1))
        out = []
        for q in range(len(names.dictionary)):
            own = by_query[ends[q] : ends[q + 1]]
            lengths = begins[term[own] + 1] - begins[term[own]]
            at = np.repeat(begins[term[own]] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
            if not len(at):
                continue
            where, times = unit[at], {boosted: np.repeat(w[own], lengths) for boosted, w in weights.items()}
            found = {True: np.bincount(where, minlength=len(ids)) > 0, False: np.bincount(where, tf[at] > 0, minlength=len(ids)) > 0}
            for s, (part, (_, _, boost)) in enumerate(zip(parts, settings)):
                scores = np.bincount(where, part[at] * times[boost > 0], minlength=len(ids))
                best = _best(scores, found[boost > 0], k, 10.0**-digits)
                out.append((s, q, best, scores[best]))
        sizes = [len(best) for _, _, best, _ in out]
        column = lambda values, kind: np.repeat(np.array(values, kind), sizes)
        joined = lambda n, kind: np.concatenate([o[n] for o in out]) if out else np.array([], kind)
        return pa.table(
            [
                pa.array(column([o[0] for o in out], np.int32)), names.dictionary.take(pa.array(column([o[1] for o in out], np.int64))),
                hits["unit_id"].take(pa.array(first[joined(2, np.int64)])), pa.array(joined(3, np.float64)),
            ],
            names=["setting", "query_id", "unit_id", "score"],
        )

    kind = queries.schema["query_id"].dataType.simpleString()
    scored = left.groupBy("ug", "qg").cogroup(right.groupBy("ug", "qg")).applyInArrow(cell, f"setting int, query_id {kind}, unit_id long, score double")
    order = Window.partitionBy("setting", "query_id").orderBy(F.col("score").desc(), F.col("unit_id"))
    return scored.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def of_published(spark: SparkSession, published: str, path: str, analyze: Callable[[Column], Column], text: str = "text", heading: str | None = None, **how) -> Index:
    """An index over the rows of a published table (see `sources.files.load`, which checks them), which have a unit_id: analyze is
    put to the columns named text and heading."""
    return build(files.load(spark, published), path, analyze(F.col(text)), analyze(F.col(heading)) if heading else None, **how)
