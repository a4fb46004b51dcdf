"""Exact dense search, BM25 and their fusion, for a table of queries at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.operators import postings
from codexmill.operators.postings import K1, B

RRF_K, ALPHA = 60, 0.7
#: Hits of each run that a hybrid search fuses.
CANDIDATES = 100
#: Query vectors, in bytes, that are sent to every task, or make one side of a cell of the grid; row vectors of a cell.
QUERY_BYTES, ROW_BYTES = 32 << 20, 128 << 20
#: Values of a score that count when hits are ranked: what is left off is noise of the summation.
EXACT = 12
#: A product is made in tiles of so many queries and rows.
TILE_QUERIES, TILE_ROWS = 256, 4096


def rank_hits(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, unit_id, score, rank): the k best of each query, ties by unit_id."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("unit_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "unit_id", "score", "rank")


class _Best:
    """The k best rows of each query so far, by score (noise of the summation rounded off), then by unit."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.scores, self.units = np.full((len(queries), 0), -np.inf), np.zeros((len(queries), 0), np.int64)

    def add(self, units: np.ndarray, vectors: np.ndarray) -> None:
        """Tiles of the product of all queries and these rows, none over TILE values."""
        kept = []
        for q in range(0, len(self.queries), TILE_QUERIES):
            own = slice(q, q + TILE_QUERIES)
            scores, found = self.scores[own], self.units[own]
            for at in range(0, len(units), TILE_ROWS):
                part = np.round(self.queries[own] @ vectors[at : at + TILE_ROWS].T, EXACT)
                scores = np.concatenate([scores, part], axis=1)
                found = np.concatenate([found, np.broadcast_to(units[at : at + TILE_ROWS], part.shape)], axis=1)
                order = np.lexsort((found, -scores), axis=1)[:, : self.k]
                scores, found = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)
            kept.append((scores, found))
        if kept:
            self.scores, self.units = (np.concatenate(x) for x in zip(*kept))

    def columns(self, ids: np.ndarray) -> list[pa.Array]:
        n = self.scores.shape[1]
        return [pa.array(np.repeat(ids, n), pa.int64()), pa.array(self.units.ravel(), pa.int64()), pa.array(self.scores.ravel(), pa.float64())]


def _matrix(column, dim: int) -> np.ndarray:
    """The vectors of an Arrow column; one of another length than dim, or a null one, raises."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if lists.null_count or not (lists.value_lengths().to_numpy() == dim).all():
        raise ValueError(f"vectors of another length than {dim}")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


_SCORED, _NAMES = "query_id long, unit_id long, raw double", ["query_id", "unit_id", "raw"]


def dense_search(rows: DataFrame, queries: DataFrame, k: int = 10, digits: int = 6, query_bytes: int | None = None, row_bytes: int | None = None) -> DataFrame:
    """(query_id, unit_id, score, rank): exact top-k dot products of queries(query_id, vector) against rows(unit_id, vector), in
    double precision, ranked by the score before it is rounded to `digits`, ties by unit_id.

    Filters belong on rows, before the search. Vectors of another length than the queries' raise, null ones too. Queries of up
    to query_bytes are sent to every task, which multiplies its rows where they are. More of them meet the rows in a grid:
    groups of rows of about row_bytes by groups of queries of about query_bytes are the partitions of one join, rows are
    read once, and each cell is a product of bounded tiles. Either way a task or a cell keeps k rows a query, merged by one
    ranking. No rows or no queries give no hits."""
    if k <= 0:
        raise ValueError("k must be positive")
    query_bytes, row_bytes = query_bytes or QUERY_BYTES, row_bytes or ROW_BYTES
    size = queries.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"), F.count("vector").alias("known")).first()
    dim = size["high"] or 0
    if size["n"] and (size["low"] != dim or size["known"] < size["n"] or not dim):
        raise ValueError("query vectors of unequal length")
    units = rows.select(F.col("unit_id").cast("long").alias("unit_id"), "vector")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector")
    if 8 * dim * size["n"] <= query_bytes:
        raw = _beside(units, asked, dim, k)
    else:
        raw = _grid(units, asked, dim, k, -(-8 * dim * size["n"] // query_bytes), row_bytes)
    order = Window.partitionBy("query_id").orderBy(F.col("raw").desc(), F.col("unit_id"))
    best = raw.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "unit_id", F.round("raw", digits).alias("score"), "rank")


def _beside(units: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """Each task multiplies its own rows with all queries, whose size the caller has checked."""
    got = asked.toArrow()
    shared = units.sparkSession.sparkContext.broadcast((got["query_id"].to_numpy(), _matrix(got["vector"], dim) if len(got) else np.zeros((0, dim))))

    def run(batches):
        ids, q = shared.value
        best = _Best(q, k)
        for batch in batches:
            if batch.num_rows and len(ids):
                best.add(batch.column(0).to_numpy(), _matrix(batch.column(1), dim))
        yield pa.RecordBatch.from_arrays(best.columns(ids), _NAMES)

    return units.mapInArrow(run, _SCORED)


def _grid(units: DataFrame, asked: DataFrame, dim: int, k: int, query_groups: int, row_bytes: int) -> DataFrame:
    """Row groups by query groups; a row goes to one cell of each query group, a query to one cell of each row group."""
    row_groups = max(1, -(-8 * dim * units.count() // row_bytes))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = units.select("unit_id", "vector", F.pmod(F.xxhash64("unit_id", "vector"), F.lit(row_groups)).cast("int").alias("rg"), every(query_groups).alias("qg"))
    right = asked.select("query_id", "vector", F.pmod(F.xxhash64("query_id", "vector"), F.lit(query_groups)).cast("int").alias("qg"), every(row_groups).alias("rg"))

    def cell(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(rows) or not len(queries):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=_NAMES)
        best = _Best(_matrix(queries["vector"], dim), k)
        best.add(rows["unit_id"].to_numpy(), _matrix(rows["vector"], dim))
        return pa.table(best.columns(queries["query_id"].to_numpy()), names=_NAMES)

    return left.groupBy("rg", "qg").cogroup(right.groupBy("rg", "qg")).applyInArrow(cell, _SCORED)


def bm25_search(rows: DataFrame, queries: DataFrame, k: int = 10, digits: int = 6, k1: float = K1, b: float = B, boost: int = 0, tokens: Column | None = None, spread: int | None = None) -> DataFrame:
    """Okapi BM25 of queries(query_id, tokens) against rows(unit_id, tokens[, heading]), by an index made for this search.

    tokens, an expression over rows, stands for the column of that name. heading tokens, repeated boost times, count in
    frequencies, lengths and eligibility. spread: see `postings.build`; `postings.search` says what is found."""
    index = postings.build_scratch(rows, tokens=tokens, heading=F.col("heading") if boost else None, k1=k1, b=b, boost=boost, spread=spread)
    return postings.search(index, queries, k, digits)


def one_factor(base: dict, changes: dict[str, list]) -> list[tuple[str, dict]]:
    """(name, settings): base, then base with each single value of changes put in."""
    return [("base", base), *((f"{key}_{value}".lower(), base | {key: value}) for key, values in changes.items() for value in values)]


def lexical_ablation(rows: DataFrame, queries: DataFrame, settings: list[tuple[str, dict]], analyze: Callable[..., Column], k: int = 10, spread: int | None = None) -> DataFrame:
    """(setting, query_id, unit_id, score, rank) of queries(query_id, query) against rows(unit_id, text, heading) under each of settings.

    k1, b and boost are settings of a search; all others go to analyze(text column, **others). Settings of one analysis share
    one index and one scan of it, so texts are analysed, and hits shuffled, once for each analysis, not for each setting."""
    shared: dict[tuple, list] = {}
    for name, setting in settings:
        how = tuple(sorted((key, v) for key, v in setting.items() if key not in ("k1", "b", "boost")))
        shared.setdefault(how, []).append((name, tuple(setting.get(key) for key in ("k1", "b", "boost"))))
    found = None
    for key, own in shared.items():
        how = dict(key)
        index = postings.build_scratch(rows, tokens=analyze(F.col("text"), **how), heading=analyze(F.col("heading"), **how), spread=spread, filed=False)
        run = postings.scan(index, queries.select("query_id", analyze(F.col("query"), **how).alias("tokens")), [s for _, s in own], k)
        names = F.array(*[F.lit(name) for name, _ in own])
        run = run.select(F.element_at(names, F.col("setting") + 1).alias("setting"), "query_id", "unit_id", "score", "rank")
        found = run if found is None else found.unionAll(run)
    return found


def fuse_rrf(runs: list[DataFrame], k: int = 10, rrf_k: int = RRF_K, digits: int = 6) -> DataFrame:
    """Sum of 1 / (rrf_k + rank) over the runs."""
    union = runs[0].select("query_id", "unit_id", "rank")
    for run in runs[1:]:
        union = union.unionByName(run.select("query_id", "unit_id", "rank"))
    return rank_hits(union.groupBy("query_id", "unit_id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), digits).alias("score")), k)


def min_max(run: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 within a query; a constant list is 1 if positive, else 0."""
    own = Window.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.when(F.col("score") > 0, 1.0).otherwise(0.0))
    return run.select("query_id", "unit_id", scaled.alias("score"))


def fuse_weighted(dense: DataFrame, lexical: DataFrame, k: int = 10, alpha: float = ALPHA, digits: int = 6) -> DataFrame:
    """alpha * dense + (1 - alpha) * lexical of scaled scores; a unit that a run lacks has 0 there."""
    d, x = min_max(dense).withColumnRenamed("score", "d"), min_max(lexical).withColumnRenamed("score", "x")
    both = d.join(x, ["query_id", "unit_id"], "full_outer")
    return rank_hits(both.select("query_id", "unit_id", F.round(alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("x", F.lit(0.0)), digits).alias("score")), k)


def hybrid(dense: Callable[[int], DataFrame], lexical: Callable[[int], DataFrame], k: int = 10, fusion: str = "rrf", candidates: int = CANDIDATES, **options) -> DataFrame:
    """The k best of both runs fused ("rrf" or "weighted"), each asked for its max(candidates, k) first hits; scores are scaled over those lists."""
    if fusion not in ("rrf", "weighted"):
        raise ValueError("fusion must be rrf or weighted")
    depth = max(candidates, k)
    if fusion == "rrf":
        return fuse_rrf([dense(depth), lexical(depth)], k, **options)
    return fuse_weighted(dense(depth), lexical(depth), k, **options)


def pool(runs: dict[str, DataFrame], judged: DataFrame) -> DataFrame:
    """(query_id, unit_id, n_systems, best_rank, best_score, found_by, judged): the union of runs, with judged(query_id,
    unit_id) pairs put in even if no run found them. found_by lists system:rank by rank, then name."""
    union = None
    for name, run in runs.items():
        one = run.groupBy("query_id", "unit_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score")).withColumn("system", F.lit(name))
        union = one if union is None else union.unionByName(one)
    found = union.groupBy("query_id", "unit_id").agg(
        F.count("*").alias("n_systems"), F.min("rank").alias("best_rank"), F.max("score").alias("best_score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "system"))), lambda s: F.concat(s["system"], F.lit(":"), s["rank"].cast("string"))), ", ").alias("found_by"),
    )
    marked = judged.select("query_id", "unit_id").distinct().withColumn("judged", F.lit(True))
    return found.join(marked, ["query_id", "unit_id"], "full_outer").select(
        "query_id", "unit_id", F.coalesce("n_systems", F.lit(0)).cast("long").alias("n_systems"), "best_rank", "best_score", F.coalesce("found_by", F.lit("")).alias("found_by"), F.coalesce("judged", F.lit(False)).alias("judged")
    )


#: Attributes that a search may be narrowed by: scalars for equality, flags that may only be asked to be true (fixed values).
SCALARS, FLAGS = ("rank_code", "scope_code", "semantic_role"), ("without_content", "annex", "table", "image")


def active_filters(**wanted) -> dict:
    """Only the filters that narrow anything: values that are set, flags that ask for true, subject codes if any. Others raise."""
    unknown = set(wanted) - {*SCALARS, *FLAGS, "subject_codes"}
    if unknown:
        raise ValueError(f"unknown filters {sorted(unknown)}")
    return {k: v for k, v in wanted.items() if (k in FLAGS and v is True) or (k not in FLAGS and v)}


def matches(filters: dict) -> Column:
    """The rows that pass: equal scalars, flags (a missing one is false), some common subject code. No filters: all rows."""
    test = F.lit(True)
    for name, value in filters.items():
        if name == "subject_codes":
            test = test & F.coalesce(F.arrays_overlap("subject_codes", F.array(*map(F.lit, value))), F.lit(False))
        elif name in FLAGS:
            test = test & F.coalesce(F.col(name), F.lit(False)).eqNullSafe(F.lit(bool(value)))
        else:
            test = test & F.coalesce(F.col(name) == value, F.lit(False))
    return test


def filter_attributes(rows: DataFrame, chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """rows(row_index, chunk_id, parent_id) plus the attributes of their chunk or, without one, of their parent.

    chunks and parents are keyed by chunk_id and parent_id and hold SCALARS, FLAGS and subject_codes."""
    names = [*SCALARS, *FLAGS, "subject_codes"]
    c = chunks.select("chunk_id", F.lit(True).alias("__c"), *[F.col(n).alias(f"__c_{n}") for n in names])
    p = parents.select("parent_id", *[F.col(n).alias(f"__p_{n}") for n in names])
    both = rows.join(c, "chunk_id", "left").join(p, "parent_id", "left")
    return both.select(*rows.columns, *[F.when(F.col("__c"), F.col(f"__c_{n}")).otherwise(F.col(f"__p_{n}")).alias(n) for n in names])


def row_texts(rows: DataFrame, chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """rows(.., kind, field, chunk_id, parent_id, derived_text) plus retrieval_text, citation_label and citation_url: a derived
    row's own text; of a chunk the named field (retrieval_text, or text where that is null or not named); else the
    parent's text. A blank label becomes the parent's id."""
    c = chunks.select("chunk_id", F.col("text").alias("__text"), F.col("retrieval_text").alias("__retrieval"), F.col("label").alias("__c_label"), F.col("url").alias("__c_url"))
    p = parents.select("parent_id", F.col("text").alias("__p_text"), F.col("label").alias("__p_label"), F.col("url").alias("__p_url"))
    both = rows.join(c, "chunk_id", "left").join(p, "parent_id", "left")
    own = F.when(F.col("kind") == "derived", F.col("derived_text")).when(F.col("kind") == "chunk", F.when(F.col("field") == "retrieval_text", F.coalesce("__retrieval", "__text")).otherwise(F.col("__text"))).otherwise(F.col("__p_text"))
    label = F.coalesce(F.nullif(F.coalesce("__c_label", "__p_label"), F.lit("")), F.col("parent_id"))
    return both.select(*rows.columns, F.coalesce(own, F.lit("")).alias("retrieval_text"), label.alias("citation_label"), F.coalesce("__c_url", "__p_url").alias("citation_url"))


def boost_text(label: Column, full_title: Column, title: Column) -> Column:
    """What a heading boost repeats: citation label and full title, or else the plain title."""
    return F.trim(F.concat_ws(" ", F.nullif(label, F.lit("")), F.coalesce(F.nullif(full_title, F.lit("")), F.nullif(title, F.lit("")))))


def checked_queries(queries: DataFrame, k: int) -> DataFrame:
    """queries(query_id, query, ..) as they are; k below 1 or a blank query raises."""
    if k <= 0:
        raise ValueError("k must be positive")
    blank = F.trim(F.coalesce("query", F.lit(""))) == ""
    return queries.where(~F.when(blank, F.raise_error(F.concat(F.lit("blank query "), F.col("query_id").cast("string"))).cast("boolean")).otherwise(F.lit(False)))


def resolved(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """hits(query_id, unit_id, score, rank) with what row_texts knows of their unit, score to 4 digits in brief_score."""
    return hits.join(texts, "unit_id", "left").withColumn("brief_score", F.round("score", 4))


def dense_retrieve(rows: DataFrame, texts: DataFrame, queries: DataFrame, encode: Callable[[DataFrame], DataFrame], k: int = 10, filters: dict | None = None) -> DataFrame:
    """Resolved exact dense hits of queries(query_id, query); encode gives (query_id, vector) of them. rows(unit_id, vector,
    filter attributes) are narrowed before they are scored."""
    kept = rows.where(matches(filters or {}))
    return resolved(dense_search(kept, encode(checked_queries(queries, k)), k), texts)


def lexical_retrieve(index: postings.Index, texts: DataFrame, queries: DataFrame, analyze: Callable[[Column], Column], k: int = 10, filters: dict | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """Resolved BM25 hits of queries(query_id, query). Statistics are those of the whole index; filters, over
    attributes(unit_id, ..), narrow what is ranked."""
    asked = checked_queries(queries, k).select("query_id", analyze(F.col("query")).alias("tokens"))
    if filters and attributes is None:
        raise ValueError("filters need the attributes of the index's rows")
    allowed = attributes.where(matches(filters)) if filters else None
    return resolved(postings.search(index, asked, k, allowed=allowed), texts)


def representatives(fused: DataFrame, dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """fused hits with the other columns of the dense hit of their unit, or else of the lexical one."""
    extra = [c for c in dense.columns if c in lexical.columns and c not in ("query_id", "unit_id", "score", "rank")]
    d = dense.select("query_id", "unit_id", F.lit(True).alias("__d"), *[F.col(c).alias(f"__d_{c}") for c in extra])
    x = lexical.select("query_id", "unit_id", *[F.col(c).alias(f"__x_{c}") for c in extra])
    both = fused.join(d, ["query_id", "unit_id"], "left").join(x, ["query_id", "unit_id"], "left")
    return both.select(*fused.columns, *[F.when(F.col("__d"), F.col(f"__d_{c}")).otherwise(F.col(f"__x_{c}")).alias(c) for c in extra])


def strategies(names: list[str], known: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """The runs of the named strategies, each made once; unknown names raise."""
    lost = [n for n in names if n not in known]
    if lost:
        raise ValueError(f"unknown strategies {lost}; known are {sorted(known)}")
    return {n: known[n]() for n in dict.fromkeys(names)}


def representative_rows(rows: DataFrame, n: int = 10) -> DataFrame:
    """At most n of rows(unit_id, text, role, is_table), the same every time: the shortest, the median and the longest, the
    first of each role, the first table, then by length. Ranks by length are made from counts of each length."""
    sized = rows.withColumn("size", F.length("text"))
    count = sized.count()
    per = sized.groupBy("size").agg(F.count("*").alias("c"))
    at = per.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("size").orderBy("unit_id")) - 1
    # only lengths that hold the median or lie at the ends are looked into; lengths are few, rows many
    wanted = at.where((F.col("before") < n + 1) | ((F.col("before") <= count // 2) & (F.col("before") + F.col("c") > count // 2)) | (F.col("before") + F.col("c") == count))
    near = sized.join(wanted, "size").withColumn("place", F.col("before") + own)
    firsts = sized.groupBy("role").agg(F.min_by(F.struct("unit_id", "size"), F.struct("size", "unit_id")).alias("f")).select(F.lit(3).alias("why"), "f.unit_id", "f.size")
    table = sized.where("is_table").orderBy("size", "unit_id").limit(1).select(F.lit(4).alias("why"), "unit_id", "size")
    why = F.when(F.col("place") == 0, 0).when(F.col("place") == count // 2, 1).when(F.col("place") == count - 1, 2).otherwise(5)
    named = near.select(why.alias("why"), "unit_id", "size").unionByName(firsts).unionByName(table)
    return named.groupBy("unit_id", "size").agg(F.min("why").alias("why")).orderBy("why", "size", "unit_id").limit(n)
