"""Whitening of embeddings: exact moments by generated column aggregates, decomposed by LAPACK."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries from here on have no exact value in doubles and long, and count as non-finite.
_MOST = 2.0**43
#: Dimensions of one panel of the covariance: its pairs are the columns of one group. Larger ones take long to compile.
PANEL = 16
#: Eigenvalues at or below this share of the largest, times the dimensions, are directions without variance.
_FLAT = 1e-13


def fit_list(vectors: DataFrame) -> tuple[DataFrame, int]:
    """((vec_id, x array<long>) of the usable rows, their dimensions)."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < _MOST, F.lit(False)))
    held = vectors.where(usable).select("vec_id", "embedding")
    found = held.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = found["d"] if found else 0
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return held.where(F.size("embedding") == d).select("vec_id", x.alias("x")), d


def _literal(numbers, kind: type) -> Column:
    return F.lit(np.array(numbers, kind))


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, exact sums of each entry of x), one aggregation."""
    got = rows.agg(F.expr("count(*) AS n"), *[F.expr(f"sum(x[{i}]) AS s{i}") for i in range(d)]).first()
    return got["n"], [got[f"s{i}"] or 0 for i in range(d)]


def pair_sums(rows: DataFrame, column: str, d: int, panel: int = PANEL) -> np.ndarray:
    """Sums of column[i] * column[j] over all rows, as a symmetric matrix, by one aggregation of generated expressions.

    Up to `panel` entries, each pair i <= j is a column of one row. Longer arrays are cut into pieces of `panel` entries; a
    row stands once for each pair of pieces, and a group sums the products of one such pair, so that a plan never has more
    than panel * panel sums. Groups are few and partial sums are all that is shuffled."""
    out = np.zeros((d, d))
    if d <= panel:
        got = rows.agg(*[F.expr(f"sum({column}[{i}] * {column}[{j}]) AS p{i}_{j}") for i in range(d) for j in range(i, d)]).first()
        for i in range(d):
            for j in range(i, d):
                out[i, j] = out[j, i] = got[f"p{i}_{j}"] or 0.0
        return out
    pieces = -(-d // panel)
    pairs = ", ".join(f"named_struct('a', {a}, 'b', {b})" for a in range(pieces) for b in range(a, pieces))
    cut = rows.select(F.expr(f"explode(array({pairs})) AS at"), column).select("at", *[F.expr(f"slice({column}, at.{k} * {panel} + 1, {panel}) AS {k}") for k in "ab"])
    products = [F.expr(f"sum(get(a, {i}) * get(b, {j})) AS p{i}_{j}") for i in range(panel) for j in range(panel)]
    for got in cut.groupBy("at").agg(*products).toLocalIterator():
        for i in range(got["at"]["a"] * panel, min(d, (got["at"]["a"] + 1) * panel)):
            for j in range(got["at"]["b"] * panel, min(d, (got["at"]["b"] + 1) * panel)):
                out[i, j] = out[j, i] = got[f"p{i % panel}_{j % panel}"] or 0.0
    return out


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) by falling eigenvalue, at most `most`; the largest entry of a vector is positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, rows = values[::-1][:most], vectors.T[::-1][:most]
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])
    return values, rows * signs[:, None]


def whiten(vectors: DataFrame, most: int = COMPONENTS, panel: int = PANEL) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row and component up to `most`.

    Rows whose vector is null, or holds a null, a NaN, an infinity or an entry of 2^43 or more, go, as do those whose length is
    not the most common one (ties: the longer). All others make the fit list and are returned, repeated rows and null ids too.
    Reads: one for lengths, one for exact sums, one for centred products of all pairs of dimensions, one for the covariance of
    what is whitened, one for the result; a row of sums is all that is collected, d * d numbers at most.

    A vector has as many components as dimensions, if fewer. A component without variance (all of them if rows are equal) has
    null in whitened and does not count in identity_error; explained is null where there is no variance at all.
    deviation is null where it leaves the range of long. An empty table, or empty vectors, give an empty result. Extra
    columns are ignored, whatever their names."""
    rows, d = fit_list(vectors)
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return vectors.sparkSession.createDataFrame([], shape)
    n, total = sums(rows, d)
    means = _literal([s / n for s in total], np.float64)
    centred = rows.select("vec_id", "x", F.zip_with("x", means, lambda x, m: x - m).alias("c"))
    covariance = pair_sums(centred, "c", d, panel) / n
    values, vectors_of = components(covariance, most)
    trace = float(np.trace(covariance))
    varied = [bool(e > 0 and e > values[0] * d * _FLAT) for e in values]

    def projected(e: float, unit: np.ndarray) -> Column:
        dot = F.aggregate(F.zip_with("c", _literal(unit.tolist(), np.float64), lambda c, p: c * p), F.lit(0.0), lambda s, v: s + v)
        return dot / F.lit(float(np.sqrt(e)))

    made = [projected(float(e), unit) if ok else F.lit(None).cast("double") for e, unit, ok in zip(values, vectors_of, varied)]
    white = centred.select("vec_id", "x", F.array(*made).alias("w"))
    error, kept = None, sum(varied)
    if kept:
        # w is centred already; what rounding leaves of its mean is taken off
        got = white.agg(*[F.expr(f"sum(w[{k}]) AS m{k}") for k in range(kept)], *[F.expr(f"sum(w[{a}] * w[{b}]) AS p{a}_{b}") for a in range(kept) for b in range(a, kept)]).first()
        error = max(abs(got[f"p{a}_{b}"] / n - got[f"m{a}"] / n * got[f"m{b}"] / n - (a == b)) for a in range(kept) for b in range(a, kept))
    moved = F.zip_with("x", _literal(total, np.int64), lambda x, s: F.try_subtract(F.try_multiply(x, F.lit(n).cast("long")), s))
    deviation = F.aggregate(moved, F.lit(0).cast("long"), lambda s, v: F.try_add(s, F.try_multiply(v, v)))
    shares = _literal([float(e) / trace for e in values], np.float64) if trace > 0 else F.array(*[F.lit(None).cast("double")] * len(values))
    spread = white.select("vec_id", deviation.alias("deviation"), F.posexplode("w").alias("k", "whitened"))
    return spread.select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("k") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
