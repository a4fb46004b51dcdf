"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from codexmill.llm.common import WordHasher, alnum_words, held_out, labelled_texts, mix, released, values

#: Labelled rows that may be fitted on: the bound of the one task that learns.
TRAIN_ROWS = 8_000
#: Hashed feature space; with L1 only a small part gets a weight, so what is broadcast is at most 12 bytes * BUCKETS.
BUCKETS = 1 << 20
#: Chosen by the log loss of an inner fold (crc32 of the id modulo 5 is 1), never by the held-out rows.
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 4.0, 1.0
#: Beginnings of words, in bytes, that count as unigrams besides the whole words: on the inner fold 80 of 97 toxic texts are
#: found with them and 68 without.
STEMS = (4, 5, 6)
THRESHOLD = 0.5


def features(words: list[bytes], hasher: WordHasher, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed unigrams (and their STEMS-byte beginnings), bigrams and skip-grams over one word; may hold repeats."""
    if not words:
        return np.empty(0, np.int64)
    h, distinct = hasher(words), list(set(words))
    parts = [mix(h + np.uint64(1))]
    parts += [mix(hasher([w[:k] for w in distinct if len(w) > k]) + np.uint64(k << 41)) for k in STEMS]
    if len(h) > 1:
        parts.append(mix(h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(3)))
    if len(h) > 2:
        parts.append(mix(h[:-2] * np.uint64(0x9E3779B1) + h[2:] * np.uint64(3) + np.uint64(1 << 40)))
    return (np.concatenate(parts) % np.uint64(buckets)).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, int]], buckets: int, epochs: int = EPOCHS, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, indices, weights) of the non-zero weights. rows: (distinct feature indices, label).

    Each coordinate has its own rate (ALPHA / (BETA + sqrt of its squared gradients)) and is zero while L1 outweighs
    its accumulated gradient."""
    z, g2 = np.zeros(buckets + 1), np.zeros(buckets + 1)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            idx, label = rows[i]
            zi, gi = z[idx], g2[idx]
            root = np.sqrt(gi)
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2))
            b_root = np.sqrt(g2[buckets])
            bias = -z[buckets] / ((BETA + b_root) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - label
            z[idx] = zi + g - (np.sqrt(gi + g * g) - root) / ALPHA * w
            g2[idx] = gi + g * g
            z[buckets] += g - (np.sqrt(g2[buckets] + g * g) - b_root) / ALPHA * bias
            g2[buckets] += g * g
    bias = float(-z[buckets] / ((BETA + np.sqrt(g2[buckets])) / ALPHA))
    kept = np.nonzero(np.abs(z[:buckets]) > L1)[0]
    weights = (np.sign(z[kept]) * L1 - z[kept]) / ((BETA + np.sqrt(g2[kept])) / ALPHA + L2)
    return bias, kept, weights


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", rows: int = TRAIN_ROWS, buckets: int = BUCKETS) -> tuple[float, np.ndarray, np.ndarray]:
    """Learns on at most `rows` labelled documents outside the held-out fold: features are made where the texts are,
    one task learns, the driver gets the sparse weights only. No labelled rows: bias 0 and no weights."""

    def featurise(batches):
        hasher = WordHasher()
        for batch in batches:
            found = [np.unique(features(alnum_words(t), hasher, buckets)) for t in values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64())), batch.column("label")], ["doc_id", "idx", "label"])

    def learn(batches):
        got = []
        for batch in batches:
            lists, idx = batch.column("idx"), batch.column("idx").flatten().to_numpy().astype(np.int32)
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            got += zip(batch.column("doc_id").to_pylist(), [idx[a:b] for a, b in zip(ends, ends[1:])], batch.column("label").to_pylist())
        got.sort(key=lambda r: r[0])
        bias, kept, weights = ftrl([(idx, label) for _, idx, label in got], buckets)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *kept.tolist()], pa.int64()), pa.array([bias, *weights.tolist()], pa.float64())], ["idx", "weight"])

    made = labelled_texts(docs, labels, column, rows).mapInArrow(released(featurise), "doc_id long, idx array<long>, label int")
    model = made.repartition(1).mapInArrow(released(learn), "idx long, weight double").collect()
    bias = sum(r["weight"] for r in model if r["idx"] < 0)
    rest = sorted((r["idx"], r["weight"]) for r in model if r["idx"] >= 0)
    return bias, np.array([i for i, _ in rest], np.int64), np.array([w for _, w in rest])


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], buckets: int = BUCKETS, name: str = "toxicity") -> DataFrame:
    """docs with a double column `name` (0 to 1) from the whole text; null and empty texts get the bias's score.

    A column of that name already there is an error, not overwritten."""
    if name in docs.columns:
        raise ValueError(f"docs have a column {name} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        bias, kept, weights = shared.value
        dense = np.zeros(buckets)
        dense[kept] = weights
        used, hasher = dense != 0, WordHasher()
        for batch in batches:
            out = []
            for raw in values(batch.column(place).cast(pa.binary())):
                idx = features(alnum_words(raw or b""), hasher, buckets)
                total = bias + dense[np.unique(idx[used[idx]])].sum()
                out.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(released(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; repeated rows are scored each, ties at the threshold are toxic.

    Only text is scored; labels with null ids or values are ignored; an empty table gives an empty result."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, rows=rows))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted")
    )
