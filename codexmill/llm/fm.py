"""Quality classifier: a factorisation machine over hashed words, structure statistics and the character-count column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.llm.common import WordHasher, alnum_words, held_out, labelled_texts, mix, released, values

#: Labelled rows that may be fitted on: the bound of the one task that learns.
TRAIN_ROWS = 6_000
BUCKETS = 1 << 13
RANK = 6
EPOCHS, RATE, DECAY = 6, 0.05, 2e-3
THRESHOLD = 0.3
#: Structure statistics, in this order, and one for the metadata.
STATS = (
    "log_words", "log_chars", "chars_per_word", "upper_share", "digit_share", "symbol_share", "bang_share", "space_share",
    "other_share", "non_ascii_share", "distinct_share", "repeat_lines", "log_lines", "upper_words", "letterless_words", "meta_log_chars",
)
_DIM = BUCKETS + len(STATS)
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOL, _BANG, _SPACE = b"#*$%&|<>@~^\\{}[]_=+", b"!?", b" \t\n\r\x0b\x0c"
_OTHER = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _SYMBOL + _BANG)
_NON_ASCII = bytes(range(128, 256))


def _count(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def statistics(raw: bytes, n_chars: float | None) -> np.ndarray:
    words, lines = raw.split(), raw.split(b"\n")
    n, w, k = max(1, len(raw)), max(1, len(words)), max(1, len(lines))
    upper = sum(map(bytes.isupper, words))
    bare = (len(words) - sum(map(bytes.isalnum, words))) / w
    return np.array([
        np.log1p(len(words)), np.log1p(len(raw)), len(raw) / w, _count(raw, _UPPER) / n, _count(raw, _DIGIT) / n, _count(raw, _SYMBOL) / n,
        _count(raw, _BANG) / n, _count(raw, _SPACE) / n, _count(raw, _OTHER) / n, _count(raw, _NON_ASCII) / n,
        len(set(words)) / w, 1 - len(set(lines)) / k, np.log1p(len(lines)), upper / w, bare, np.log1p(max(0.0, n_chars or 0.0)),
    ])


def encode(raw: bytes, n_chars: float | None, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct word buckets, their values, statistics); the values of a document's words have unit length."""
    words = alnum_words(raw)
    idx, tf = np.unique((mix(hasher(words)) % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    x = np.log1p(tf)
    return idx, x / (np.linalg.norm(x) or 1.0), statistics(raw, n_chars)


def fm_score(w0: float, w: np.ndarray, v: np.ndarray, idx: np.ndarray, x: np.ndarray) -> float:
    """The pairwise terms in time linear in the features: half of (sum of v x) squared less the sum of (v x) squared, over the factors."""
    vx = v[idx] * x[:, None]
    s = vx.sum(axis=0)
    return float(w0 + w[idx] @ x + 0.5 * (s @ s - (vx * vx).sum()))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], seed: int = 11):
    """(w0, w, v, mean, spread) by AdaGrad on the logistic loss; classes count alike."""
    stats = np.array([r[2] for r in rows]) if rows else np.zeros((1, len(STATS)))
    mean, spread = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(_DIM), rng.normal(0, 0.02, (_DIM, RANK))
    g0, gw, gv = 1e-8, np.full(_DIM, 1e-8), np.full((_DIM, RANK), 1e-8)
    tail = np.arange(BUCKETS, _DIM)
    ready = [(np.concatenate([i, tail]), np.concatenate([x, np.clip((s - mean) / spread, -4, 4) / 4]), y) for i, x, s, y in rows]
    for _ in range(EPOCHS):
        for i in rng.permutation(len(ready)):
            idx, x, y = ready[i]
            vi = v[idx]
            vx = vi * x[:, None]
            s = vx.sum(axis=0)
            p = 1 / (1 + np.exp(-np.clip(w0 + w[idx] @ x + 0.5 * (s @ s - (vx * vx).sum()), -30, 30)))
            e = p - y
            g0 += e * e
            w0 -= RATE * e / np.sqrt(g0)
            d = e * x + DECAY * w[idx]
            gw[idx] += d * d
            w[idx] -= RATE * d / np.sqrt(gw[idx])
            dv = e * (x[:, None] * s - vi * (x * x)[:, None]) + DECAY * vi
            gv[idx] += dv * dv
            v[idx] = vi - RATE * dv / np.sqrt(gv[idx])
    return w0, w, v, mean, spread


def _chars(docs: DataFrame) -> Column:
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("double").alias("n_chars")


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), _chars(docs))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = TRAIN_ROWS):
    """Learns in one task on at most `rows` labelled documents outside the held-out fold. No labelled rows: all weights as drawn, score near 0.5."""

    def learn(batches):
        got, hasher = [], WordHasher()
        for batch in batches:
            for i, t, n, y in zip(*(values(batch.column(c)) for c in ("doc_id", "text", "n_chars", "label"))):
                got.append((i, *encode(t, n, hasher), y))
        got.sort(key=lambda r: r[0])
        w0, w, v, mean, spread = train([r[1:] for r in got])
        flat = np.concatenate([[w0], w, v.ravel(), mean, spread])
        yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], ["model"])

    texts = labelled_texts(docs.select("doc_id", "text", _chars(docs)), labels, column, rows, "n_chars")
    (row,) = texts.repartition(1).mapInArrow(released(learn), "model binary").collect()
    flat = np.frombuffer(row["model"])
    k = len(STATS)
    return flat[0], flat[1 : 1 + _DIM], flat[1 + _DIM : -2 * k].reshape(_DIM, RANK), flat[-2 * k : -k], flat[-k:]


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null texts count as empty and are scored by their statistics; a null or absent n_chars counts as 0; repeated rows
    are scored each; ties at the threshold are kept; extra columns are ignored; an empty table gives an empty result."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows=rows))

    def run(batches):
        w0, w, v, mean, spread = model.value
        tail, hasher = np.arange(BUCKETS, _DIM), WordHasher()
        for batch in batches:
            out = []
            for raw, n in zip(values(batch.column("text")), values(batch.column("n_chars"))):
                idx, x, s = encode(raw, n, hasher)
                s = np.clip((s - mean) / spread, -4, 4) / 4
                y = fm_score(w0, w, v, np.concatenate([idx, tail]), np.concatenate([x, s]))
                out.append(1 / (1 + np.exp(-np.clip(y, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    schema = docs.select("doc_id").schema.add("score", "double")
    scored = _inputs(docs).mapInArrow(released(run), schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
