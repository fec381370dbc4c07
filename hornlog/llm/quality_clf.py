"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a slot by its hash, and another by its shape (runs of lower,
upper, digit and each other byte; whether it repeats the word before).  A slot's
random index is a sparse ternary vector; its word vector is the sum of the
indexes of all neighbours in the whole corpus, scaled to length 1.  A document
is the mean of its words' vectors and of its shapes' vectors, with its length.
A two-layer numpy network learns from a bounded sample of labelled documents
outside the held-out fold (``TRAIN_ROWS``, those whose hashed ids come first); one
in five of them sets the temperature that calibrates its probabilities.

Defined cases: null and empty texts have zero vectors and are scored as such;
repeated rows are each scored; of several labels of an id the lowest counts;
if the labels to learn from have one class only, every score is that class's
share; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Segments, bounded, crc_fold, fold, materialize, mix64, pick, tidy

WORD_SLOTS, SHAPE_SLOTS, DIM = 1 << 13, 1 << 9, 24
SLOTS = WORD_SLOTS + SHAPE_SLOTS
FEATURES = 2 * DIM + 2
TRAIN_ROWS = 8_000
FOLDS, HELD_OUT = 4, 2
LIMIT = 0.7
_PIECE = 1 << 17
SCORED = "doc_id bigint, held_out boolean, score double, predicted int"
_SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def slots(texts: list[str | None]) -> tuple[Segments, np.ndarray, np.ndarray]:
    """The texts' words, and for each its word slot and its shape slot."""
    w = Segments(texts)
    sums = np.empty(len(w.first), np.uint64)
    a = 0
    while a < len(w.first):  # some words at a time, since each byte takes several numbers
        b = max(a + 1, int(np.searchsorted(w.end, w.first[a] + _PIECE, "right")))
        sums[a:b] = _shapes(w.bytes[w.first[a] : w.end[b - 1]], w.first[a:b] - w.first[a], w.end[a:b] - w.first[a])
        a = b
    again = np.zeros(len(w.hash), np.uint64)
    again[1:] = w.hash[1:] == w.hash[:-1]
    with np.errstate(over="ignore"):
        shape = (mix64(sums + again) % np.uint64(SHAPE_SLOTS)).astype(np.int64) + WORD_SLOTS
    return w, (w.hash % np.uint64(WORD_SLOTS)).astype(np.int64), shape


def _shapes(raw: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's runs."""
    shaped = np.frombuffer(raw.translate(_SHAPE), np.uint8)
    edge = np.ones(len(shaped), bool)
    edge[1:] = shaped[1:] != shaped[:-1]  # one byte for each run
    with np.errstate(over="ignore"):
        code = np.where(edge, mix64(shaped.astype(np.uint64) + np.uint64(1)), np.uint64(0))
        nth = np.cumsum(edge)  # runs so far, to weigh a run by its place in the word
        total = np.concatenate([[np.uint64(0)], np.cumsum(code * (nth.astype(np.uint64) * np.uint64(2) + np.uint64(1)))])
        plain = np.concatenate([[np.uint64(0)], np.cumsum(code)])
        return total[end] - total[first] - (plain[end] - plain[first]) * (nth[first].astype(np.uint64) * np.uint64(2))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the two nonzero entries of every slot's random index."""
    h = mix64(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64)).reshape(SLOTS, 2)
    return (h % np.uint64(DIM)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def word_vectors(documents: DataFrame) -> np.ndarray:
    """The slots' vectors, from the neighbours of all words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total = np.zeros(SLOTS * DIM)
        for batch in bounded(batches, 0, 1 << 20):
            w, word, shape = slots(batch.column(0).to_pylist())
            text = w.which()
            ok = np.flatnonzero(text[1:] == text[:-1])
            for target, source in ((ok, ok + 1), (ok + 1, ok)):
                for t in (word, shape):
                    for s in (word, shape):
                        for k in range(2):
                            total += np.bincount(t[target] * DIM + place[s[source], k], weights=sign[s[source], k], minlength=SLOTS * DIM)
        total = total.reshape(SLOTS, DIM)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(total[at, k].astype(np.int64)) for k in range(DIM)]], ["slot", *[f"v{k}" for k in range(DIM)]])

    schema = "slot bigint, " + ", ".join(f"v{k} bigint" for k in range(DIM))
    sums = pick(documents, "text").mapInArrow(tidy(run), schema).groupBy("slot").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM)])
    out = np.zeros((SLOTS, DIM))
    for r in sums.collect():
        out[r["slot"]] = r[1:]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """One feature row for each text."""
    w, word, shape = slots(texts)
    out = np.zeros((len(texts), FEATURES), np.float32)
    full = np.flatnonzero(w.n)
    if len(full):
        at = w.starts[full]
        for k, s in enumerate((word, shape)):
            out[full, k * DIM : (k + 1) * DIM] = np.add.reduceat(vectors[s], at, axis=0) / w.n[full, None]
    out[:, -2] = np.log1p(w.n) / 8
    out[:, -1] = 1.0
    return out


class Network:
    """Two layers: tanh, then a logistic unit whose logit is divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 7):
        self.constant = None if 0 < y.sum() < len(y) else (float(y.mean()) if len(y) else 0.5)
        self.temperature = 1.0
        if self.constant is not None:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        aside = np.arange(len(x)) % 5 == 4
        if len(np.unique(y[aside])) < 2 or len(np.unique(y[~aside])) < 2:
            aside[:] = False
        z, t = ((x - self.mean) / self.scale)[~aside], y[~aside]
        self.p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for a in range(0, len(z), 128):
                b = order[a : a + 128]
                h = np.tanh(z[b] @ self.p[0] + self.p[1])
                d = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - t[b]) / len(b)
                back = d[:, None] * self.p[2] * (1 - h * h)
                grads = [z[b].T @ back + 1e-4 * self.p[0], back.sum(axis=0), h.T @ d + 1e-4 * self.p[2], np.array([d.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if aside.any():
            logits, t = self.logit(x[aside]), y[aside]
            grid = np.exp(np.linspace(0, np.log(8), 61))
            loss = [np.mean(np.logaddexp(0, -np.where(t > 0, 1, -1) * logits / g)) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network]:
    vectors = word_vectors(documents)
    spark = documents.sparkSession
    known = pick(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    chosen = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    chosen = materialize(chosen, "labelled-sample")  # at most train_rows rows
    held = spark.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, most=1 << 20):
            x = pooled(batch.column(1).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    sample = pick(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(tidy(run), "doc_id bigint, quality int, x binary")
    rows = sorted((r["doc_id"], r["quality"], bytes(r["x"])) for r in sample.collect())
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, FEATURES).astype(np.float64)
    return vectors, Network(x, np.array([r[1] for r in rows], np.float64))


def score(documents: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = held.value
        for batch in bounded(batches, most=1 << 20):
            p = network.score(pooled(batch.column(1).to_pylist(), vectors).astype(np.float64))
            out = [crc_fold(i, FOLDS) == HELD_OUT for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_()), pa.array(p), pa.array((p >= LIMIT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return pick(documents, "doc_id", "text").mapInArrow(tidy(run), SCORED)


def classify(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    return score(documents, *fit(documents, labels, train_rows))


def accepted(documents: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """The rows, with all columns, whose text reaches LIMIT."""
    held = documents.sparkSession.sparkContext.broadcast((vectors, network))
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = held.value
        for batch in bounded(batches, place, 1 << 20):
            p = network.score(pooled(batch.column(place).to_pylist(), vectors).astype(np.float64))
            yield batch.filter(pa.array(p >= LIMIT))

    return documents.mapInArrow(tidy(run), documents.schema)
