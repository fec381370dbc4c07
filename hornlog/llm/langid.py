"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into segments of ``SEGMENT`` bytes; all bytes of all texts are read.
One recurrent network runs over a segment forwards and one backwards; from both
states every byte gets its own language probabilities.  A document's probabilities
are the mean over its bytes.  The networks are trained in numpy by
backpropagation through time.  A labelled row to learn from is one segment of a
text outside the held-out fold, with the text's language; any segment of any text
may be taken.  Of each language's distinct segments, those whose hashes come first
are learned from, ``PER_LANG`` at most.  All languages are learned.

Defined cases: a text that is null, empty or without letters is ``und`` with
score 0; repeated rows are each judged, and learned from once; with no labelled row
to learn from, every text is ``und``; with one language only, every text with
letters is of it; of languages equally likely the first by name is taken; texts may
be of any length; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, crc_fold, fold, mix64, pick, tidy

SEGMENT, HIDDEN = 96, 8
PER_LANG = 1_600
FOLDS, HELD_OUT = 5, 0
JUDGED = "doc_id bigint, held_out boolean, lang_pred string, score double"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.add(x, 1.0, out=x)
    return np.multiply(x, 0.5, out=x)


class Gru:
    """One direction.  Gates are ordered update, reset, candidate."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.w = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        self.hidden = hidden

    def states(self, steps: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
        """The state after each row of ``steps`` (time, lanes); ``keep`` gets what training needs."""
        k = self.hidden
        h = np.zeros((steps.shape[1], k), np.float32)
        for row in steps:
            g = self.w[row]
            a = h @ self.u
            zr = _sigmoid(g[:, : 2 * k] + a[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(g[:, 2 * k :] + r * a[:, 2 * k :])
            if keep is not None:
                keep.append((row, h, z, r, n, a[:, 2 * k :]))
            h = n + z * (h - n)
            yield h

    def gradients(self, keep: list, dh_each: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time; dh_each has the loss's gradient by each state."""
        k = self.hidden
        dw, du = np.zeros_like(self.w), np.zeros_like(self.u)
        carry = np.zeros_like(dh_each[0])
        for t in range(len(keep) - 1, -1, -1):
            row, h, z, r, n, an = keep[t]
            d = dh_each[t] + carry
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            by_input = np.concatenate([dz, dr, dn], axis=1)
            by_state = np.concatenate([dz, dr, dn * r], axis=1)
            np.add.at(dw, row, by_input)
            du += h.T @ by_state
            carry = d * z + by_state @ self.u.T
        return [dw, du]


class ByteTagger:
    """Forward and backward networks and a softmax over languages at every byte."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.nets = (Gru(rng, hidden), Gru(rng, hidden))
        self.v = [rng.normal(0, 0.3, (hidden, len(langs))).astype(np.float32) for _ in range(2)]
        self.b = np.zeros(len(langs), np.float32)

    def logits(self, steps: np.ndarray, keeps=(None, None), hs=(None, None)) -> np.ndarray:
        """(time, lanes, languages) of segments given as (time, lanes)."""
        out = np.empty((*steps.shape, len(self.langs)), np.float32)
        for t, h in enumerate(self.nets[0].states(steps, keeps[0])):
            np.matmul(h, self.v[0], out=out[t])
            out[t] += self.b
            if hs[0] is not None:
                hs[0].append(h)
        for t, h in enumerate(self.nets[1].states(steps[::-1], keeps[1])):
            out[len(steps) - 1 - t] += h @ self.v[1]
            if hs[1] is not None:
                hs[1].append(h)
        return out

    def train(self, segments: np.ndarray, target: np.ndarray, epochs: int = 6, rate: float = 0.02) -> None:
        """segments: (lanes, time) of full segments; target: each lane's language."""
        params = [self.nets[0].w, self.nets[0].u, self.nets[1].w, self.nets[1].u, *self.v, self.b]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        rng = np.random.default_rng(5)
        for _ in range(epochs):
            order = rng.permutation(len(segments))
            for a in range(0, len(order), 256):
                lanes = order[a : a + 256]
                steps = np.ascontiguousarray(segments[lanes].T)
                keeps, hs = ([], []), ([], [])
                p = self.logits(steps, keeps, hs)
                p = np.exp(p - p.max(axis=2, keepdims=True))
                p /= p.sum(axis=2, keepdims=True)
                p[:, np.arange(len(lanes)), target[lanes]] -= 1
                p /= steps.size
                hf, hb = np.stack(hs[0]), np.stack(hs[1])
                back = p[::-1]
                grads = [
                    *self.nets[0].gradients(keeps[0], p @ self.v[0].T), *self.nets[1].gradients(keeps[1], back @ self.v[1].T),
                    np.einsum("tlh,tlc->hc", hf, p), np.einsum("tlh,tlc->hc", hb, back), p.sum(axis=(0, 1)),
                ]
                step += 1
                for k, g in enumerate(grads):
                    np.clip(g, -1, 1, out=g)
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean over each text's bytes of their language probabilities."""
        n = np.array([len(t) for t in texts], np.int64)
        count = -(-n // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), count)
        padded = b"".join(t + b" " * (c * SEGMENT - len(t)) for t, c in zip(texts, count.tolist(), strict=True))
        lanes = np.frombuffer(padded, np.uint8).reshape(-1, SEGMENT)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        lengths = np.minimum(n[owner] - nth * SEGMENT, SEGMENT)
        total = np.zeros((len(texts), len(self.langs)))
        most = max(16, min(4096, 16384 // len(self.langs)))  # the larger the output layer, the fewer lanes at once
        for a in range(0, len(lanes), most):
            steps = np.ascontiguousarray(lanes[a : a + most].T)
            p = self.logits(steps)
            p -= p.max(axis=2, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(axis=2, keepdims=True)
            p *= (np.arange(SEGMENT)[:, None] < lengths[None, a : a + most])[:, :, None]
            np.add.at(total, owner[a : a + most], p.sum(axis=0, dtype=np.float64))
        return total / np.maximum(n, 1)[:, None]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(documents: DataFrame, per_lang: int = PER_LANG) -> ByteTagger | None:
    learn = pick(documents, "doc_id", "text", "lang").where("lang is not null and text is not null").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / SEGMENT)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    if len(langs) == 1:
        return ByteTagger(langs)
    # segments whose hash is below this share of the range: more than per_lang are expected, so that the rest is cut exactly below
    share = {x: min(1.0, (1.5 * per_lang + 100) / max(1, n)) for x, n in sizes.items()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            pieces, owner, order = [], [], []
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if has_letter(text):
                    raw = text.encode("utf-8", "surrogatepass")
                    h = mix64(np.arange(-(-len(raw) // SEGMENT), dtype=np.uint64) + np.uint64(zlib.crc32(raw) << 20)) >> np.uint64(1)
                    for k in np.flatnonzero(h < np.uint64(int(share[lang] * (2**63 - 1)))).tolist():
                        pieces.append(raw[k * SEGMENT : (k + 1) * SEGMENT].ljust(SEGMENT))
                        owner.append(lang)
                        order.append(int(h[k]))
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.string()), pa.array(pieces, pa.binary()), pa.array(order, pa.int64())], ["lang", "piece", "h"])

    found = learn.mapInArrow(tidy(cut), "lang string, piece binary, h bigint").groupBy("lang", "piece").agg(F.min("h").alias("h"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))
    rows = found.withColumn("nth", first).where(F.col("nth") <= per_lang).select("lang", "piece").collect()  # per_lang rows a language at most
    rows = sorted((r["lang"], bytes(r["piece"])) for r in rows)
    model = ByteTagger(langs)
    place = {x: k for k, x in enumerate(langs)}
    model.train(np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, SEGMENT), np.array([place[r[0]] for r in rows], np.int64))
    return model


def identify(documents: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(fit(documents, per_lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in bounded(batches, most=1 << 20):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = np.array([model is not None and has_letter(t) for t in texts], bool)
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if ok.any():
                p = model.probabilities([t.encode("utf-8", "surrogatepass") for t, k in zip(texts, ok, strict=True) if k])
                for k, row in zip(np.flatnonzero(ok).tolist(), p, strict=True):
                    lang[k], score[k] = model.langs[int(row.argmax())], min(1.0, float(row.max()))
            out = [crc_fold(i, FOLDS) == HELD_OUT for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_()), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return pick(documents, "doc_id", "text").mapInArrow(tidy(run), JUDGED)
