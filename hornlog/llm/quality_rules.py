"""Quality rules: word and repetition counts, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are counted: one over
the trusted target (labelled good documents), one over the whole raw corpus.
A document's score is the mean log ratio of its n-grams, so long and short
documents compare; it is kept if the score reaches a threshold that the target
itself sets, a margin below ``QUANTILE`` of the scores of labelled good documents whose words
were left out of the target's counts (one id in five, by crc32).  The raw counts
cover every document, the target's and the threshold's every labelled good one.

``QUANTILE`` and ``MARGIN`` favour keeping: a good document of a kind that the labels
lack scores below those that they hold, so the threshold lies below all but two in a
thousand of them, by half as much again as those lie below the median.

Defined cases: a null or empty text has no words, all counts 0, score 0 and
fails the base rules; repeated rows are each judged and counted; a document
whose label rows disagree is in the target if any of them is good; without
any target document every ratio is 0 and the threshold 0, so the base rules
alone decide; a score equal to the threshold passes; texts may be of any length;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NEWLINE, SPACE, Segments, bounded, fold, inside, materialize, mix64, pick, sequence_hash, tidy

BUCKETS = 1 << 15
#: Target ids that are broadcast at most (9 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
QUANTILE = 0.002
#: The threshold lies below that quantile by this share of its distance from the median.
MARGIN = 0.5
#: The quantiles are read from counts of scores in steps of this, within +- REACH.
STEP, REACH = 1e-3, 20.0
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))

RULES = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, llr double"
)


def base_counts(texts: list[str | None], w: Segments) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text, whose words are ``w``."""
    black = ~SPACE[w.raw]
    chars = w.bytes_per_text(black & (w.raw & 0xC0 != 0x80))
    symbols = w.bytes_per_text(_SYMBOLS[w.raw])
    lines = Segments(texts, NEWLINE)
    total = np.concatenate([[0], np.cumsum(~SPACE[lines.raw])])
    worded = total[lines.end] > total[lines.first]
    text_of = lines.which()[worded]
    with np.errstate(over="ignore"):
        key = mix64(lines.hash[worded] + mix64(text_of.astype(np.uint64)))
    _, once = np.unique(key, return_index=True)
    n_lines = np.bincount(text_of, minlength=len(texts))
    dup = n_lines - np.bincount(text_of[once], minlength=len(texts))
    return np.stack([w.n, chars, symbols, dup, w.per_text(repeated(w))], axis=1).astype(np.int64)


def repeated(w: Segments) -> np.ndarray:
    """Which words are inside a 3-word window that stands in its text at least twice, the first time included."""
    cover = np.zeros(len(w.hash), bool)
    at = np.flatnonzero(inside(w.starts, len(w.hash), 3))
    with np.errstate(over="ignore"):
        key = mix64(sequence_hash(w.hash, 3)[at] + mix64(w.which()[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = at[np.unique(np.concatenate([order[1:][same], order[:-1][same]]))]
    for k in range(3):
        cover[twice + k] = True
    return cover


def ngram_buckets(w: Segments, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unigram buckets of all words, bigram buckets of neighbours, and which neighbours share a text."""
    modulus = np.uint64(buckets)
    return (w.hash % modulus).astype(np.int64), (sequence_hash(w.hash, 2) % modulus).astype(np.int64), inside(w.starts, len(w.hash), 2)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None], Segments]]:
    for batch in bounded(batches):
        texts = batch.column(1).to_pylist()
        yield batch.column(0), texts, Segments(texts)


def _score(w: Segments, table: np.ndarray) -> np.ndarray:
    uni, bi, within = ngram_buckets(w, len(table))
    gain = table[uni]
    gain[1:] += np.where(within, table[bi], 0.0)
    return w.per_text(gain) / np.maximum(2 * w.n - 1, 1)


def _quantiles(scores: DataFrame, shares: list[float]) -> list[float] | None:
    """Quantiles of llr, to a STEP, from counts of a bounded number of bins."""
    bins = scores.select(F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.col("llr"))) / STEP).alias("bin")).groupBy("bin").count().collect()
    if not bins:
        return None
    at = np.array(sorted((r["bin"], r["count"]) for r in bins))
    total = np.cumsum(at[:, 1])
    return [float(at[min(len(at) - 1, int(np.searchsorted(total, x * total[-1], "right"))), 0] * STEP) for x in shares]


def fit(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS, quantile: float = QUANTILE, broadcast_rows: int = BROADCAST_ROWS):
    """(log-ratio table, threshold): counts over all documents, threshold from all labelled good ones set aside."""
    good_ids = pick(labels, "doc_id", "quality").where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    good_ids = materialize(good_ids.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("aside")), "target-ids")
    bound = F.broadcast if good_ids.count() <= broadcast_rows else (lambda df: df)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for batch in bounded(batches):
            w = Segments(batch.column(1).to_pylist())
            uni, bi, within = ngram_buckets(w, buckets)
            good = np.repeat(np.array([x is False for x in batch.column(2).to_pylist()], bool), w.n)
            sums[0] += np.bincount(uni, minlength=buckets) + np.bincount(bi[within], minlength=buckets)
            both = within & good[1:]
            sums[1] += np.bincount(uni[good], minlength=buckets) + np.bincount(bi[both], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])], ["bucket", "raw", "good"])

    docs = pick(documents, "doc_id", "text")
    flagged = docs.join(bound(good_ids), "doc_id", "left").select("doc_id", "text", "aside")
    rows = flagged.mapInArrow(tidy(count), "bucket int, raw bigint, good bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    if not good.sum():
        return np.zeros(buckets), 0.0
    table = np.log((good + 1) / (good.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    sample = docs.join(bound(good_ids.where("aside")), "doc_id", "left_semi")
    at = _quantiles(score(sample, table, -np.inf).where("n_words >= 50"), [quantile, 0.5])
    return table, 0.0 if at is None else at[0] - MARGIN * (at[1] - at[0])


def score(documents: DataFrame, table: np.ndarray, threshold: float) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(table)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, w in _batches(batches):
            llr = _score(w, held.value)
            base = base_counts(texts, w)
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(np.ascontiguousarray(base[:, k])) for k in range(5)), pa.array(failed), pa.array(~failed & (llr >= threshold)), pa.array(llr)],
                RULES.replace(" bigint", "").replace(" boolean", "").replace(" double", "").split(", "),
            )

    return pick(documents, "doc_id", "text").mapInArrow(tidy(judge), RULES)


def quality_rules(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    table, threshold = fit(documents, labels, **how)
    return score(documents, table, threshold)
