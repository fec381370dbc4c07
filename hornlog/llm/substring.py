"""Substring deduplication by difference-cover anchors.

Words are hashed at anchor positions only: those whose place in the document,
modulo a period, is in a difference cover.  For any two places there is a shift
below the period that takes both into the cover, so two documents that share a
window of ``window`` words share an anchor of ``window - period + 1`` words that
both have hashed.  Anchors that stand in two documents or more mark the stretch
of windows around them as candidates; those windows alone are hashed whole (128
bits) and compared.  A word goes if a window that covers it also starts in a
document with a smaller id.  Windows are judged on the input.

Anchors and windows of one document count once each, are reduced on the map side
to their smallest and largest document id, and only then shuffled; documents
that repeat a whole word sequence are settled before, by one hash each.

Defined cases: null and empty texts have no words and one row; a null id is
neither removed nor a source; rows that repeat an id are each judged, against
other ids only; texts may be of any length; an empty table gives an empty result;
extra columns are ignored.  Windows of different documents are told apart by 128
bits; which places of one document they are, by 64 of these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Segments, bounded, discard, inside, materialize, mix64, pick, sequence_hash, tidy

#: Perfect difference covers by period: every difference modulo the period occurs.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18)}
WINDOW = 50
#: Ids that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of a third of the window at least."""
    period = max(p for p in COVERS if window - p + 1 >= max(1, window // 3))
    return period, COVERS[period]


def anchors(w: Segments, period: int, cover: tuple[int, ...], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchors of all texts."""
    n = len(w.hash)
    ok = inside(w.starts, n, length)
    place = np.arange(len(ok)) - np.repeat(w.starts[:-1], w.n)[: len(ok)]
    at = np.flatnonzero(ok & np.isin(place % period, cover))
    return at, sequence_hash(w.hash, length)[at]


def _own_key(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that tell the same hash in different texts of a batch apart."""
    with np.errstate(over="ignore"):
        return mix64(h + mix64(text.astype(np.uint64) + np.uint64(1)))


def _once(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the first of each hash in each text."""
    return np.unique(_own_key(h, text), return_index=True)[1]


def _lists(parent: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """An Arrow list array of n rows; parent has each value's row, ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(parent, np.arange(n + 1)).astype(np.int32)), pa.array(values.view(np.int64)))


def _listed(lists: pa.Array) -> np.ndarray:
    """The hashes in the lists of a batch's rows, each told apart by its row."""
    sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
    values = np.concatenate([np.empty(0, np.uint64), *[np.asarray(x.values, np.int64).view(np.uint64) for x in lists if x.is_valid]])
    return _own_key(values, np.repeat(np.arange(len(sizes)), sizes))


def _among(docs: DataFrame, some: DataFrame) -> DataFrame:
    """The rows whose id is in ``some``, by a broadcast of the ids if they are few, so that no other text is shuffled."""
    return docs.join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi") if some.count() <= BROADCAST_ROWS else docs


def whole_copies(docs: DataFrame) -> DataFrame:
    """Ids of documents all of whose words are, in order, those of one with a smaller id; ids of several rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            w = Segments(batch.column(1).to_pylist(), second=True)
            place = (np.arange(len(w.hash)) - np.repeat(w.starts[:-1], w.n)).astype(np.uint64)
            with np.errstate(over="ignore"):
                keys = []
                for h in (w.hash, w.hash2):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h ^ mix64(place)))])
                    keys.append(pa.array((total[w.starts[1:]] - total[w.starts[:-1]]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *keys, pa.array(w.n)], ["doc_id", "k1", "k2", "n"])

    keyed = docs.where("doc_id is not null").mapInArrow(tidy(run), "doc_id bigint, k1 bigint, k2 bigint, n bigint").where("n > 0")
    keyed = materialize(keyed, "sequences")
    first = keyed.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    first = materialize(first, "repeated-sequences")  # so that the join reads plain shuffles, of which Spark can split a large group
    copies = keyed.join(first, ["k1", "k2", "n"]).where("doc_id > least").select("doc_id")
    several = keyed.groupBy("doc_id").count().where("count > 1").select("doc_id")
    return materialize(copies.join(several, "doc_id", "left_anti"), "copies")


def remove_repeats(documents: DataFrame, window: int = WINDOW, keep_text: bool = True, carry: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept of every row: the kept words joined by one space, or with ``keep_text=False`` only
    the SHA-256 of that (lowercase hex).  ``carry`` names columns that go along in a struct ``carried``; with ``as_is`` a text
    of which nothing is removed stays as it is."""
    docs = pick(documents, "doc_id", "text", *carry)
    with_carried = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("carried"))
    carried_type = with_carried.schema["carried"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    period, cover = cover_for(window)
    length = window - period + 1
    copies = whole_copies(docs)
    bound = F.broadcast if copies.count() <= BROADCAST_ROWS else (lambda df: df)

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            w = Segments(batch.column(1).to_pylist())
            at, h = anchors(w, period, cover, length)
            text = w.which()[at]
            once = _once(text, h)
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[once].view(np.int64)), pa.array(ids[text[once]])], ["h", "doc_id"])

    rows = docs.where("doc_id is not null").join(bound(copies), "doc_id", "left_anti").mapInArrow(tidy(anchor_rows), "h bigint, doc_id bigint")
    rows = materialize(rows, "anchors")
    shared = rows.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
    shared = materialize(shared, "shared")
    marked = materialize(rows.join(shared, "h").groupBy("doc_id").agg(F.collect_list("h").alias("shared")), "marked")
    discard(rows)
    discard(shared)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            texts, lists = batch.column(1).to_pylist(), batch.column(2)
            w = Segments(texts, second=True)
            m, n = len(texts), len(w.hash)
            at, h = anchors(w, period, cover, length)
            at = at[np.isin(_own_key(h, w.which()[at]), _listed(lists))]
            near = np.zeros(n + 1, np.int64)
            np.add.at(near, np.maximum(at - period + 1, 0), 1)
            np.add.at(near, at + 1, -1)
            start = np.flatnonzero((np.cumsum(near)[: max(0, n - window + 1)] > 0) & inside(w.starts, n, window))
            h1, h2, text = sequence_hash(w.hash, window)[start], sequence_hash(w.hash2, window)[start], w.which()[start]
            once = np.sort(_once(text, h1))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(text[once], h1[once], m), _lists(text[once], h2[once], m)], ["doc_id", "h1", "h2"])

    candidates = _among(docs, marked).join(marked, "doc_id").select("doc_id", "text", "shared")
    judged = materialize(candidates.mapInArrow(tidy(windows), "doc_id bigint, h1 array<bigint>, h2 array<bigint>"), "windows")
    discard(marked)

    each = judged.select("doc_id", F.explode(F.arrays_zip("h1", "h2")).alias("w")).select("doc_id", F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))
    least = each.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    hits = materialize(each.join(least, ["h1", "h2"]).where("doc_id > least").groupBy("doc_id").agg(F.collect_list("h1").alias("hits")), "hits")
    discard(judged)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            texts = batch.column(1).to_pylist()
            w = Segments(texts)
            n = len(w.hash)
            start = np.flatnonzero(inside(w.starts, n, window))
            start = start[np.isin(_own_key(sequence_hash(w.hash, window)[start], w.which()[start]), _listed(batch.column(4)))]
            cover_up = np.zeros(n + 1, np.int64)
            np.add.at(cover_up, start, 1)
            np.add.at(cover_up, start + window, -1)
            gone = np.cumsum(cover_up)[:n] > 0
            gone |= (np.array(batch.column(2).to_pylist(), bool) & (w.n >= window))[w.which()]
            removed = w.per_text(gone)
            kept = [t if as_is and not removed[k] else _kept(w, k, gone) for k, t in enumerate(texts)]
            if not keep_text:
                kept = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.n), pa.array(removed), pa.array(kept, pa.string()), batch.column(3)], ["doc_id", "n_words", "n_removed", "kept", "carried"])

    flagged = with_carried.join(bound(copies.withColumn("copy", F.lit(True))), "doc_id", "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "carried")
    columns = ["doc_id", "text", "copy", "carried", "hits"]
    if hits.count() <= BROADCAST_ROWS:  # only texts that lose a window go through a shuffle
        ids = F.broadcast(hits.select("doc_id"))
        lost = flagged.join(ids, "doc_id", "left_semi").join(hits, "doc_id").select(*columns)
        found = flagged.join(ids, "doc_id", "left_anti").withColumn("hits", F.lit(None).cast("array<bigint>")).select(*columns).union(lost)
    else:
        found = flagged.join(hits, "doc_id", "left").select(*columns)
    done = found.mapInArrow(tidy(finish), f"doc_id bigint, n_words bigint, n_removed bigint, kept string, carried {carried_type}")
    return done if carry else done.drop("carried")


def _kept(w: Segments, k: int, gone: np.ndarray | None) -> str:
    """The k-th text's words that are not gone, joined by one space."""
    a, b = int(w.starts[k]), int(w.starts[k + 1])
    if a == b:
        return ""
    if gone is None or not gone[a:b].any():
        piece = w.bytes[int(w.first[a]) : int(w.end[b - 1])]
        return b" ".join(piece.split()).decode("utf-8", "surrogatepass")
    return b" ".join([w.bytes[int(w.first[i]) : int(w.end[i])] for i in range(a, b) if not gone[i]]).decode("utf-8", "surrogatepass")
