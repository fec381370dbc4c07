"""Benchmark decontamination over a distributed positional inverted index.

The training corpus is indexed in shards of whole documents.  A shard is one
row: its documents, and for each term the sorted list of positions at which it
stands.  Only terms whose hash falls in one of 2**20 slots that a benchmark term
has are posted; the larger the benchmark, the more of the corpus is.  A test phrase
is found by taking the positions of its term that is rarest in the corpus, moving
them by the term's offset to where the phrase would start, and intersecting them
with the moved lists of the next rarer terms.  Because shards hold whole documents,
every intersection is local, whatever term or passage is frequent; only what was hit
is shuffled.  The benchmark is searched in blocks, of which a worker and the driver
hold one at a time.  Terms are told apart by 64-bit hashes.

Defined cases: a null or empty text has no words and one result row; each input
row has its own result row, repeated ids included; texts may be of any length (a
long one is a shard of its own); a benchmark row without words matches nothing; a
benchmark row without an id still marks words as hit but is neither counted nor
listed; empty tables give an empty result or hit nothing; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import Segments, bounded, materialize, pick, tidy

#: Bytes that are in no term: all but ASCII letters, digits and what is beyond ASCII.
APART = np.array([not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80) for b in range(256)])
SHARD_WORDS, SHARD_DOCS = 400_000, 20_000
#: Benchmark text that is held at once.
BLOCK_BYTES = 4 << 20
CANDIDATES = 1 << 21
SLOT_BITS = 20

INDEX = "shard bigint, doc_ids array<bigint>, tags array<bigint>, n_words array<bigint>, terms binary, counts binary, positions binary"
HITS = "shard bigint, doc bigint, spans array<bigint>, items array<bigint>"
DIGEST = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
MATCH = "doc_id bigint, item_id bigint, start bigint, length bigint, kind string"


def terms(texts: list[str | None]) -> Segments:
    """Lower-cased words of ASCII letters, digits and all characters beyond ASCII."""
    return Segments(texts, APART, lower=True)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def term_slots(items: DataFrame) -> np.ndarray:
    """Which slots any term of ``items`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << SLOT_BITS, bool)
        for batch in bounded(batches):
            found[_slot(terms(batch.column(1).to_pylist()).hash)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found))], ["slot"])

    out = np.zeros(1 << SLOT_BITS, bool)
    out[items.mapInArrow(tidy(run), "slot bigint").distinct().toArrow()["slot"].to_numpy()] = True  # 2**20 rows at most
    return out


def build_index(documents: DataFrame, slots: np.ndarray, gap: int, tag: str | None = None) -> DataFrame:
    """Postings of the terms in ``slots``, one row per shard; ``gap`` free positions stand between documents."""
    held = documents.sparkSession.sparkContext.broadcast(np.packbits(slots))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        wanted, name = np.unpackbits(held.value).astype(bool), TaskContext.get().partitionId() << 32
        ids, tags, n, hashes, places, at, words = [], [], [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            h, pos = np.concatenate([np.empty(0, np.uint64), *hashes]), np.concatenate([np.empty(0, np.int32), *places])
            order = np.argsort(h, kind="stable")
            present, counts = np.unique(h, return_counts=True)
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, tags, np.concatenate([np.empty(0, np.int64), *n]))]
            raw = [pa.array([x.tobytes()], pa.binary()) for x in (present, counts.astype(np.int32), pos[order])]
            return pa.RecordBatch.from_arrays([pa.array([name]), *lists, *raw], [x.split(" ")[0] for x in INDEX.split(", ")])

        for batch in bounded(batches):
            if words >= SHARD_WORDS or len(ids) >= SHARD_DOCS:
                yield row()
                name, ids, tags, n, hashes, places, at, words = name + 1, [], [], [], [], [], 0, 0
            w = terms(batch.column(1).to_pylist())
            ids += batch.column(0).to_pylist()
            tags += batch.column(2).to_pylist() if tag else [None] * len(w.n)
            n.append(w.n)
            known = np.flatnonzero(wanted[_slot(w.hash)])
            hashes.append(w.hash[known])
            places.append((known + at + gap * w.which()[known]).astype(np.int32))
            at += len(w.hash) + gap * len(w.n)
            words += len(w.hash)
        if ids:
            yield row()

    return materialize(pick(documents, "doc_id", "text", *([tag] if tag else [])).mapInArrow(tidy(shards), INDEX), "postings")


def corpus_counts(index: DataFrame) -> DataFrame:
    """(term, n): how often each posted term stands in the whole corpus."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, np.int64)), pa.array(np.frombuffer(c, np.int32).astype(np.int64))], ["term", "n"])

    return index.select("terms", "counts").mapInArrow(tidy(unpack), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


class Windows:
    """The distinct test windows of some items; ``weigh`` ranks their terms by rising corpus frequency."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int):
        w = terms([t for _, t in items])
        count = np.where(w.n >= size, w.n - size + 1, np.minimum(w.n, 1))
        of = np.repeat(np.arange(len(items)), count)
        start = w.starts[:-1][of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(w.n, size)[of]
        self.terms, vid = np.unique(w.hash, return_inverse=True)
        place = start[:, None] + np.arange(size)
        rows = np.where(np.arange(size) < length[:, None], vid[np.minimum(place, max(0, len(vid) - 1))] if len(vid) else -1, -1).reshape(len(of), size)
        self.vid, back = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.empty(0, np.int64))
        self.lens = (self.vid >= 0).sum(axis=1)
        known = np.array([i is not None for i, _ in items], bool)
        self.items = sorted({i for i, _ in items if i is not None})
        number = {i: k for k, i in enumerate(self.items)}
        item = np.array([number.get(i, -1) for i, _ in items], np.int64)
        pairs = np.unique(np.stack([back.ravel(), item[of]])[:, known[of]], axis=1) if len(of) else np.empty((2, 0), np.int64)
        self.owner_n, self.owner = np.bincount(pairs[0], minlength=len(self.vid)), pairs[1]

    def weigh(self, term: np.ndarray, n: np.ndarray) -> Windows:
        """Keep windows whose terms all stand in the corpus (term, n), and rank their terms."""
        freq = np.zeros(len(self.terms), np.int64)
        at = np.searchsorted(self.terms, term.view(np.uint64))
        ok = at < len(self.terms)
        ok[ok] = self.terms[at[ok]] == term.view(np.uint64)[ok]
        freq[at[ok]] = n[ok]
        cost = np.where(self.vid >= 0, freq[self.vid] if len(freq) else 0, np.iinfo(np.int64).max)
        alive = (cost > 0).all(axis=1)
        self.owner = self.owner[np.repeat(alive, self.owner_n)]
        self.vid, self.lens, self.owner_n, cost = self.vid[alive], self.lens[alive], self.owner_n[alive], cost[alive]
        self.rank = np.argsort(cost, axis=1, kind="stable")
        self.owner_at = np.concatenate([[0], np.cumsum(self.owner_n)]).astype(np.int64)
        return self


class Shard:
    """One index row, ready for intersections."""

    def __init__(self, n_words, names, counts, positions, gap):
        self.n = np.asarray(n_words, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n + gap)])
        self.names, self.counts, self.positions = np.frombuffer(names, np.uint64), np.frombuffer(counts, np.int32), np.frombuffer(positions, np.int32).astype(np.int64)

    def keyed(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the windows' terms as one sorted list of (term, position), and where each term's list starts."""
        of = np.searchsorted(w.terms, self.names)
        of = np.where((of < len(w.terms)) & (w.terms[np.minimum(of, max(0, len(w.terms) - 1))] == self.names), of, -1) if len(w.terms) else np.full(len(self.names), -1)
        each = np.repeat(of, self.counts)
        keep = each >= 0
        keys = (each[keep] << 32) | self.positions[keep]
        first = np.searchsorted(keys, np.arange(len(w.terms) + 1, dtype=np.int64) << 32)
        return keys, first


def _has(keys: np.ndarray, vid: np.ndarray, pos: np.ndarray) -> np.ndarray:
    want = (vid << 32) | np.maximum(pos, 0)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return (keys[at] == want) & (pos >= 0)


def _chunks(n: np.ndarray, most: int) -> Iterator[slice]:
    a = 0
    while a < len(n):
        b = a + max(1, int(np.searchsorted(np.cumsum(n[a:]), most, "right")))
        yield slice(a, b)
        a = b


def _candidates(w: Windows, keys: np.ndarray, first: np.ndarray, sel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rare = w.vid[sel, w.rank[sel, 0]]
    n = first[rare + 1] - first[rare]
    which = np.repeat(sel, n)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return which, keys[np.repeat(first[rare], n) + inside] & 0xFFFFFFFF


def phrases(w: Windows, keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every exact occurrence."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    if len(keys) and len(w.lens):
        rare = w.vid[np.arange(len(w.lens)), w.rank[:, 0]]
        alive = np.flatnonzero(first[rare + 1] > first[rare])
        for part in _chunks((first[rare + 1] - first[rare])[alive], CANDIDATES):
            which, pos = _candidates(w, keys, first, alive[part])
            start = pos - w.rank[which, 0]
            keep = start >= 0
            which, start = which[keep], start[keep]
            for k in range(1, w.vid.shape[1]):
                done = k >= w.lens[which]
                off = w.rank[which, k]
                keep = done | _has(keys, w.vid[which, off], start + off)
                which, start = which[keep], start[keep]
            out.append((which, start))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def near(w: Windows, keys: np.ndarray, first: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every stretch of length + slop words that holds all terms of a window, in any order."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    size = w.vid.shape[1] + slop if len(w.lens) else 0
    if len(keys) and len(w.lens):
        rare = w.vid[np.arange(len(w.lens)), w.rank[:, 0]]
        alive = np.flatnonzero(first[rare + 1] > first[rare])
        for part in _chunks((first[rare + 1] - first[rare])[alive] * size, CANDIDATES):
            which, pos = _candidates(w, keys, first, alive[part])
            span = w.lens[which] + slop
            which, start = np.repeat(which, span), np.repeat(pos, span) - (np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span))
            for k in range(1, w.vid.shape[1]):
                vid = w.vid[which, w.rank[which, k]]
                want = (np.maximum(vid, 0) << 32) | np.maximum(start, 0)
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                keep = (vid < 0) | ((keys[at] >= want) & (keys[at] >> 32 == vid) & ((keys[at] & 0xFFFFFFFF) < start + w.lens[which] + slop))
                which, start = which[keep], start[keep]
            both = np.unique(np.stack([which, np.maximum(start, 0)]), axis=1)
            out.append((both[0], both[1]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _owners(w: Windows, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers into ``which`` and the items that own those windows."""
    n = w.owner_n[which]
    row = np.repeat(np.arange(len(which)), n)
    return row, w.owner[np.repeat(w.owner_at[which], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]


class Search:
    """An index of ``documents`` and the windows of ``benchmark`` to look up in it; ``tag`` names a bigint column to carry along."""

    def __init__(self, documents: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 0, block_bytes: int = BLOCK_BYTES, tag: str | None = None):
        self.spark, self.size, self.gap, self.slop, self.tag = documents.sparkSession, size, size + slop, slop, tag
        self.items = pick(benchmark, "item_id", "text").where(F.col("text").isNotNull())
        self.index = build_index(documents, term_slots(self.items), self.gap, tag)
        self.n_blocks = -(-(self.items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0) // block_bytes)
        self.counts = materialize(corpus_counts(self.index), "term-counts")

    def _windows(self) -> Iterator[Windows]:
        """The benchmark's windows, block by block."""
        for k in range(self.n_blocks):
            part = self.items if self.n_blocks == 1 else self.items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n_blocks)) == k)
            w = Windows([tuple(r) for r in part.collect()], self.size)  # about block_bytes of text
            used = self.spark.createDataFrame(pa.table({"term": w.terms.view(np.int64)}))
            found = self.counts.join(used, "term", "left_semi").toArrow()
            yield w.weigh(found["term"].to_numpy(), found["n"].to_numpy())

    def _each(self, judge, schema: str) -> DataFrame:
        """``judge(shard, row, windows)`` for all shards and blocks; the results of a block are written before the next is looked up."""
        gap, arrow, parts = self.gap, to_arrow_schema(_parse_datatype_string(schema)), []
        for w in self._windows():
            held = self.spark.sparkContext.broadcast(w)

            def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in batch.to_pylist():
                        yield pa.RecordBatch.from_arrays(judge(Shard(row["n_words"], row["terms"], row["counts"], row["positions"], gap), row, held.value), schema=arrow)

            parts.append(materialize(self.index.mapInArrow(tidy(run), schema), "block-hits"))
            held.unpersist()
        return functools.reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], schema)

    def digest(self) -> DataFrame:
        """One row per document: what the benchmark's windows hit in it."""

        def judge(s: Shard, row: dict, w: Windows) -> list[pa.Array]:
            keys, first = s.keyed(w)
            which, start = phrases(w, keys, first)
            diff = np.zeros(int(s.at[-1]) + 1, np.int64)
            np.add.at(diff, start, 1)
            np.add.at(diff, start + w.lens[which], -1)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(diff) > 0, [0]])))
            begin, end = edge[::2], edge[1::2]
            doc = np.searchsorted(s.at, begin, "right") - 1
            r, item = _owners(w, which)
            of = np.searchsorted(s.at, start, "right") - 1
            owned = np.unique(np.stack([of[r], item]), axis=1)
            docs = np.unique(doc)
            spans = [np.stack([begin[doc == d] - s.at[d], end[doc == d] - s.at[d]], axis=1).ravel().tolist() for d in docs]
            return [
                pa.array(np.full(len(docs), row["shard"])), pa.array(docs), pa.array(spans, pa.list_(pa.int64())),
                pa.array([[w.items[k] for k in owned[1][owned[0] == d]] for d in docs], pa.list_(pa.int64())),
            ]

        schema, tagged = DIGEST + ", tag bigint" * (self.tag is not None), self.tag is not None
        arrow = to_arrow_schema(_parse_datatype_string(schema))

        def finish(left: pa.Table, right: pa.Table) -> pa.Table:
            row, hits = left.to_pylist()[0], {}
            for d, spans, items in zip(right["doc"].to_pylist(), right["spans"].to_pylist(), right["items"].to_pylist(), strict=True):
                both = hits.setdefault(d, ([], set()))
                both[0].extend(zip(spans[::2], spans[1::2], strict=True))
                both[1].update(items)
            n_hit, n_items, lists = [], [], []
            for d in range(len(row["doc_ids"])):
                spans, items = hits.get(d, ((), ()))
                covered, upto = 0, 0
                for a, b in sorted(spans):
                    covered += max(0, b - max(a, upto))
                    upto = max(upto, b)
                n_hit.append(covered)
                n_items.append(len(items))
                lists.append(hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest())
            columns = [row["doc_ids"], row["n_words"], n_hit, n_items, lists, [x > 0 for x in n_hit], *([row["tags"]] if tagged else [])]
            return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

        hits = self._each(judge, HITS)
        return self.index.select("shard", "doc_ids", "tags", "n_words").groupBy("shard").cogroup(hits.groupBy("shard")).applyInArrow(finish, schema)

    def matches(self) -> DataFrame:
        """Every (document, item, start, length): exact phrases, or with ``slop`` stretches that hold all terms of a window."""
        slop = self.slop

        def judge(s: Shard, row: dict, w: Windows) -> list[pa.Array]:
            keys, first = s.keyed(w)
            which, start = near(w, keys, first, slop) if slop else phrases(w, keys, first)
            doc = np.searchsorted(s.at, start, "right") - 1
            keep = start - s.at[doc] < s.n[np.minimum(doc, len(s.n) - 1)]  # stretches begin inside a document
            which, start, doc = which[keep], start[keep], doc[keep]
            r, item = _owners(w, which)
            return [
                pa.array([row["doc_ids"][d] for d in doc[r]], pa.int64()), pa.array([w.items[k] for k in item], pa.int64()), pa.array(start[r] - s.at[doc[r]]),
                pa.array(w.lens[which[r]] + slop), pa.array(["proximity" if slop else "phrase"] * len(r), pa.string()),
            ]

        return self._each(judge, MATCH)


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = 10, tag: str | None = None) -> DataFrame:
    return Search(documents, benchmark, size, tag=tag).digest()
