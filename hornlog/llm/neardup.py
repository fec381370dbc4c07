"""Near-duplicate documents by HyperMinHash.

A document is the set of hashes of its word shingles.  Each hash falls in one of
128 buckets by its top bits; of the smallest remainder in a bucket, the register
keeps the count of leading zeros and ten mantissa bits.  Registers (empty ones
filled from the next bucket) are cut into 32 bands of four; documents that agree
on a band are candidates.  A pair of similarity 0.8 is missed by all bands with
a probability below 1e-7.  Sets of fewer than ``FEW`` shingles would leave most
buckets empty: each of their shingles stands for several copies with hashes of
their own, which leaves the similarity as it is.  The number of copies follows
the size in powers of two; a set that may be linked with larger ones of fewer
copies has a row of registers for each number.

Candidates are never all pairs of a bucket.  Copies are settled first, by one
128-bit hash per set.  Then every document of a bucket is compared with the
bucket's smallest id; linked documents are contracted to components; only in
buckets that still hold several components are the documents outside the
largest one compared with the rest, so no link between candidates that could
join two components is left out.  In larger buckets that is done block against
block inside a task, which returns only what may be a link; of links that are
sure, only enough to join the same components.  A pair is estimated
from registers first (agreement corrected for chance collisions) and dropped only
far below the threshold; the others are confirmed on their full sets.

Defined cases: a document of fewer words than a shingle is one shingle of all
its words; without words it is linked with nothing; a null id is never linked
and is kept; rows with one id are one document, with all their texts; extra
columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Segments, bounded, inside, materialize, mix64, pick, sequence_hash, tidy

BUCKETS, ROWS = 128, 4
#: Smaller sets count each shingle several times, so that they have MANY / 2 members or more in all.
FEW, MANY = 128, 1024
EMPTY = 0xFFFF
#: Pairs are dropped if their estimate is so many standard deviations below the threshold; at it, fewer than one in 10**8 is.
CUT = 6.5
_REST, _MANTISSA = 52, 10
#: Buckets up to this size are compared by a join, larger ones block by block.
JOINED, BLOCK = 24, 512
#: Ids of candidates that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

SKETCH = "doc_id bigint, n bigint, k1 bigint, k2 bigint, registers binary, small binary"


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    w = Segments(texts, lower=True)
    h = sequence_hash(w.hash, size)
    out = []
    for a, b in zip(w.starts.tolist(), w.starts[1:].tolist(), strict=False):
        if b - a >= size:
            out.append(np.unique(h[a : b - size + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mix64(sequence_hash(w.hash[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


@functools.cache
def copies(n: int, percent: int) -> tuple[int, ...]:
    """How often each shingle of a set of n counts: by itself first, then beside larger sets that it may be linked with."""
    most = n * 100 // percent
    few = [MANY >> (k - 1) for k in range(n.bit_length(), min(most, FEW - 1).bit_length() + 1)] if n else []
    return (*few, 1) if most >= FEW else tuple(few)


def registers(sets: list[np.ndarray], times: int = 1) -> np.ndarray:
    """One row of BUCKETS registers for each set, whose members count ``times`` times; EMPTY where no hash fell."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(len(sets) * BUCKETS, none)
    salts = np.arange(times, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for a in range(0, len(sets), 128):  # pieces of a few MB
        some = sets[a : a + 128]
        h = np.concatenate(some)
        row = np.repeat(np.arange(a, a + len(some)) * BUCKETS, [len(s) * times for s in some])
        if times > 1:
            with np.errstate(over="ignore"):
                h = mix64((h[:, None] + salts).ravel())
        np.minimum.at(best, row + (h >> np.uint64(57)).astype(np.int64), h)
    rest = ((best >> np.uint64(5)) & np.uint64((1 << _REST) - 1)).astype(np.int64)
    zeros = _REST - np.frexp(rest.astype(np.float64))[1]
    mantissa = ((rest << zeros) >> (_REST - 1 - _MANTISSA)) & ((1 << _MANTISSA) - 1)
    out = np.where(best == none, EMPTY, zeros << _MANTISSA | mantissa)
    return out.astype(np.uint16).reshape(len(sets), BUCKETS)


def sketches_of(sets: list[np.ndarray], percent: int) -> list[bytes | None]:
    """The rows of registers of each set, one for each of its ``copies``; an empty set has none."""
    wanted = [copies(len(s) if len(s) < FEW else FEW, percent) for s in sets]
    rows = [[] for _ in sets]
    for times in sorted({t for x in wanted for t in x}, reverse=True):
        at = [k for k, x in enumerate(wanted) if times in x]
        for k, row in zip(at, registers([sets[k] for k in at], times), strict=True):
            rows[k].append(row.tobytes())
    return [b"".join(x) or None for x in rows]


def row_beside(raw: bytes, n: int, other: int, percent: int) -> bytes:
    """The row of registers of a set of n that compares with a set of ``other`` that it may be linked with."""
    times = copies(min(max(n, other), FEW), percent)[0]
    k = copies(min(n, FEW), percent).index(times)
    return raw[k * 2 * BUCKETS : (k + 1) * 2 * BUCKETS]


def keys_of(raw: list[bytes], n: list[int], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, the numbers of the sets that have them); rows of different ``copies`` share no key."""
    times = [copies(min(x, FEW), percent) for x in n]
    bands = band_keys(np.frombuffer(b"".join(raw), np.uint16).reshape(-1, BUCKETS))
    salt = mix64(np.array([t for x in times for t in x], np.uint64))
    who = np.repeat(np.arange(len(raw)), [len(x) for x in times])
    return mix64(bands ^ salt[:, None]).ravel(), np.repeat(who, bands.shape[1])


def band_keys(r: np.ndarray) -> np.ndarray:
    """Keys of the bands, after empty registers took the value of the next full one."""
    full = r != EMPTY
    twice = np.concatenate([full, full], axis=1)
    at = np.where(twice, np.arange(2 * BUCKETS), 4 * BUCKETS)
    nearest = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :BUCKETS] % BUCKETS
    filled = np.take_along_axis(r, nearest, axis=1)
    bands = np.ascontiguousarray(filled).view(np.uint64)
    with np.errstate(over="ignore"):
        return mix64(mix64(bands) + np.arange(1, bands.shape[1] + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimates, buckets they rest on) of pairs of register rows, corrected for registers that agree by chance."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    edge = 2.0 ** -np.arange(_REST + 1)  # remainders of z zeros or more are below edge[z] of the range

    def level(n: np.ndarray) -> np.ndarray:
        over = (1 - edge[None, :]) ** (n[:, None] / BUCKETS)  # chance that none is below
        return over[:, 1:] - over[:, :-1]

    chance = (level(na) * level(nb)).sum(axis=1) / (1 << _MANTISSA)
    return (same / np.maximum(used, 1) - chance) / (1 - chance), used


def sketch(documents: DataFrame, size: int, percent: int) -> DataFrame:
    longest_small = FEW * 100 // percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), size)
            n = np.array([len(s) for s in sets], np.int64)
            h = np.concatenate([np.empty(0, np.uint64), *sets])
            ends = np.concatenate([[0], np.cumsum(n)])
            keys = []
            for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h ^ np.uint64(salt)))])
                keys.append(pa.array((total[ends[1:]] - total[ends[:-1]]).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n), *keys,
                    pa.array(sketches_of(sets, percent), pa.binary()),
                    pa.array([sets[k].tobytes() if 0 < n[k] <= longest_small else None for k in range(len(n))], pa.binary()),
                ],
                ["doc_id", "n", "k1", "k2", "registers", "small"],
            )

    return materialize(documents.mapInArrow(tidy(run), SKETCH), "sketches")


def candidate_keys(reps: DataFrame, percent: int) -> DataFrame:
    """(key, doc_id, n): documents that agree on a band share a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                ids, n = (np.array(batch.column(k).slice(a, 1000).to_pylist(), np.int64) for k in (0, 1))
                keys, at = keys_of(batch.column(2).slice(a, 1000).to_pylist(), n.tolist(), percent)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[at]), pa.array(n[at])], ["key", "doc_id", "n"])

    return reps.select("doc_id", "n", "registers").mapInArrow(tidy(run), "key bigint, doc_id bigint, n bigint")


class Matcher:
    """Confirms candidate pairs (a, b) of documents."""

    def __init__(self, documents: DataFrame, sketches: DataFrame, size: int, percent: int):
        self.documents, self.sketches, self.size, self.percent = documents, sketches, size, percent

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose registers do not put them far below the threshold."""
        percent = self.percent
        known = self.sketches.where("n > 0").select("doc_id", "n", "registers")
        left = known.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
        right = known.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, na, nb, ra, rb = (batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("a", "b", "na", "nb", "ra", "rb"))
                x = [row_beside(r, n, o, percent) for r, n, o in zip(ra, na, nb, strict=True)]
                y = [row_beside(r, n, o, percent) for r, n, o in zip(rb, nb, na, strict=True)]
                x, y = (np.frombuffer(b"".join(r), np.uint16).reshape(-1, BUCKETS) for r in (x, y))
                times = np.array([copies(min(max(n, o), FEW), percent)[0] for n, o in zip(na, nb, strict=True)], np.float64)
                j, used = estimate(x, y, np.array(na) * times, np.array(nb) * times)
                t = percent / 100
                keep = pa.array(j >= t - CUT * np.sqrt(t * (1 - t) / np.maximum(used, 1)), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(keep), pa.array(b, pa.int64()).filter(keep)], ["a", "b"])

        joined = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        return joined.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(tidy(run), "a bigint, b bigint").distinct()

    def links(self, pairs: DataFrame, tag: str) -> DataFrame:
        """Pairs whose full sets reach the threshold."""
        size, percent = self.size, self.percent
        pairs = materialize(self.likely(pairs), f"{tag}-likely")
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        bound = F.broadcast if pairs.count() * 2 <= BROADCAST_ROWS else (lambda df: df)

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in bounded(batches):
                found = shingle_sets(batch.column(1).to_pylist(), size)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in found], pa.binary())], ["doc_id", "s"])

        whole = materialize(self.documents.join(bound(ids), "doc_id", "left_semi").mapInArrow(tidy(sets), "doc_id bigint, s binary"), f"{tag}-sets")

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = np.concatenate([s, t])
                    both.sort(kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    keep.append(bool(len(s) and len(t)) and 100 * shared >= percent * (len(s) + len(t) - shared))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

        joined = pairs.join(whole.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(whole.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
        return materialize(joined.select("a", "b", "sa", "sb").mapInArrow(tidy(confirm), "a bigint, b bigint").distinct(), f"{tag}-links")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component) of every document in an edge: the smallest id reachable.

    Each round takes every node to the root of the tree of smallest neighbours (by pointer doubling), then contracts
    the edges; the roots that remain at least halve."""
    labels, e, k = None, edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), 0
    e = materialize(e, "cc-edges")
    while not e.isEmpty():
        up = e.select(F.col("b").alias("v"), F.col("a").alias("p")).union(e.select(F.col("a").alias("v"), F.col("a").alias("p"))).groupBy("v").agg(F.min("p").alias("p"))
        up = materialize(up, f"cc-up{k}")
        while True:
            above = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            moved = up.join(above, "p").where("p <> q").limit(1).isEmpty()
            if moved:
                break
            up = materialize(up.join(above, "p").select("v", F.col("q").alias("p")), f"cc-up{k}")
        if labels is None:
            labels = up.select(F.col("v").alias("doc_id"), F.col("p").alias("component"))
        else:
            to = up.select(F.col("v").alias("component"), "p")
            labels = materialize(labels.join(to, "component", "left").select("doc_id", F.coalesce("p", "component").alias("component")), "cc-labels")
        a, b = up.select(F.col("v").alias("a"), F.col("p").alias("x")), up.select(F.col("v").alias("b"), F.col("p").alias("y"))
        e = e.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        e = materialize(e, "cc-edges")
        k += 1
    if labels is None:
        return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("component")).where(F.lit(False))
    return labels


def _across(shared: DataFrame, labels: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of buckets that hold several components: what is outside the largest one with the rest."""
    placed = shared.select("key", "doc_id", "n").join(labels, "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("c"))
    placed = materialize(placed, "placed")
    parts = placed.groupBy("key", "c").count().groupBy("key").agg(F.max(F.struct("count", "c")).alias("m"), F.count("*").alias("parts"), F.sum("count").alias("size")).where("parts > 1")
    parts = parts.select("key", F.col("m.c").alias("main"), "size", (F.col("size") - F.col("m.count")).alias("out"))
    mixed = materialize(placed.join(parts, "key"), "mixed")
    wanted = (F.col("c") != F.col("cx")) & ((F.col("c") == F.col("main")) | (F.col("doc_id") > F.col("x")))
    wanted = wanted & (F.least("n", "nx") * 100 >= F.greatest("n", "nx") * percent)

    few = mixed.where(F.col("size") <= JOINED)
    outside = few.where("c <> main").select("key", F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"))
    by_join = few.join(outside, "key").where(wanted).select(F.least("doc_id", "x").alias("a"), F.greatest("doc_id", "x").alias("b")).distinct()

    # larger buckets: (block of outsiders, block of members) pairs, each one group
    many = mixed.where(F.col("size") > JOINED)
    blocks, out_blocks = F.ceil(F.col("size") / BLOCK), F.ceil(F.col("out") / BLOCK)
    mine = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    mine_out = F.pmod(F.xxhash64("doc_id"), out_blocks).cast("int")
    columns = ["key", "i", "j", "doc_id", "c", "main", "n", "outside"]
    out_rows = many.where("c <> main").select(
        "*", mine_out.alias("i"), F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)).alias("j"), F.lit(True).alias("outside")
    )
    member_rows = many.select("*", F.explode(F.sequence(F.lit(0), out_blocks.cast("int") - 1)).alias("i"), mine.alias("j"), F.lit(False).alias("outside"))
    rows = out_rows.select(*columns).union(member_rows.select(*columns))
    sketched = rows.join(reps.dropDuplicates(["doc_id", "n"]).select("doc_id", "n", "registers", "small"), ["doc_id", "n"])

    def compare(table: pa.Table) -> pa.Table:
        a, b = block_links(table, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    by_block = sketched.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()
    return by_join.union(by_block).distinct()


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The places of edges (a, b) between nodes 0, 1, ... that are enough to join what all of them join: fewer than the nodes."""
    label, chosen, at = np.arange(int(max(a.max(), b.max())) + 1 if len(a) else 0), [np.empty(0, np.int64)], np.arange(len(a))
    while True:
        at = at[label[a[at]] != label[b[at]]]
        if not len(at):
            return np.concatenate(chosen)
        x, y = label[a[at]], label[b[at]]
        high, first = np.unique(np.maximum(x, y), return_index=True)  # each root hooks to a smaller one, so no circle closes
        chosen.append(at[first])
        up = np.arange(len(label))
        up[high] = np.minimum(x, y)[first]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def block_links(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an outsider and a member of one block pair that may be linked, by their estimate; of pairs of small sets,
    whose links are known here, only as many as join the same components."""
    outside, ids, c, n = (table[x].to_numpy(zero_copy_only=False) for x in ("outside", "doc_id", "c", "n"))
    main = table["main"][0].as_py()
    xs, ms = np.flatnonzero(outside), np.flatnonzero(~outside)
    if not len(xs) or not len(ms):
        return ids[:0], ids[:0]
    small, raw = table["small"].to_pylist(), table["registers"].to_pylist()
    is_small = np.array([s is not None for s in small])
    nx, nm = n[xs][:, None], n[ms][None, :]
    ok = (c[xs][:, None] != c[ms][None, :]) & ((c[ms] == main)[None, :] | (ids[ms][None, :] > ids[xs][:, None]))
    ok &= np.minimum(nx, nm) * 100 >= np.maximum(nx, nm) * percent
    both = is_small[xs][:, None] & is_small[ms][None, :]
    hit, linked = np.zeros_like(ok), np.zeros_like(ok)
    if (ok & both).any():
        sets = [np.frombuffer(small[k], np.uint64) if small[k] is not None else np.empty(0, np.uint64) for k in range(len(ids))]
        flat = np.concatenate(sets)
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        often = count > 1
        place = np.cumsum(often) - 1
        row = np.repeat(np.arange(len(ids)), [len(s) for s in sets])
        keep = often[column]
        flags = np.zeros((len(ids), int(often.sum())), np.float32)
        flags[row[keep], place[column[keep]]] = 1
        shared = np.rint(flags[xs] @ flags[ms].T).astype(np.int64)
        linked = ok & both & (100 * shared >= percent * (nx + nm - shared))
    if (ok & ~both).any():
        r = np.stack([np.frombuffer(x[-2 * BUCKETS :], np.uint16) for x in raw])  # both sets of such a pair have FEW shingles or more
        key = np.int64(table["key"][0].as_py()).view(np.uint64)
        bands = keys_of([x.tobytes() for x in r], [FEW] * len(r), percent)[0].reshape(len(r), -1)
        here = (bands == key).any(axis=1)
        for k, x in enumerate(xs):
            at = np.flatnonzero(ok[k] & ~both[k])
            if len(at):
                j, used = estimate(np.broadcast_to(r[x], (len(at), BUCKETS)), r[ms[at]], np.full(len(at), float(n[x])), n[ms[at]].astype(float))
                t = percent / 100
                first = bands[x, (bands[ms[at]] == bands[x]).argmax(axis=1)]
                mine = (first == key) | ~here[x] | ~here[ms[at]]  # other buckets of a pair leave it to its first one
                hit[k, at] = mine & (j >= t - CUT * np.sqrt(t * (1 - t) / np.maximum(used, 1)))
    i, j = np.nonzero(linked)
    enough = forest(*np.unique(np.concatenate([c[xs[i]], c[ms[j]]]), return_inverse=True)[1].reshape(2, -1))
    i, j = (np.concatenate([x[enough], y]) for x, y in zip((i, j), np.nonzero(hit), strict=True))
    a, b = ids[xs[i]], ids[ms[j]]
    return np.minimum(a, b), np.maximum(a, b)


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; links are shingle sets of Jaccard ``percent`` / 100 or more."""
    docs = pick(documents, "doc_id", "text")
    sketches = sketch(docs, size, percent)
    filled = sketches.where("n > 0 and doc_id is not null")
    classes = materialize(filled.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = filled.join(classes, ["k1", "k2", "n"]).where("doc_id = rep").dropDuplicates(["doc_id", "k1", "k2"])
    reps = materialize(reps.select("doc_id", "n", "registers", "small"), "representatives")

    keys = materialize(candidate_keys(reps, percent), "keys")
    groups = keys.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last")
    shared = keys.join(groups.select("key", F.col("first.doc_id").alias("leader"), F.col("first.n").alias("leader_n")), "key")
    shared = materialize(shared, "buckets")

    def comparable(x: str, y: str):
        return F.least(x, y) * 100 >= F.greatest(x, y) * percent

    matcher = Matcher(docs, reps, size, percent)
    stars = shared.where("doc_id <> leader").where(comparable("n", "leader_n")).select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = materialize(stars, "stars")
    several = filled.groupBy("doc_id").agg(F.count_distinct("k1", "k2").alias("c")).where("c > 1")
    own = filled.join(several, "doc_id", "left_semi").join(classes, ["k1", "k2", "n"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = materialize(matcher.links(stars, "star").union(own), "links")
    labels = components(links)

    rest = materialize(_across(shared, labels, reps, percent).join(stars, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = matcher.links(rest, "rest")
        if not more.isEmpty():
            labels = components(links.union(more))

    found = sketches.select("doc_id", "n", "k1", "k2").join(classes, ["k1", "k2", "n"], "left").join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
