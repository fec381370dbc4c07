"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) * P(member | class, history) * P(token | unit).
A unit is one member of one class.  The end of a text and the most frequent words
are units of their own, where the last factor is 1; all other words share units by
a hash of their last two bytes and have their smoothed relative frequency within
the unit, with mass left for unknown words.  ``within`` lets the history tell these
words apart too: the known words of a unit are halved by their smoothed frequency
again and again, down to single words, however many there are, and each split is a
softmax of two over hashed features of history and split, which starts from the
frequencies of its halves (``Tree``).  Class and member are softmaxes over
hashed features of the history: the word before, the word before that (skip), both
together (n-gram), and a bias; a member's weights are hashed by feature and class.
There are more weight slots the more distinct words were counted, up to
``MOST_SLOT_BITS``.

Training is distributed and synchronous.  The training texts are dealt by a hash of
the id into ``ROUNDS`` parts; in each round all blocks sum observed and expected
feature counts over one part at the same weights, and one update follows the
gradient, each weight scaled by the mean of its two counts.  The sums are whole
numbers, so neither the blocks nor the partitions change a score.  Word counts are
summed over all training texts, and every block gets back the counts of its own
words only, so neither the vocabulary nor a text is held in one place.  Words are
told apart by 64-bit hashes.

Defined cases: a null text is empty and has only its end; a null id is never
held out; repeated rows are each counted and scored; without training texts
every count is 0 and units are equally likely; words of equal count are taken as
units by their hash; texts may be of any length; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import Segments, bounded, collect_garbage, crc_fold, discard, materialize, mix64, pick, sums, tidy

CLASSES = MEMBERS = 24
UNITS = CLASSES * MEMBERS
#: Unit 0 is the end, 1 to OWN - 1 are frequent words, the rest are shared.
OWN = UNITS // 2
LEAST_SLOT_BITS, MOST_SLOT_BITS, WORDS_A_SLOT = 8, 13, 64
ROUNDS, RATE, DAMPING = 3, 1.5, 16.0
FOLDS, HELD_OUT = 7, 2
#: Text of a block, which is one row, and tokens in one step of numpy, whose arrays then stay in a core's cache.
BLOCK_BYTES, BATCH = 8 << 20, 1 << 13
#: Words are numbered in buckets, one for so many tokens; a bucket's words of one count and unit are one sort.
BUCKET_TOKENS = 1 << 20
#: Slots of the splits for each slot of the classes, and ranks that are packed at once.
SPLIT_SLOTS, SPLIT_LANES, PACKED_ROWS = 8, 16, 1 << 19
#: Probabilities are summed in these fractions.
ONE = 1 << 16
_START = np.uint64(0x5851F42D4C957F2D)
_END_HASH = np.uint64(0x14057B7EF767814F)
_ODDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))

GROUPS = range(ROUNDS + 1)  # the parts, and last what is held out
BLOCKS = "block bigint, h binary, tail binary, c binary, n_train bigint, train_docs bigint, " + ", ".join(
    f"ids{k} array<bigint>, lens{k} binary, tokens{k} binary" for k in GROUPS
)
NUMBERED = "h binary, unit binary, rank binary, " + ", ".join(BLOCKS.split(", ")[6:])
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def group_of(doc_id: int | None) -> int:
    """The part of a text, or ROUNDS if it is held out."""
    return ROUNDS if crc_fold(doc_id, FOLDS) == HELD_OUT else zlib.crc32(f"part {doc_id}".encode()) % ROUNDS


def tail_units(w: Segments, at: np.ndarray) -> np.ndarray:
    """The shared units of the words at these places."""
    end = w.end[at]
    last = w.raw[end - 1].astype(np.uint64)
    before = np.where(end - w.first[at] > 1, w.raw[np.maximum(end - 2, 0)], 0).astype(np.uint64)
    return (OWN + mix64(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(UNITS - OWN)).astype(np.uint16)


def packed(numbers: np.ndarray, width: int = 4) -> bytes:
    """Integers of at most so many bytes, none below 0, as compressed planes of bytes."""
    return pa.compress(np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes(), "zstd", asbytes=True) if len(numbers) else b""


def unpacked(raw: bytes, n: int, width: int = 4) -> np.ndarray:
    if not n:
        return np.empty(0, np.int64)
    planes = np.frombuffer(pa.decompress(raw, width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


class Block:
    """Texts as numbers of the block's own words, by group."""

    def __init__(self):
        self.known = np.empty(0, np.uint64)  # sorted hashes
        self.number, self.tail = np.empty(0, np.int64), np.empty(0, np.uint16)
        self.counts, self.size, self.train_docs = np.zeros(0, np.int64), 0, 0
        self.groups: list[tuple[list, list, list]] = [([], [], []) for _ in GROUPS]

    def add(self, ids: list[int | None], texts: list[str | None]) -> None:
        w = Segments(texts, lower=True)
        self.size += len(w.raw)
        own, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, own)
        new = np.ones(len(own), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != own
        fresh = np.flatnonzero(new)
        merged = np.concatenate([self.known, own[fresh]])
        order = np.argsort(merged, kind="stable")
        self.number = np.concatenate([self.number, len(self.number) + np.arange(len(fresh))])[order]
        self.tail = np.concatenate([self.tail, tail_units(w, first[fresh])])[order]
        self.known = merged[order]
        tokens = self.number[np.searchsorted(self.known, own)][back].astype(np.int32)
        group = np.array([group_of(i) for i in ids], np.int64)
        of_word = np.repeat(group, w.n)
        self.counts = np.concatenate([self.counts, np.zeros(len(self.known) - len(self.counts), np.int64)])
        self.counts += np.bincount(tokens[of_word != ROUNDS], minlength=len(self.counts))
        self.train_docs += int((group != ROUNDS).sum())
        for k, (kept, lens, parts) in enumerate(self.groups):
            docs = np.flatnonzero(group == k)
            kept += [ids[d] for d in docs]
            lens.append(w.n[docs].astype(np.int32))
            parts.append(tokens[of_word == k])

    def row(self, block: int) -> pa.RecordBatch:
        """The block as one row; its words are numbered anew by falling count."""
        by_number = np.argsort(self.number)
        order = np.argsort(-self.counts, kind="stable")
        anew = np.empty(len(order), np.int64)
        anew[order] = np.arange(len(order))
        raw = lambda x: pa.array([x.tobytes()], pa.binary())
        n = int(self.counts.sum()) + self.train_docs
        columns = [pa.array([block]), raw(self.known[by_number][order]), pa.array([packed(self.tail[by_number][order], 2)], pa.binary()), raw(self.counts[order]), pa.array([n]), pa.array([self.train_docs])]
        for ids, lens, parts in self.groups:
            tokens = pa.array([packed(anew[np.concatenate([np.empty(0, np.int32), *parts])])], pa.binary())
            columns += [pa.array([ids], pa.list_(pa.int64())), raw(np.concatenate([np.empty(0, np.int32), *lens])), tokens]
        return pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in BLOCKS.split(", ")])


def _blocks(documents: DataFrame, block_bytes: int) -> DataFrame:
    """One row for each block of texts: its words' hashes, shared units and training counts, and its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, block = TaskContext.get().partitionId() << 32, Block()
        for batch in bounded(batches, most=1 << 20):
            if block.size >= block_bytes:
                yield block.row(name)
                name, block = name + 1, Block()
            block.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if block.size or any(ids for ids, _, _ in block.groups):
            yield block.row(name)

    return materialize(documents.mapInArrow(tidy(run), BLOCKS), "lm-blocks")


def _words(blocks: DataFrame) -> DataFrame:
    """(h, block, number, tail, c): each block's words with their training count in it."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, h, tail, c in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                h, c = np.frombuffer(h, np.int64), np.frombuffer(c, np.int64)
                tail = unpacked(tail, len(h), 2).astype(np.int32)
                for a in range(0, len(h), 65536):
                    b = min(len(h), a + 65536)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[a:b]), pa.array(np.full(b - a, block)), pa.array(np.arange(a, b, dtype=np.int32)), pa.array(tail[a:b]), pa.array(c[a:b])], ["h", "block", "number", "tail", "c"]
                    )

    return blocks.select("block", "h", "tail", "c").mapInArrow(tidy(unpack), "h bigint, block bigint, number int, tail int, c bigint")


def _ranks(totals: DataFrame, own: list[int], n: int) -> tuple[DataFrame, Tree]:
    """The tree, and (h, rank): where the known words of shared units stand in its row; those of one unit and count by bucket and hash."""
    words = totals.where((F.col("c") > 0) & ~F.col("h").isin(own)).select("h", "c", "tail", F.pmod("h", F.lit(1 + n // BUCKET_TOKENS)).alias("bucket"))
    sizes = materialize(words.groupBy("tail", "c", "bucket").agg(F.count("*").alias("m")), "lm-sizes")
    classes = sizes.groupBy("tail", "c").agg(F.sum("m").alias("m")).toArrow()  # a row for each count that occurs in a unit
    tree = Tree(*[classes[k].to_numpy().astype(np.int64) for k in ("tail", "c", "m")])
    earlier = Window.partitionBy("tail", "c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("tail", "c", "bucket", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("tail", "c", "bucket").orderBy("h")) - 1
    places = words.withColumn("number", number).join(before, ["tail", "c", "bucket"])
    held = totals.sparkSession.sparkContext.broadcast(tree)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, tail, c, place = batch.columns
            yield pa.RecordBatch.from_arrays([h, pa.array(held.value.ranks(tail.to_numpy(), c.to_numpy(), place.to_numpy()))], ["h", "rank"])

    return places.select("h", "tail", "c", (F.col("number") + F.col("before")).alias("place")).mapInArrow(tidy(rank), "h bigint, rank bigint"), tree


def _by_block(ranks: DataFrame) -> DataFrame:
    """(block, n, numbers, ranks): the rows (block, number, rank) packed, some of one block in each row."""

    def pack(block: np.ndarray, number: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((number, block))
        block, number, rank = block[order], number[order], rank[order]
        edges = [*np.flatnonzero(np.diff(block, prepend=block[:1] - 1)).tolist(), len(block)]
        rows = [(int(block[a]), b - a, packed(number[a:b]), packed(rank[a:b], 8)) for a, b in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["block", "n", "numbers", "ranks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            kept.append([x.to_numpy() for x in batch.columns])
            size += batch.num_rows
            if size >= PACKED_ROWS:
                yield pack(*map(np.concatenate, zip(*kept)))
                kept, size = [], 0
        if size:
            yield pack(*map(np.concatenate, zip(*kept)))

    return ranks.mapInArrow(tidy(run), "block bigint, n bigint, numbers binary, ranks binary")


class Tree:
    """Splits of each shared unit's known words, by halves of their mass (count and one), down to single words.

    The words stand in one row by unit, falling count and place; only how many there
    are of each unit and count is held, and a split is known by the rank where its
    right half begins.
    """

    def __init__(self, unit: np.ndarray, c: np.ndarray, m: np.ndarray):
        order = np.lexsort((-c, unit))
        unit, self.c, m = unit[order], c[order], m[order]
        self.key = self._key(unit, self.c)
        self.start = np.concatenate([[0], np.cumsum(m)])
        self.mass = np.concatenate([[0], np.cumsum(m * (self.c + 1))])
        self.first = np.searchsorted(unit, np.arange(UNITS + 1))
        self.unit = unit

    @staticmethod
    def _key(unit: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (unit.astype(np.int64) << 44) + ((1 << 44) - 1 - c)

    def ranks(self, unit: np.ndarray, c: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where known words of shared units stand in the row."""
        return self.start[np.searchsorted(self.key, self._key(unit, c))] + place

    def paths(self, rank: np.ndarray, name: Callable[[np.ndarray], np.ndarray] = np.asarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words by rising rank: where each one's splits begin; and per split its rank (by another name), whether the word is right of it, and the log odds of that half."""
        unit = self.unit[np.searchsorted(self.start, rank, "right") - 1]
        first = np.flatnonzero(np.diff(unit, prepend=-1))  # words that one half holds are a run
        end, unit = np.append(first[1:], len(rank)), unit[first]
        lo, hi = self.start[self.first[unit]], self.start[self.first[unit + 1]]
        low, high = self.mass[self.first[unit]], self.mass[self.first[unit + 1]]
        depth, levels = np.zeros(len(rank), np.int64), []
        while True:
            more = np.flatnonzero((hi - lo > 1) & (end > first))
            first, end, lo, hi, low, high = (x[more] for x in (first, end, lo, hi, low, high))
            if not len(first):
                break
            half = (low + high) >> 1
            k = np.searchsorted(self.mass, half, "right") - 1
            start, mass, each = self.start[k], self.mass[k], self.c[k] + 1
            at = np.maximum(start + (half - mass) // each, lo + 1)
            middle = mass + (at - start) * each
            border, n = np.searchsorted(rank, at), end - first
            live = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
            depth[live] += 1
            levels.append((live.astype(np.int32), np.repeat(name(at), n), live >= np.repeat(border, n), np.repeat(np.log((high - middle) / (middle - low)).astype(np.float32), n)))
            first, end, lo, hi, low, high = (np.stack(x, 1).ravel() for x in ((first, border), (border, end), (lo, at), (at, hi), (low, middle), (middle, high)))
        starts = np.concatenate([[0], np.cumsum(depth)])
        split, side, odds = (np.empty(starts[-1], kind) for kind in (name(np.empty(0, np.int64)).dtype, bool, np.float32))
        for level in range(len(levels)):
            live, *found = levels[level]
            levels[level], at = None, starts[live] + level
            for into, values in zip((split, side, odds), found):
                into[at] = values
        return starts, split, side, odds


@dataclass
class Model:
    """Weights of class, member and split, and what the units are."""

    bits: int
    own: np.ndarray  # sorted hashes of the words that are units
    own_unit: np.ndarray
    own_count: np.ndarray
    unit_total: np.ndarray  # log10 of a shared unit's tokens, words and one
    unit_known: np.ndarray  # log10 of a shared unit's tokens and words
    weights: tuple[np.ndarray, ...]
    tree: Tree | None = None

    @classmethod
    def start(cls, vocabulary: int, own: list[tuple[int, int, int]], tails: dict[int, tuple[int, int]], docs: int, tree: Tree | None = None, within: bool = False) -> Model:
        """own: (hash, count, shared unit) of frequent words; tails: (tokens, words) of each shared unit, all words counted."""
        bits = min(MOST_SLOT_BITS, max(LEAST_SLOT_BITS, int(np.ceil(np.log2(max(1, vocabulary / WORDS_A_SLOT))))))
        n, v = np.zeros(UNITS), np.zeros(UNITS)
        for u, (tokens, words) in tails.items():
            n[u], v[u] = tokens, words
        n[0] = docs
        for k, (_, c, tail) in enumerate(own, 1):
            n[k] = c
            n[tail] -= c
            v[tail] -= 1
        hashes = np.array([h for h, _, _ in own], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        # the bias alone gives the smoothed frequencies of classes and of members within them
        by = (n + 1).reshape(MEMBERS, CLASSES)
        weights = tuple(np.zeros(((1 << bits) + CLASSES, lanes), np.float32) for lanes in (CLASSES, MEMBERS))
        weights[0][1 << bits] = np.log(by.sum(axis=0) / by.sum())
        weights[1][1 << bits :] = np.log(by / by.sum(axis=0)).T
        if within:
            weights += (np.zeros(((2 * SPLIT_SLOTS << bits) // SPLIT_LANES, SPLIT_LANES), np.float32),)
        counts = np.array([c for _, c, _ in own], np.int64)
        return cls(bits, hashes[order], np.arange(1, len(own) + 1, dtype=np.uint16)[order], counts[order], np.log10(n + v + 1), np.log10(np.maximum(n + v, 1)), weights, tree)

    def units(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Each word's unit."""
        if not len(self.own):
            return tails
        at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
        return np.where(self.own[at] == hashes, self.own_unit[at], tails)

    def counts(self, hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Each word's count, given its rank, or one below 0 if it is a unit or unknown."""
        c = np.zeros(len(hashes), np.int64)
        c[ranks >= 0] = self.tree.c[np.searchsorted(self.tree.start, ranks[ranks >= 0], "right") - 1]
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
            c = np.where(self.own[at] == hashes, self.own_count[at], c)
        return c

    def update(self, observed: tuple[np.ndarray, ...], expected: tuple[np.ndarray, ...]) -> Model:
        """One step along the gradient (observed less expected), scaled by the mean of both and shared by the three features."""
        steps = [(RATE / 3) * (o - e) / ((o + e) / 2 + DAMPING) for o, e in zip(observed, expected, strict=True)]
        return replace(self, weights=tuple((w + s).astype(np.float32) for w, s in zip(self.weights, steps, strict=True)))

    def of_words(self, log_c: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """log10 of a word within its unit; of the known words' mass alone where their splits follow."""
        inner = np.where(log_c > 0, self.unit_known[unit], 0.0) if len(self.weights) > 2 else log_c
        return np.where(unit >= OWN, inner - self.unit_total[unit], 0.0)


class Sequences:
    """Texts with an end after each: per token its unit and the features of its history."""

    def __init__(self, numbers: np.ndarray, lens: np.ndarray, hashes: np.ndarray, units: np.ndarray):
        n = len(numbers) + len(lens)
        self.starts = np.concatenate([[0], np.cumsum(lens.astype(np.int64) + 1)])
        self.is_word = np.ones(n, bool)
        self.is_word[self.starts[1:] - 1] = False
        h = np.full(n, _END_HASH)
        h[self.is_word] = hashes[numbers]
        self.unit = np.zeros(n, np.int64)
        self.unit[self.is_word] = units[numbers]
        one, two = np.full(n, _START), np.full(n, _START)
        one[1:], two[2:] = h[:-1], h[:-2]
        one[self.starts[:-1]] = _START
        two[self.starts[:-1]] = _START
        after = self.starts[:-1] + 1
        two[after[after < n]] = _START
        with np.errstate(over="ignore"):
            self.features = (one * _ODDS[0], two * _ODDS[1], (one * _ODDS[2] + two) * _ODDS[3])

    def slots(self, a: int, b: int, bits: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        """For the class and for the member: what it is, and the slots of its features, the bias last."""
        cls, member = self.unit[a:b] % CLASSES, self.unit[a:b] // CLASSES
        shift = np.uint64(64 - bits)
        with np.errstate(over="ignore"):
            salt = (cls.astype(np.uint64) + np.uint64(1)) * _ODDS[3]
            of_class = [(f[a:b] >> shift).astype(np.int64) for f in self.features]
            of_member = [((f[a:b] ^ salt) * _ODDS[0] >> shift).astype(np.int64) for f in self.features]
        return [(cls, [*of_class, np.full(b - a, 1 << bits)]), (member, [*of_member, (1 << bits) + cls])]


def exponentials(weights: np.ndarray, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lanes, tokens): each token's logits less their largest, and their powers of e; and the sums of these."""
    z = np.take(weights, slots[0], axis=0)
    more = np.empty_like(z)
    for s in slots[1:]:
        z += np.take(weights, s, axis=0, out=more, mode="clip")  # no slot is out of range
    z = np.ascontiguousarray(z.T)
    z -= z.max(axis=0)
    p = np.exp(z)
    return z, p, p.sum(axis=0)


def probabilities(weights: np.ndarray, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(lanes, tokens): softmax of each token's logits, and those logits less their log sum."""
    z, p, total = exponentials(weights, slots)
    return p / total, z - np.log(total)


def log_probability(weights: np.ndarray, slots: list[np.ndarray], what: np.ndarray) -> np.ndarray:
    """Of each token's own lane, as ``probabilities`` has it."""
    z, _, total = exponentials(weights, slots)
    return z[what, np.arange(len(what))] - np.log(total)


class Paths:
    """The splits of a block's known words of shared units, or of those only that some texts hold."""

    def __init__(self, tree: Tree, ranks: np.ndarray, numbers: np.ndarray | None = None):
        """ranks: by number, below 0 for words without splits; numbers: of the words of the texts."""
        here = np.full(len(ranks), numbers is None)
        if numbers is not None:
            here[numbers] = True
        here = np.flatnonzero(here & (ranks >= 0))
        here = here[np.argsort(ranks[here])]
        self.word = np.full(len(ranks), -1)
        self.word[here] = np.arange(len(here))
        self.starts, self.salt, self.right, self.odds = tree.paths(ranks[here], lambda split: (mix64(split.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32))


class Splits:
    """The splits of all known words of shared units in these texts, a few tokens at a time."""

    def __init__(self, s: Sequences, model: Model, numbers: np.ndarray, paths: Paths):
        """numbers: of the words of the texts."""
        word = paths.word[numbers]
        order = np.flatnonzero(word >= 0)
        order = order[np.argsort(word[order], kind="stable")]  # equal words side by side, as their splits are
        self.tokens, self.word = np.flatnonzero(s.is_word)[order], word[order]
        self.starts, self.salt, self.right, self.odds = paths.starts, paths.salt, paths.right, paths.odds
        self.features = [(f >> np.uint64(32)).astype(np.uint32) for f in s.features]
        table = np.ascontiguousarray(model.weights[2].T).ravel()
        self.pairs = len(table) // 2  # a slot's left weight, and this much later its right one
        self.weights = table[self.pairs :] - table[: self.pairs]

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
        """Some tokens and their numbers of splits; and whether right, slots and log odds of the right half of each split."""
        for a in range(0, len(self.tokens), BATCH // 4):
            tokens, word = self.tokens[a : a + BATCH // 4], self.word[a : a + BATCH // 4]
            n = self.starts[word + 1] - self.starts[word]
            at = np.arange(n.sum()) + np.repeat(self.starts[word] - (np.cumsum(n) - n), n)
            salt, z = self.salt[at], self.odds[at]
            slots = [split_slots(np.repeat(f[tokens], n), salt, self.pairs) for f in self.features]
            for x in slots:
                z += self.weights[x]
            yield tokens, n, self.right[at], slots, z

    def count(self, observed: np.ndarray, expected: np.ndarray) -> None:
        """Add the counts of all features, in ``ONE``ths, to tables of (lanes, slots)."""
        o, e = observed.reshape(2, -1), expected.reshape(2, -1)
        found, above = np.zeros(2 * self.pairs), np.zeros(self.pairs)
        for _, _, right, slots, z in self:
            p = np.rint(np.float32(ONE) / (1 + np.exp(-z))).astype(np.float64)
            side = right * self.pairs
            for x in slots:
                np.add.at(found, x + side, float(ONE))
                np.add.at(above, x, p)
        found = found.reshape(2, -1)
        o += found
        e[1] += above
        e[0] += found[0] + found[1] - above

    def add_scores(self, score: np.ndarray) -> None:
        """Add each word's log10 probability among the known words of its unit."""
        for tokens, n, right, _, z in self:
            z *= np.float32(1) - np.float32(2) * right  # the log odds against
            score[tokens] -= np.bincount(np.repeat(np.arange(len(n)), n), weights=np.log(1 + np.exp(z)), minlength=len(n)) / np.log(10)


def split_slots(features: np.ndarray, salt: np.ndarray, pairs: int) -> np.ndarray:
    """The slots of features at splits, both as 32-bit hashes; there are a power of two."""
    return ((features ^ salt) * np.uint32(0x9E3779B1) >> np.uint32(33 - pairs.bit_length())).astype(np.int64)


def feature_counts(s: Sequences, model: Model, observed: list[np.ndarray], expected: list[np.ndarray]) -> None:
    """Add the counts of all features of these texts, in ``ONE``ths, to tables of (lanes, slots)."""
    for a in range(0, len(s.unit), BATCH):
        b = min(len(s.unit), a + BATCH)
        for t, (what, slots) in enumerate(s.slots(a, b, model.bits)):
            rows, found = len(model.weights[t]), observed[t].reshape(-1)
            _, p, total = exponentials(model.weights[t], slots)
            p /= total
            p *= np.float32(ONE)
            p = np.rint(p, out=p).astype(np.float64)
            for x in slots:
                np.add.at(found, what * rows + x, float(ONE))
            if t == 0:  # the classes' bias is one slot
                expected[t][:, slots.pop()[0]] += p.sum(axis=1)
            for x in slots:
                for k, lane in enumerate(p):  # a lane at a time is several times faster than all at once
                    expected[t][k] += np.bincount(x, weights=lane, minlength=rows)


def _round(blocks: DataFrame, model: Model, part: int) -> Model:
    """Sum the part's feature counts over all blocks at the model's weights, and take one step."""
    held = blocks.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the data
    lanes, tables = max(CLASSES, MEMBERS), len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        observed, expected = ([np.zeros(w.T.shape) for w in model.weights] for _ in range(2))  # whole numbers below 2**53
        for batch in batches:
            for h, unit, rank, lens, tokens in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                h = np.frombuffer(h, np.uint64)
                lens = np.frombuffer(lens, np.int32)
                tokens = unpacked(tokens, int(lens.sum()))
                s = Sequences(tokens, lens, h, unpacked(unit, len(h), 2))
                feature_counts(s, model, observed, expected)
                if tables > 2:
                    Splits(s, model, tokens, Paths(model.tree, unpacked(rank, len(h), 8) - 1, tokens)).count(observed[2], expected[2])
        for t, (o, e) in enumerate(zip(observed, expected, strict=True)):
            at = np.flatnonzero(o.any(axis=0) | e.any(axis=0))
            columns = [pa.array((x[k, at] if k < len(x) else np.zeros(len(at))).astype(np.int64)) for x in (o, e) for k in range(lanes)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(at), *columns], ["t", "slot", *names])

    names = [f"{x}{k}" for x in "oe" for k in range(lanes)]
    rows = blocks.select("h", "unit", "rank", f"lens{part}", f"tokens{part}").mapInArrow(tidy(run), "t int, slot bigint, " + ", ".join(f"{x} bigint" for x in names))
    total = rows.groupBy("t", "slot").agg(*[F.sum(x).alias(x) for x in names]).toArrow()  # a row for each slot at most
    observed, expected = (tuple(np.zeros(w.shape) for w in model.weights) for _ in range(2))
    t, slot = total["t"].to_numpy(), total["slot"].to_numpy()
    for k in range(lanes):
        for x, into in (("o", observed), ("e", expected)):
            values = total[f"{x}{k}"].to_numpy() / ONE
            for table in range(tables):
                if k < into[table].shape[1]:
                    into[table][slot[t == table], k] = values[t == table]
    return model.update(observed, expected)


def _numbered(blocks: DataFrame, ranks: DataFrame, model: Model) -> DataFrame:
    """The blocks with their words' units and ranks (one more, or 0 for words that are units or unknown)."""
    held = blocks.sparkSession.sparkContext.broadcast(model)
    arrow = to_arrow_schema(_parse_datatype_string(NUMBERED))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model, out = held.value, []
        for k in range(left.num_rows):
            row = left.slice(k, 1)
            h = np.frombuffer(row["h"][0].as_py(), np.uint64)
            rank = np.zeros(len(h), np.int64)
            for n, numbers, found in zip(*[right[x].to_pylist() for x in ("n", "numbers", "ranks")], strict=True):
                rank[unpacked(numbers, n)] = unpacked(found, n, 8) + 1
            new = {"unit": packed(model.units(h, unpacked(row["tail"][0].as_py(), len(h), 2)), 2), "rank": packed(rank, 8)}
            out.append(pa.Table.from_arrays([pa.chunked_array([pa.array([new[f.name]], f.type)]) if f.name in new else row[f.name].cast(f.type) for f in arrow], schema=arrow))
        return pa.concat_tables(out) if out else arrow.empty_table()

    left = blocks.drop("c", "n_train", "train_docs").groupBy("block")
    return materialize(left.cogroup(ranks.groupBy("block")).applyInArrow(run, NUMBERED), "lm-numbered")


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """In here a query's shuffle files go as it ends.  Spark's listeners keep the last query's plan, so without this they stay through the next, whatever garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def score_texts(documents: DataFrame, block_bytes: int = BLOCK_BYTES, within: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text; ``within``: by history within shared units too."""
    spark = documents.sparkSession
    with dropping_shuffles(spark):
        blocks = _blocks(pick(documents, "doc_id", "text"), block_bytes)
        words = _words(blocks)
        totals = materialize(words.groupBy("h").agg(F.sum("c").alias("c"), F.min("tail").alias("tail")), "lm-totals")
        sizes = blocks.agg(F.sum("n_train").alias("n"), F.sum("train_docs").alias("d")).first()
        n, docs = sizes["n"] or 0, sizes["d"] or 0
        tails = {r["tail"]: (r["n"], r["v"]) for r in totals.where("c > 0").groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
        v = sum(x for _, x in tails.values()) + (docs > 0)
        own = [(r["h"], r["c"], r["tail"]) for r in totals.where("c > 0").orderBy(F.desc("c"), "h").limit(OWN - 1).collect()]
        places, tree = _ranks(totals, [h for h, _, _ in own], n)
        ranks = materialize(_by_block(words.select("h", "block", "number").join(places, "h").select("block", "number", "rank")), "lm-ranks")
        discard(totals)
        model = Model.start(v, own, tails, docs, tree, within)
        numbered = _numbered(blocks, ranks, model)
        discard(blocks)
        discard(ranks)
        for part in range(ROUNDS):
            model = _round(numbered, model, part)
            collect_garbage(spark)
    held = spark.sparkContext.broadcast(model)
    arrow = to_arrow_schema(_parse_datatype_string(SCORED))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for row in (row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist()):
            h = np.frombuffer(row["h"], np.uint64)
            unit, rank = unpacked(row["unit"], len(h), 2), unpacked(row["rank"], len(h), 8) - 1
            totals, paths = model.counts(h, rank), Paths(model.tree, rank) if within else None
            for k in GROUPS:
                lens = np.frombuffer(row[f"lens{k}"], np.int32)
                tokens = unpacked(row[f"tokens{k}"], int(lens.sum()))
                s = Sequences(tokens, lens, h, unit)
                c = np.full(len(s.unit), docs, np.int64)
                c[s.is_word] = totals[tokens]
                log_c = np.log10(c + 1.0)
                score = model.of_words(log_c, s.unit)
                for a in range(0, len(c), BATCH):
                    b = min(len(c), a + BATCH)
                    for t, (what, slots) in enumerate(s.slots(a, b, model.bits)):
                        score[a:b] += log_probability(model.weights[t], slots, what).astype(np.float64) / np.log(10)
                if within:
                    Splits(s, model, tokens, paths).add_scores(score)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row[f"ids{k}"], pa.int64()), pa.array(np.full(len(lens), k == ROUNDS)), pa.array(lens.astype(np.int64) + 1), pa.array(sums(c > 0, s.starts)),
                        pa.array(sums(log_c - np.log10(n + v + 1.0), s.starts)), pa.array(sums(score, s.starts)),
                    ],
                    schema=arrow,
                )

    out = numbered.mapInArrow(tidy(score), SCORED)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
