"""Loops over pairs of numbers, run apart for each connected part of their relations.

Where a rule's atoms hang together by shared variables, no row that it derives joins values of
two parts of the graph that all the loop's given rows make.  So the rows of a part go to one task, which
runs all rounds there: nothing is shuffled, written or compared between rounds, and a shuffle carries
each given row only.  Parts of more than NODES values are left to the distributed rounds.

Parts are found by contraction: a task joins what it can of CHUNK rows; where tasks call a value's part by
different names, these names make a graph that is as a rule much smaller, and is labelled in one task, or
while it is large contracted to each name's neighbour of the least hash, which leaves a fraction of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang.ast import NUMBER, Atom, Expr, Program, Rule, Var
from .context import Evaluation

#: Rows that a task labels together; rows, or edges between names, that one task labels.
CHUNK, ONE = 1_000_000, 200_000
#: Values of a part that one task evaluates, at most; pairs of values held at once (or one part's), and bindings made at once.
NODES, CELLS, WAYS = 1024, 8_000_000, 2_000_000
#: Given rows of a task, about.
ROWS = 250_000

#: A rule by numbers: its head's relation and variables, and its atoms' likewise. Heads have the first numbers.
Numbered = tuple[int, tuple[str, str], list[tuple[int, str, str]]]


def numbered(rules: list[Rule], heads: list[str], program: Program) -> tuple[list[Numbered], list[str]] | None:
    """The rules of a loop and the relations they read, heads first; None if it may leave a part or reads more than pairs of numbers."""
    names, out = list(heads), []
    for r in rules:
        args = [a.first if isinstance(a, Expr) and not a.rest else None for a in r.head.args]
        if len(args) != 2 or not all(isinstance(x, Var) for x in args) or not all(isinstance(p, Atom) and not p.negated for p in r.body):
            return None
        atoms, rest = [], r.atoms()
        for a in rest:
            if len(a.args) != 2 or not all(isinstance(x, Var) for x in a.args):
                return None
            if a.relation not in names:
                names.append(a.relation)
            atoms.append((names.index(a.relation), a.args[0].name, a.args[1].name))
        bound = set(rest[0].variables())
        while more := [a for a in rest if set(a.variables()) & bound and not set(a.variables()) <= bound]:
            bound |= {v for a in more for v in a.variables()}
        if not all(set(a.variables()) <= bound for a in rest):
            return None
        out.append((names.index(r.head.relation), (args[0].name, args[1].name), atoms))
    if any(program.types[n] != [NUMBER, NUMBER] for n in names if n in program.types):
        return None
    return out, names


# Parts


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Each node's least node of its part, for edges between nodes 0 to n - 1."""
    p = np.arange(n)
    while len(a):
        a, b = p[a], p[b]
        live = a != b
        a, b = a[live], b[live]
        np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(q := p[p], p):
            p = q
    return p


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(names))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int | None) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(_columns(b))
            n += b.num_rows
        if rows and n >= rows:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _label(rows: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows k, a, b with their part's name r in this chunk; and with k = -1, each value a once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, a, b in _chunks(batches, rows):
            nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = nodes[_roots(codes[: len(a)], codes[len(a) :], len(nodes))]
            yield _batch("kabr", np.full(len(nodes), -1, np.int32), nodes, nodes, root)
            yield _batch("kabr", k.astype(np.int32), a, b, root[codes[: len(a)]])

    return run


def _label_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node u of the edges with its part's name g."""
    for a, b in _chunks(batches, None):
        nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
        yield _batch("ug", nodes, nodes[_roots(codes[: len(a)], codes[len(a) :], len(nodes))])


def _names(run: Evaluation, edges: DataFrame) -> DataFrame | None:
    """For edges u, v between names: each name u and the one name g of its part; None without edges."""
    maps = []
    while (n := edges.count()) > ONE:
        run.check()
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        order = [F.xxhash64(F.lit(len(maps)), F.col(c)) for c in "uv"]
        best = both.groupBy("u").agg(F.min(F.struct(order[1].alias("h"), F.col("v"))).alias("m"))
        maps.append(run.cut(best.select("u", F.least("m", F.struct(order[0].alias("h"), F.col("u").alias("v"))).getField("v").alias("g"))))
        rep = maps[-1]
        edges = edges.join(rep, "u").select(F.col("g").alias("x"), F.col("v").alias("u")).join(rep, "u").select(F.col("x").alias("u"), F.col("g").alias("v"))
        edges = run.cut(edges.where("u <> v").distinct())
    if not n and not maps:
        return None
    found = run.cut(edges.coalesce(1).mapInArrow(_label_all, "u bigint, g bigint"))
    for m in reversed(maps):
        last = found.toDF("g", "last")
        found = run.cut(m.join(last, "g", "left").select("u", F.coalesce("last", "g").alias("g")))
    return found


def tasks(run: Evaluation, rows: int) -> int:
    return max(-(-rows // ROWS), min(run.spark.sparkContext.defaultParallelism, -(-rows // 5_000)), 1)


def parts(run: Evaluation, rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """n rows k, a, b as small, large: k, a, b, g, where g names the part; large holds parts beyond NODES values, if any."""
    many, names, schema = tasks(run, n), None, "k int, a bigint, b bigint, r bigint"
    if n <= ONE:
        tagged = run.cut(rows.coalesce(1).mapInArrow(_label(None), schema))
    else:
        tagged = run.cut(rows.repartitionByRange(many, "a").mapInArrow(_label(CHUNK), schema))
        values = tagged.where("k < 0").select("a", "r")
        torn = run.cut(values.repartition(many, "a").groupBy("a").agg(F.min("r").alias("u"), F.max("r").alias("v")).where("u <> v"))
        edges = values.join(torn.select("a", F.col("u").alias("v")), "a").where("r <> v").select(F.col("r").alias("u"), "v").distinct()
        names = _names(run, run.cut(edges))
    if names is None:
        named = tagged.withColumnRenamed("r", "g")
    else:
        named = tagged.join(names.withColumnRenamed("u", "r"), "r", "left").select("k", "a", "b", F.coalesce("g", "r").alias("g"))
    given = named.where("k >= 0")
    big = run.cut(named.where("k < 0").groupBy("g").count().where(F.col("count") > NODES).select("g"))
    if big.isEmpty():
        return given, None
    return given.join(big, "g", "left_anti").select("k", "a", "b", "g"), given.join(big, "g", "left_semi").select("k", "a", "b", "g")


# Rounds


class _Rounds:
    """The loop over one batch of parts: nodes are numbered part by part, a pair of nodes of a part is a cell."""

    def __init__(self, rules: list[Numbered], heads: int, size: np.ndarray, k: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.rules, self.heads, self.nodes = rules, heads, int(size.sum())
        begin, square = np.cumsum(size) - size, size * size
        part = np.repeat(np.arange(len(size)), size)
        self.first, self.cells = begin[part], int(square.sum())
        self.local = np.arange(self.nodes) - self.first
        self.base = (np.cumsum(square) - square)[part] + self.local * size[part]
        self.row = np.repeat(np.arange(self.nodes, dtype=np.int32), size[part])
        self.given = {int(r): (x[k == r], y[k == r]) for r in np.unique(k)}
        self.sets: dict[int, np.ndarray] = {}
        self.sorted: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def pairs(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.row[cells].astype(np.int64)
        return x, cells - self.base[x] + self.first[x]

    def set_of(self, r: int) -> np.ndarray:
        """Whether each cell is in the relation."""
        if r not in self.sets:
            self.sets[r] = np.zeros(self.cells, bool)
            if r in self.given:
                x, y = self.given[r]
                self.sets[r][self.base[x] + self.local[y]] = True
        return self.sets[r]

    def index(self, r: int, column: int) -> tuple[np.ndarray, np.ndarray]:
        """The other column's nodes in the order of this one's, and where each node's begin."""
        if (r, column) not in self.sorted:
            pair = self.pairs(np.flatnonzero(self.set_of(r)))
            begin = np.concatenate([[0], np.cumsum(np.bincount(pair[column], minlength=self.nodes))])
            self.sorted[r, column] = begin, pair[1 - column][np.argsort(pair[column], kind="stable")]
        return self.sorted[r, column]

    def join(self, bound: dict[str, np.ndarray], atoms: list[tuple[int, str, str]], head: tuple[str, str]) -> Iterator[dict[str, np.ndarray]]:
        """Bindings of the head's variables, some at a time."""
        if not atoms:
            yield bound
            return
        n = next(n for n, (_, u, v) in enumerate(atoms) if u in bound or v in bound)
        (r, u, v), rest = atoms[n], atoms[:n] + atoms[n + 1 :]
        needed = {*head, *[w for _, *vs in rest for w in vs]}
        if u in bound and v in bound:
            there = self.set_of(r)[self.base[bound[u]] + self.local[bound[v]]]
            yield from self.join({w: c[there] for w, c in bound.items() if w in needed}, rest, head)
            return
        begin, other = self.index(r, 0 if u in bound else 1)
        at, new = (bound[u], v) if u in bound else (bound[v], u)
        count = begin[at + 1] - begin[at]
        ends = np.cumsum(count)
        low = 0
        while low < len(at):
            done = ends[low - 1] if low else 0
            high = max(int(np.searchsorted(ends, done + WAYS, "right")), low + 1)
            c = count[low:high]
            which = np.repeat(np.arange(low, high), c)
            place = np.arange(len(which)) - (ends[which] - count[which] - done) + begin[at[which]]
            more = {w: x[which] for w, x in bound.items() if w in needed}
            if new in needed:
                more[new] = other[place]
            yield from self.join(more, rest, head)
            low = high

    def run(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """What the rules add to each head."""
        known = {h: self.set_of(h) for h in range(self.heads)}
        given = {h: known[h].copy() for h in known}
        delta = {h: np.flatnonzero(known[h]) for h in known}
        while any(len(d) for d in delta.values()):
            fresh = {h: np.zeros(self.cells, bool) for h in known}
            for h, (p, q), atoms in self.rules:
                for n, (r, u, v) in enumerate(atoms):
                    if r < self.heads and len(delta[r]):
                        x, y = self.pairs(delta[r])
                        same = x == y if u == v else slice(None)
                        for found in self.join({u: x[same], v: y[same]}, atoms[:n] + atoms[n + 1 :], (p, q)):
                            fresh[h][self.base[found[p]] + self.local[found[q]]] = True
            for h in known:
                fresh[h] &= ~known[h]
                known[h] |= fresh[h]
                delta[h] = np.flatnonzero(fresh[h])
            self.sorted = {i: s for i, s in self.sorted.items() if i[0] >= self.heads}
        for h in known:
            yield h, *self.pairs(np.flatnonzero(known[h] & ~given[h]))


def _evaluate(rules: list[Numbered], heads: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the loop adds, from rows k, a, b, g in the order of g."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held: list[np.ndarray] | None = None
        for new in _chunks(batches, ROWS):
            held = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
            end = int(np.searchsorted(held[3], held[3][-1]))
            if end:
                yield [c[:end] for c in held]
                held = [c[end:] for c in held]
        if held is not None:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, a, b, g in whole(batches):
            n, value, name = len(a), np.concatenate([a, b]), np.concatenate([g, g])
            order = np.lexsort((value, name))
            new = np.diff(name[order], prepend=name[order[0]]) != 0
            first = new | (np.diff(value[order], prepend=value[order[0]]) != 0)
            first[0] = new[0] = True
            code = np.empty(2 * n, np.int64)
            code[order] = np.cumsum(first) - 1
            node, size, named = value[order][first], np.bincount((np.cumsum(new) - 1)[first]), name[order][first]
            ends, square = np.cumsum(size), size * size
            group = (np.cumsum(square) - square) // CELLS
            cuts = np.flatnonzero(np.diff(group, prepend=-1))
            for low, high in zip(cuts, [*cuts[1:], len(size)], strict=True):
                n0, n1 = ends[low] - size[low], ends[high - 1]
                mine = slice(np.searchsorted(g, named[n0], "left"), np.searchsorted(g, named[n1 - 1], "right"))
                for h, x, y in _Rounds(rules, heads, size[low:high], k[mine], code[:n][mine] - n0, code[n:][mine] - n0).run():
                    for i in range(0, len(x), CHUNK):
                        xs, ys = node[n0 + x[i : i + CHUNK]], node[n0 + y[i : i + CHUNK]]
                        yield _batch("kab", np.full(len(xs), h, np.int32), xs, ys)

    return run


def added(run: Evaluation, small: DataFrame, n: int, rules: list[Numbered], heads: int) -> DataFrame:
    """Rows k, a, b that the loop adds to head k within the small parts."""
    dealt = small.repartition(tasks(run, n), "g").sortWithinPartitions("g")
    return run.cut(dealt.mapInArrow(_evaluate(rules, heads), "k int, a bigint, b bigint"))
