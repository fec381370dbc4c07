"""Loops evaluated apart for each connected part: against plain Python, across the bounds of chunks, parts and batches."""

import random

import numpy as np
import pyarrow as pa
import pytest

from hornlog.lang.parser import parse
from hornlog.operators import local

CLOSURE = ".in .decl E(x: number, y: number) .out .decl R(x: number, y: number) R(x, y) :- E(x, y). R(x, z) :- R(x, y), {}(y, z)."
GENERATION = ".in .decl E(x: number, y: number) .out .decl R(x: number, y: number) R(x, y) :- E(a, x), E(a, y), x != y. R(x, y) :- E(a, x), R(a, b), E(b, y)."
MUTUAL = ".in .decl E(x: number, y: number) .out .decl R(x: number, y: number) .out .decl O(x: number, y: number) O(x, y) :- E(x, y). O(x, z) :- R(x, y), E(y, z). R(x, z) :- O(x, y), O(y, z)."


def closed(edges):
    reached = set(edges)
    while more := {(x, z) for x, y in reached for a, z in edges if a == y} - reached:
        reached |= more
    return reached


def generation(edges):
    reached = {(x, y) for a, x in edges for b, y in edges if a == b and x != y}
    while more := {(x, y) for a, b in reached for c, x in edges if c == a for d, y in edges if d == b} - reached:
        reached |= more
    return reached


def mutual(edges):
    odd, even = set(edges), set()
    while True:
        more = odd | {(x, z) for x, y in even for a, z in edges if a == y}, even | {(x, z) for x, y in odd for a, z in odd if a == y}
        if more == (odd, even):
            return odd, even
        odd, even = more


def graph(seed, blocks=12, size=7, spread=1):
    """Blocks of random edges, some of them loops; one chain of 21 nodes; names far apart."""
    rng = random.Random(seed)
    edges = {(100 * k + rng.randrange(size), 100 * k + rng.randrange(size)) for k in range(blocks) for _ in range(size + 3)}
    edges |= {(-5 - k, -6 - k) for k in range(20)}
    return sorted((x * spread, y * spread) for x, y in edges)


def test_rounds_do_not_grow_with_paths(engine):
    """A loop whose parts fit one task takes one distributed round, however long its paths are."""
    edges = [(100 * c + k, 100 * c + k + 1) for c in range(5) for k in range(30)] + [(100 * c + (k + 49 if k else 0), 100 * c + k + 50) for c in range(5) for k in range(30)]
    for text in (CLOSURE.format("R"), CLOSURE.format("E"), GENERATION):
        got = engine.evaluate(text, {"E": edges})
        assert got.rows("R") == sorted(generation(edges) if text is GENERATION else closed(edges))
        assert got.stats["rounds"] == 1


@pytest.mark.parametrize("nodes", [0, 10, 1024])
def test_parts_of_any_size(engine, monkeypatch, nodes):
    """All parts by distributed rounds, all but the large ones in tasks, or all in tasks; chunks cut parts and names are contracted."""
    monkeypatch.setattr(local, "NODES", nodes)
    monkeypatch.setattr(local, "CHUNK", 4)
    monkeypatch.setattr(local, "ONE", 3)
    monkeypatch.setattr(local, "ROWS", 10)
    edges = graph(nodes, spread=1 if nodes else 2**50)
    for text in (CLOSURE.format("R"), CLOSURE.format("E"), GENERATION):
        assert engine.evaluate(text, {"E": edges}).rows("R") == sorted(generation(edges) if text is GENERATION else closed(edges))
    odd, even = mutual(edges)
    got = engine.evaluate(MUTUAL, {"E": edges})
    assert got.rows("O") == sorted(odd) and got.rows("R") == sorted(even)


def test_names_are_joined_by_contraction(spark, engine, monkeypatch):
    """A chain cut into chunks of one edge in no order is one part."""
    from hornlog.operators.context import Evaluation, Limits

    monkeypatch.setattr(local, "CHUNK", 1)
    monkeypatch.setattr(local, "ONE", 2)
    run = Evaluation(spark, engine.prepare(CLOSURE.format("E"))[0], Limits(), 100)
    chain = [(k * 7919 % 101, (k + 1) * 7919 % 101) for k in range(60)] + [(1000, 1001), (1002, 1002)]
    small, large = local.parts(run, spark.createDataFrame([(0, *e) for e in chain], "k int, a bigint, b bigint"), len(chain))
    found = {}
    for r in small.collect():
        found.setdefault(r["g"], set()).add((r["a"], r["b"]))
    assert large is None and sorted(map(len, found.values())) == [1, 1, 60]


def test_batches(monkeypatch):
    """Joins in pieces and batches of a few cells give the same rows."""
    monkeypatch.setattr(local, "WAYS", 3)
    monkeypatch.setattr(local, "CELLS", 60)
    monkeypatch.setattr(local, "ROWS", 9)
    edges = [e for e in graph(3) if e[0] >= 0]
    rows = sorted((x // 100, k, x, y) for k in (0, 1) for x, y in edges)
    g, k, a, b = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    batches = [local._batch("kabg", *[c[i : i + 4] for c in (k, a, b, g)]) for i in range(0, len(g), 4)]
    out = pa.Table.from_batches(list(local._evaluate([(0, ("x", "z"), [(0, "x", "y"), (1, "y", "z")])], 1)(iter(batches)))).to_pydict()
    assert sorted(zip(out["a"], out["b"], strict=True)) == sorted(closed(edges) - set(edges))


def test_what_may_leave_a_part_is_not_apart(engine):
    """Atoms without a shared variable, constants, comparisons, texts and other columns go the usual way."""

    def ask(rules, decl="E(x: number, y: number)"):
        program, strata = engine.prepare(f".in .decl {decl} .out .decl R(x: number, y: number) {rules}")
        loop = next(s for s in strata if s.recursive)
        return local.numbered(loop.rules, ["R"], program)

    base = "R(x, y) :- E(x, y)."
    assert ask(base + " R(x, z) :- R(x, y), E(y, z).") == ([(0, ("x", "z"), [(0, "x", "y"), (1, "y", "z")])], ["R", "E"])
    for rule in ("R(x, z) :- R(x, y), E(z, w).", "R(x, z) :- R(x, 1), E(x, z).", "R(x, z) :- R(x, y), E(y, z), x < z.", "R(x, z + 1) :- R(x, y), E(y, z).", "R(x, z) :- R(x, _), E(x, z).", "R(x, z) :- R(x, y), E(y, z), !E(z, x)."):
        assert ask(f"{base} {rule}") is None, rule
    assert ask("R(x, y) :- E(x, y, _). R(x, z) :- R(x, y), E(y, z, _).", "E(x: number, y: number, w: number)") is None
    assert parse(CLOSURE.format("E"), "p").rules


def test_nulls_of_a_head_that_is_given(spark, engine, monkeypatch):
    text = ".in .decl R(x: number, y: number) .printsize .decl Q(x: number, y: number) R(x, z) :- R(x, y), R(y, z). Q(x, y) :- R(x, y)."
    given = spark.createDataFrame([(None, 1), (1, 2), (2, 3), (3, 4), (3, 4), (9, None)], "x bigint, y bigint")
    want = sorted(closed([(1, 2), (2, 3), (3, 4)]))
    for nodes in (1024, 2):
        monkeypatch.setattr(local, "NODES", nodes)
        assert sorted(map(tuple, engine.query(text, {"R": given})["Q"].collect())) == want
        rows = [tuple(r) for r in engine.query(text, {"R": given})["R"].collect()]
        assert len(rows) == len(want) + 2 and set(rows) == {*want, (None, 1), (9, None)}


def test_witnesses_take_one_evaluation(spark, monkeypatch):
    """The catalogue's query finds the row to explain in the result that explains it, and the closure is written once."""
    from hornlog import Engine, catalog
    from hornlog.operators.context import Evaluation

    seen, cut, interpret = [], Evaluation.cut, Engine._interpret
    monkeypatch.setattr(Engine, "_interpret", lambda *a: seen.append("run") or interpret(*a))
    monkeypatch.setattr(Evaluation, "cut", lambda run, df: seen.append(df.columns) or cut(run, df))
    assert catalog.witnesses(spark, "/root/testdata/sf0.001").count() == 2
    assert seen.count("run") == 1 and seen.count(["k", "a", "b"]) == 1
    assert seen.count(["c0", "c1"]) == 3  # the loop's start, its edges, and the counts


def test_counts_of_a_relation_that_may_repeat(spark, engine):
    text = ".in .decl E(x: number, y: number) .printsize .decl N(x: number, n: number) .printsize .decl M(x: number, n: number) .printsize .decl K(x: number, n: number) D(x, y) :- E(x, y). N(x, count(y)) :- D(x, y). M(x, count(x)) :- D(x, y). K(x, count(y)) :- E(x, y)."
    got = engine.query(text, {"E": spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 2)], "x bigint, y bigint")})
    assert {n: sorted(map(tuple, got[n].collect())) for n in "NMK"} == {"N": [(1, 2), (2, 1)], "M": [(1, 1), (2, 1)], "K": [(1, 2), (2, 1)]}


def test_joins_of_few_keys_are_spread(spark, engine, monkeypatch):
    """Many rows a key: the pairs come from many tasks, each pair once, also where two rows share several keys."""
    from hornlog.operators import fixpoint, rules

    monkeypatch.setattr(fixpoint, "SPARE", 0)
    monkeypatch.setattr(rules, "SIDE", 7)
    monkeypatch.setattr(rules, "PAIRS", 200)
    text = ".in .decl S(a: number, n: number) .printsize .decl R(a: number, b: number) R(a, b) :- S(a, n), S(b, n), a != b."
    rows = [(k, k % 2) for k in range(120)] + [(k, (k + 1) % 2) for k in range(0, 120, 5)] + [(3, 1), (None, 1), (500, None)]
    want = {(a, b) for a, n in rows for b, m in rows if n is not None and n == m and a is not None and b is not None and a != b}
    got = engine.query(text, {"S": spark.createDataFrame(rows, "a bigint, n bigint")})["R"]
    found = got.withColumn("task", __import__("pyspark").sql.functions.spark_partition_id()).collect()
    assert sorted(tuple(r)[:2] for r in found) == sorted(want)
    sizes = {}
    for r in found:
        sizes[r["task"]] = sizes.get(r["task"], 0) + 1
    assert len(sizes) > 8 and max(sizes.values()) < len(want) / 4


def test_large_joins_are_dealt_over_more_tasks(spark, engine, monkeypatch):
    """The number of tasks of a join follows the rows that it makes, not the session's setting alone."""
    from hornlog.operators import fixpoint

    monkeypatch.setattr(fixpoint, "TASK_ROWS", 10)
    monkeypatch.setattr(fixpoint, "SPREAD", 10**9)
    edges = [(k, (3 * k + j) % 60) for k in range(60) for j in (1, 2)] + [(1, 4), (None, 3)]
    pairs = {(x, z) for x, y in edges for a, z in edges if a == y and x is not None}
    for rule, want in (("R(x, z) :- E(x, y), E(y, z), !E(x, z).", pairs - set(edges)), ("R(x, z) :- E(x, y), E(y, z).", pairs)):
        got = engine.query(".in .decl E(x: number, y: number) .printsize .decl R(x: number, z: number) " + rule, {"E": spark.createDataFrame(edges, "x bigint, y bigint")})["R"]
        assert sorted(map(tuple, got.collect())) == sorted(want) and got.rdd.getNumPartitions() > 8
