"""Every catalogued query against its SQL, on the small tables; and the parts around the engine."""

import json
import os
import subprocess
import sys
import threading
import time

import duckdb
import pytest

from hornlog import Diagnostic, Engine, catalog
from hornlog.functions.symbols import symbol_id, symbol_id_column
from hornlog.service import Service, ask
from hornlog.sources.facts import read_relation
from hornlog.streaming.incremental import Incremental

SMALL = "/root/testdata/sf0.001"
COPY = ".in .decl E(k: number, v: number) .out .decl R(k: number, v: number) R(k, v) :- E(k, v)."


@pytest.mark.parametrize("name", catalog.ORACLE)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in catalog._TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = db.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    got = catalog.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())


def test_edges_come_from_every_row(spark):
    """Each order and each line is an edge of its relation, at any size of table; nothing is filtered."""
    got = {n: {tuple(r) for r in df.collect()} for n, df in catalog.frames(spark, SMALL, ["Arc", "Deep", "WDeep"]).items()}
    arc, deep = set(), set()
    for r in spark.read.parquet(f"{SMALL}/orders.parquet").collect():
        k = r["o_orderkey"] % 64
        arc.add((2 * (r["o_orderkey"] - k) + r["o_custkey"] % (k + 1), 2 * (r["o_orderkey"] - k) + k + 1))
    for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").collect():
        b = r["l_orderkey"] // 16 * 32
        deep.add((b + (r["l_suppkey"] + 13 * r["l_linenumber"]) % 32, b + r["l_partkey"] % 32, r["l_linenumber"]))
    assert got == {"Arc": arc, "Deep": {d[:2] for d in deep}, "WDeep": deep} and len(arc) == 1500


def test_symbol_ids(spark):
    assert symbol_id("main") == 967781862181635051
    row = spark.sql("SELECT 'main' AS s").select(symbol_id_column(__import__("pyspark").sql.functions.col("s")).alias("i")).first()
    assert row["i"] == symbol_id("main")


def test_no_query_is_empty(spark):
    middle = SMALL.replace("0.001", "0.01")
    for name in ("antijoin_kv", "antijoin_k", "event_users"):
        assert not catalog.QUERIES[name](spark, middle).isEmpty()


def test_frames_of_wrong_types_and_nulls(spark, engine):
    closure = ".in .decl E(x: number, y: number) .out .decl R(x: number, y: number) .out .decl N(x: number) R(x, y) :- E(x, y). R(x, z) :- R(x, y), E(y, z). N(x) :- E(x, _), !R(x, 1)."
    given = spark.createDataFrame([(None, 1), (1, 1), (2, None), (3, 1), (4, 5)], "a int, b int")
    got = engine.query(closure, {"E": given})
    assert sorted(map(tuple, got["R"].collect())) == [(1, 1), (3, 1), (4, 5)]
    assert sorted(map(tuple, got["N"].collect())) == [(2,), (4,)]  # a wildcard matches a NULL, a variable does not
    for kind, cell in (("double", 1.5), ("string", "1"), ("boolean", True), ("decimal(5,1)", __import__("decimal").Decimal(1))):
        with pytest.raises(Diagnostic) as e:
            engine.query(closure, {"E": spark.createDataFrame([(cell, 1)], f"a {kind}, b bigint")})
        assert e.value.kind == "input"
    null = ".code sql\nnone(n: int) -> int = nullif(n, 2)\n.endcode\n.in .decl E(x: number) .out .decl R(x: number) R(y) :- E(x), y = @call(none, x)."
    assert sorted(r[0] for r in engine.query(null, {"E": spark.createDataFrame([(1,), (2,), (3,)], "x bigint")})["R"].collect()) == [1, 3]


def closure(edges, base):
    reached, fresh = set(base), set(base)
    while fresh:
        fresh = {(x, z) for x, y in fresh for a, z in edges if a == y} - reached
        reached |= fresh
    return reached


def test_linear_closures_are_squared(spark, engine, monkeypatch):
    """Chains, cycles and dense graphs, both directions, another base; also where squaring stops and where candidates are looked up."""
    import random

    from hornlog.operators import fixpoint

    rng = random.Random(6)
    graphs = [[(k, k + 1) for k in range(40)], [(k, (k + 1) % 13) for k in range(13)], [(rng.randrange(30), rng.randrange(30)) for _ in range(200)], [(5, 5)], []]
    text = ".in .decl E(x: number, y: number) .decl B(x: number, y: number) .out .decl R(x: number, y: number) .out .decl L(x: number, y: number) R(x, y) :- B(x, y). R(a, c) :- R(a, b), E(b, c). L(x, y) :- B(x, y). L(a, c) :- L(b, c), E(a, b)."
    for squares, spare, large in ((6, 10**6, 10**9), (0, 0, 0)):
        monkeypatch.setattr(fixpoint, "SQUARES", squares)
        monkeypatch.setattr(fixpoint, "SPARE", spare)
        monkeypatch.setattr(fixpoint, "LARGE", large)
        for edges in graphs[:3] if squares else graphs[2:]:
            base = [(100 + k, x) for k, (x, _) in enumerate(edges[:3])] + [(y, 200 + k) for k, (_, y) in enumerate(edges[:3])]
            got = engine.evaluate(text, {"E": edges, "B": base})
            assert got.rows("R") == sorted(closure(edges, base))
            back = {(z, x) for x, z in closure([(b, a) for a, b in edges], [(y, x) for x, y in base])}
            assert got.rows("L") == sorted(back)


def test_facts(engine, tmp_path):
    (tmp_path / "E.facts").write_bytes(b"1,2\r\n\r\n3,-4\n+3,-4\n9223372036854775807,0")
    result = engine.evaluate(COPY, facts=str(tmp_path))
    assert result.rows("R") == [(1, 2), (3, -4), (2**63 - 1, 0)]
    for bad, words in ((b"1,2\n3,abc\n", "line 2"), (b"1,9223372036854775808\n", "line 1"), (b"1\n", "expected 2 values, got 1"), (b"1, 7\n", "not a number"), (b"1,1.5\n", "1.5"), (b"1," + b"x" * 500, "...")):
        (tmp_path / "E.facts").write_bytes(bad)
        with pytest.raises(Diagnostic) as e:
            engine.evaluate(COPY, facts=str(tmp_path))
        assert e.value.kind == "input" and words in e.value.message and len(e.value.message) < 400
    os.remove(tmp_path / "E.facts")
    with pytest.raises(Diagnostic):
        engine.evaluate(COPY, facts=str(tmp_path))


def test_arity_zero_and_symbol_files(spark, tmp_path):
    (tmp_path / "z").write_text("\n")
    assert read_relation(spark, "Z", [], str(tmp_path / "z")).count() == 1
    (tmp_path / "z").write_text("")
    assert read_relation(spark, "Z", [], str(tmp_path / "z")).count() == 0
    (tmp_path / "s").write_text('zebra\n字\n"alpha"\n字\n', encoding="utf-8")
    assert sorted(r[0] for r in read_relation(spark, "S", ["symbol"], str(tmp_path / "s")).collect()) == ['"alpha"', "zebra", "字"]
    (tmp_path / "t").write_text("".join(f"{k % 2051}\t{k % 2051}\r\n" for k in range(4102)))
    assert read_relation(spark, "T", ["number", "number"], str(tmp_path / "t"), "\t").count() == 2051


def test_check_report(engine):
    report = engine.check(
        ".code python\ndef f(x: int) -> int:\n    return x\n.endcode\n.in .decl E(k: number, s: symbol) .printsize .decl R(k: number) .rule H(s, k) :- E(k, s). R(k) :- H(s, k). R(k) :- R(j), E(k, s), j < k."
    )
    assert (report["rules"], report["strata"], report["recursive_strata"], report["functions"]) == (3, 3, 1, ["fn f(int) -> int"])
    h = next(r for r in report["relations"] if r["name"] == "H")
    assert h["derived"] and not h["input"] and not h["output"] and h["columns"] == ["symbol", "number"]


def test_command_line(tmp_path):
    (tmp_path / "p.dl").write_text(COPY.replace("R(k, v) :- E(k, v).", "R(k, v + 1) :- E(k, v)."))
    (tmp_path / "E.facts").write_text("1,2\n3,4\n")
    env = os.environ | {"HORNLOG_DIAGNOSTIC_JSON": "1"}
    command = [sys.executable, "-m", "hornlog", "-p", str(tmp_path / "p.dl"), "-f", str(tmp_path)]
    done = subprocess.run([*command, "-c", str(tmp_path / "out"), "--explain", "--profile-json", str(tmp_path / "prof")], env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0 and done.stdout == "", done.stderr
    out = tmp_path / "out" / "csvs"
    assert sorted((out / "R.csv").read_text().split()) == ["1,3", "3,5"] and (out / "size.txt").read_text() == "R: ((), (), 2)\n"
    assert json.loads((out / "stats.json").read_text())["materialized_rows"] == 2
    assert len((out / "explain.jsonl").read_text().splitlines()) == 2 and json.loads((tmp_path / "prof").read_text())["sizes"] == {"R": 2}
    (tmp_path / "p.dl").write_text(COPY + " R(x, y) :- Q(x, y).")
    done = subprocess.run([*command, "--check"], env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 1 and json.loads(done.stderr.splitlines()[-1])["kind"] == "validation"


def test_service(spark, tmp_path):
    path, service = str(tmp_path / "s"), Service(Engine(spark))
    thread = threading.Thread(target=service.serve, args=(path,), daemon=True)
    thread.start()
    while not os.path.exists(path):
        time.sleep(0.05)
    program = {"text": COPY, "name": "copy"}
    got = ask(path, {"command": "evaluate", "id": 1, "program": program, "inputs": {"rows": {"E": [[1, 2]]}}, "output": {"inline": True}, "options": {"explain_all": True}})
    assert got["ok"] and got["relations"] == {"R": [[1, 2]]} and got["witnesses"][0]["present"] and got["version"] == 3
    bad = ask(path, {"command": "evaluate", "id": 2, "program": {"text": "x"}})
    assert not bad["ok"] and bad["diagnostic"]["kind"] == "parse"
    assert ask(path, {"command": "check", "program": program})["report"]["rules"] == 1
    assert not ask(path, {"command": "cancel", "id": 9})["ok"] and ask(path, {"command": "stats"})["completed"] >= 1
    loop = {"text": ".in .decl S(k: number) .out .decl N(k: number) N(k) :- S(k). N(k + 1) :- N(k)."}
    answer = {}
    worker = threading.Thread(target=lambda: answer.update(ask(path, {"command": "evaluate", "id": "x", "program": loop, "inputs": {"rows": {"S": [[0]]}}})))
    worker.start()
    deadline = time.time() + 60
    while not ask(path, {"command": "cancel", "id": "x"})["ok"] and time.time() < deadline:
        time.sleep(0.1)
    worker.join(60)
    assert answer["diagnostic"]["kind"] == "resource"
    assert ask(path, {"command": "shutdown"})["ok"]
    thread.join(10)
    assert not thread.is_alive()


def test_incremental(spark, engine):
    text = ".in .decl E(x: number, y: number) .out .decl T(x: number, y: number) T(x, y) :- E(x, y). T(x, z) :- T(x, y), T(y, z)."
    inc = Incremental(engine, text)
    assert inc.monotone
    for part in ([(1, 2), (3, 4)], [(2, 3)], [(2, 3), (9, 1)]):
        states = inc.feed({"E": spark.createDataFrame(part, "x bigint, y bigint")})
    whole = engine.evaluate(text, {"E": [(1, 2), (3, 4), (2, 3), (9, 1)]})
    assert sorted(tuple(r) for r in states["T"].collect()) == whole.rows("T")
    counted = Incremental(engine, text + " .out .decl C(n: number) C(count(y)) :- T(_, y).")
    counted.feed({"E": spark.createDataFrame([(1, 2)], "x bigint, y bigint")})
    assert [tuple(r) for r in counted.feed({"E": spark.createDataFrame([(2, 5)], "x bigint, y bigint")})["C"].collect()] == [(2,)]


def test_nothing_imports_the_training_data_operators():
    root = os.path.join(os.path.dirname(__file__), "..", "hornlog")
    for folder, _, names in os.walk(root):
        if "llm" not in os.path.relpath(folder, root).split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert ".llm" not in f.read(), n
