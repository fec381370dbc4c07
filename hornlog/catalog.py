"""Queries over the star-schema tables, one or more for each operator, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.symbols import symbol_id_column

#: Input relations: declaration and the SQL (of Spark and DuckDB alike) that makes them from the tables.
RELATIONS = {
    "Region": ("r: number, name: symbol", "SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS r, r_name AS name FROM region"),
    "Nation": ("n: number, name: symbol, r: number", "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS n, n_name AS name, CAST(n_regionkey AS BIGINT) AS r FROM nation"),
    "Cust": ("c: number, n: number, seg: symbol", "SELECT DISTINCT CAST(c_custkey AS BIGINT) AS c, CAST(c_nationkey AS BIGINT) AS n, c_mktsegment AS seg FROM customer"),
    "Supp": ("s: number, n: number", "SELECT DISTINCT CAST(s_suppkey AS BIGINT) AS s, CAST(s_nationkey AS BIGINT) AS n FROM supplier"),
    "Part": ("p: number, brand: symbol, size: number", "SELECT DISTINCT CAST(p_partkey AS BIGINT) AS p, p_brand AS brand, CAST(p_size AS BIGINT) AS size FROM part"),
    "Ord": ("o: number, c: number, status: symbol", "SELECT DISTINCT CAST(o_orderkey AS BIGINT) AS o, CAST(o_custkey AS BIGINT) AS c, o_orderstatus AS status FROM orders"),
    "Li": (
        "o: number, p: number, s: number, q: number",
        "SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS o, CAST(l_partkey AS BIGINT) AS p, CAST(l_suppkey AS BIGINT) AS s, CAST(l_quantity AS BIGINT) AS q FROM lineitem",
    ),
    "Ev": ("e: number, u: number, type: symbol", "SELECT DISTINCT CAST(event_id AS BIGINT) AS e, CAST(user_id AS BIGINT) AS u, event_type AS type FROM events"),
    # every order is one edge, to a lower node of its 64 orders' tree: closures grow with the table, not with its square
    "Arc": (
        "x: number, y: number",
        "SELECT DISTINCT CAST(2 * (o_orderkey - o_orderkey % 64) + o_custkey % (o_orderkey % 64 + 1) AS BIGINT) AS x, "
        "CAST(2 * (o_orderkey - o_orderkey % 64) + o_orderkey % 64 + 1 AS BIGINT) AS y FROM orders",
    ),
    # every line is one edge among the 32 nodes of its 16 orders, about two edges a node, with cycles
    "Deep": (
        "x: number, y: number",
        "SELECT DISTINCT CAST(2 * (l_orderkey - l_orderkey % 16) + (l_suppkey + 13 * l_linenumber) % 32 AS BIGINT) AS x, "
        "CAST(2 * (l_orderkey - l_orderkey % 16) + l_partkey % 32 AS BIGINT) AS y FROM lineitem",
    ),
    "WDeep": (
        "x: number, y: number, w: number",
        "SELECT DISTINCT CAST(2 * (l_orderkey - l_orderkey % 16) + (l_suppkey + 13 * l_linenumber) % 32 AS BIGINT) AS x, "
        "CAST(2 * (l_orderkey - l_orderkey % 16) + l_partkey % 32 AS BIGINT) AS y, CAST(l_linenumber AS BIGINT) AS w FROM lineitem",
    ),
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_PYTHON = """.code python
def capped(q: int, most: int) -> int:
    return min(q, most)


def even(k: int) -> bool:
    return k % 2 == 0


def tagged(name: str) -> str:
    return name + "_x"
.endcode
"""
_SQL = ".code sql\nspread(n: int, r: int) -> int = abs(n - r * 5)\nfar(d: int) -> bool = d >= 4\nlowered(s: str) -> str = lower(s)\n.endcode\n"
_TC = "WITH RECURSIVE t AS (SELECT x, y FROM {e} UNION SELECT t.x, e.y FROM t JOIN {e} e ON t.y = e.x)"

#: key: (blocks, inputs, declaration of R, rules, SQL over q_<Input>)
PROGRAMS: dict[str, tuple[str, str, str, str, str]] = {
    "project": ("", "Li", "o: number, p: number", "R(o, p) :- Li(o, p, _, _).", "SELECT DISTINCT o, p FROM q_Li"),
    "const_match": ("", "Cust", "k: number", "R(k) :- Cust(k, 7, _).", "SELECT DISTINCT c AS k FROM q_Cust WHERE n = 7"),
    "symbol_literal": ("", "Cust", "k: number", 'R(k) :- Cust(k, _, "BUILDING").', "SELECT DISTINCT c AS k FROM q_Cust WHERE seg = 'BUILDING'"),
    "repeated_var": ("", "Deep", "x: number", "R(x) :- Deep(x, x).", "SELECT DISTINCT x FROM q_Deep WHERE x = y"),
    "compare_arith": ("", "Li", "k: number, v: number", "R(k, q * 2 + 1) :- Li(k, _, _, q), q * 3 > k + 1.", "SELECT DISTINCT o AS k, q * 2 + 1 AS v FROM q_Li WHERE q * 3 > o + 1"),
    "no_precedence": ("", "Li", "v: number, w: number", "R(s + q * 2, p - s % 7) :- Li(_, p, s, q), q > 45.", "SELECT DISTINCT (s + q) * 2 AS v, (p - s) % 7 AS w FROM q_Li WHERE q > 45"),
    "division": ("", "Li", "v: number", "R(p - 900 / s) :- Li(_, p, s, _), s != 0.", "SELECT DISTINCT (p - 900) // s AS v FROM q_Li WHERE s <> 0"),
    "head_constant": ("", "Nation", "n: number, k: number, t: symbol", 'R(n, 7, "t") :- Nation(n, _, _).', "SELECT DISTINCT n, CAST(7 AS BIGINT) AS k, 't' AS t FROM q_Nation"),
    "join_kv": ("", "Cust Nation", "c: number, nn: symbol", "R(c, nn) :- Cust(c, n, _), Nation(n, nn, _).", "SELECT DISTINCT c, name AS nn FROM q_Cust JOIN q_Nation USING (n)"),
    "join3": (
        "", "Cust Nation Region", "c: number, rn: symbol", "R(c, rn) :- Cust(c, n, _), Nation(n, _, r), Region(r, rn). .plan",
        "SELECT DISTINCT c, g.name AS rn FROM q_Cust JOIN q_Nation USING (n) JOIN q_Region g USING (r)",
    ),
    "join4_sip": (
        "", "Li Ord Cust Nation", "o: number, name: symbol", "R(o, name) :- Li(o, _, _, 50), Ord(o, c, _), Cust(c, n, _), Nation(n, name, _). .optimize",
        "SELECT DISTINCT o, name FROM q_Li JOIN q_Ord USING (o) JOIN q_Cust USING (c) JOIN q_Nation USING (n) WHERE q = 50",
    ),
    "self_join": ("", "Supp", "a: number, b: number", "R(a, b) :- Supp(a, n), Supp(b, n), a != b.", "SELECT DISTINCT a.s AS a, b.s AS b FROM q_Supp a JOIN q_Supp b USING (n) WHERE a.s <> b.s"),
    "semijoin": ("", "Cust Ord", "k: number, n: number", "R(k, n) :- Cust(k, n, _), Ord(_, k, _).", "SELECT DISTINCT c AS k, n FROM q_Cust WHERE c IN (SELECT c FROM q_Ord)"),
    "key_intersect": ("", "Cust Ord", "k: number", "R(k) :- Cust(k, _, _), Ord(k, _, _).", "SELECT c AS k FROM q_Cust INTERSECT SELECT o FROM q_Ord"),
    "cross": ("", "Region Nation", "r: number, n: number", "R(r, n) :- Region(r, _), Nation(n, _, _).", "SELECT DISTINCT g.r, n FROM q_Region g, q_Nation"),
    "theta_join": ("", "Nation", "a: number, b: number", "R(a, b) :- Nation(a, _, r), Nation(b, _, r), a < b.", "SELECT DISTINCT a.n AS a, b.n AS b FROM q_Nation a JOIN q_Nation b USING (r) WHERE a.n < b.n"),
    "antijoin_kv": ("", "Cust Supp", "k: number, n: number", "R(k, n) :- Cust(k, n, _), !Supp(k, n).", "SELECT DISTINCT c AS k, n FROM q_Cust WHERE NOT EXISTS (SELECT 1 FROM q_Supp s WHERE s.s = q_Cust.c AND s.n = q_Cust.n)"),
    "antijoin_k": ("", "Cust Ord", "k: number", "R(k) :- Ord(k, _, _), !Cust(k, _, _).", "SELECT o AS k FROM q_Ord EXCEPT SELECT c FROM q_Cust"),
    "antijoin_projecting": (
        "", "Ord Cust", "seg: symbol", 'R(seg) :- Cust(c, n, seg), Ord(o, c, _), !Ord(n, c, "F").',
        "SELECT DISTINCT seg FROM q_Cust JOIN q_Ord USING (c) WHERE NOT EXISTS (SELECT 1 FROM q_Ord x WHERE x.o = q_Cust.n AND x.c = q_Cust.c AND x.status = 'F')",
    ),
    "antijoin_after_join": (
        "", "Deep", "x: number, z: number", "R(x, z) :- Deep(x, y), Deep(y, z), !Deep(x, z).",
        "SELECT DISTINCT a.x, b.y AS z FROM q_Deep a JOIN q_Deep b ON a.y = b.x WHERE NOT EXISTS (SELECT 1 FROM q_Deep c WHERE c.x = a.x AND c.y = b.y)",
    ),
    "antijoin_constants": ("", "Cust Ord", "k: number", 'R(k) :- Cust(k, _, _), !Ord(_, k, "F").', "SELECT DISTINCT c AS k FROM q_Cust WHERE c NOT IN (SELECT c FROM q_Ord WHERE status = 'F')"),
    "guard": ("", "Region Ord", "k: number", "R(k) :- Region(k, _), Ord(_, _, _).", "SELECT DISTINCT r AS k FROM q_Region WHERE EXISTS (SELECT 1 FROM q_Ord)"),
    "union_rules": ("", "Cust Supp", "n: number", "R(n) :- Cust(_, n, _). R(n) :- Supp(_, n).", "SELECT n FROM q_Cust UNION SELECT n FROM q_Supp"),
    "difference": ("", "Nation Supp", "n: number", "R(n) :- Nation(n, _, _), !Supp(n, n).", "SELECT n FROM q_Nation EXCEPT SELECT n FROM q_Supp WHERE s = n"),
    "intersect": ("", "Cust Supp", "n: number", "R(n) :- Cust(_, n, _), Supp(_, n).", "SELECT n FROM q_Cust INTERSECT SELECT n FROM q_Supp"),
    "agg_count": ("", "Li", "p: number, n: number", "R(p, count(q)) :- Li(_, p, _, q).", "SELECT p, count(DISTINCT q) AS n FROM q_Li GROUP BY p"),
    "agg_sum": ("", "Li", "p: number, v: number", "R(p, sum(q)) :- Li(_, p, _, q).", "SELECT p, CAST(sum(DISTINCT q) AS BIGINT) AS v FROM q_Li GROUP BY p"),
    "agg_min": ("", "Li", "p: number, v: number", "R(p, min(q)) :- Li(_, p, _, q).", "SELECT p, min(q) AS v FROM q_Li GROUP BY p"),
    "agg_max": ("", "Li", "p: number, v: number", "R(p, max(q)) :- Li(_, p, _, q).", "SELECT p, max(q) AS v FROM q_Li GROUP BY p"),
    "agg_mid_column": ("", "Li", "s: number, v: number, k: number", "R(s, max(q), 1) :- Li(_, _, s, q).", "SELECT s, max(q) AS v, CAST(1 AS BIGINT) AS k FROM q_Li GROUP BY s"),
    "agg_expr": ("", "Li", "s: number, v: number", "R(s, sum(q * 10 + 1)) :- Li(_, _, s, q).", "SELECT s, CAST(sum(DISTINCT q * 10 + 1) AS BIGINT) AS v FROM q_Li GROUP BY s"),
    "agg_global": ("", "Li", "v: number", "R(count(p)) :- Li(_, p, _, _).", "SELECT count(DISTINCT p) AS v FROM q_Li HAVING count(*) > 0"),
    "agg_multi_rule": ("", "Cust Supp", "n: number, v: number", "R(n, count(c)) :- Cust(c, n, _). R(n, count(s)) :- Supp(s, n).", "SELECT n, count(*) AS v FROM (SELECT n, c FROM q_Cust UNION SELECT n, s FROM q_Supp) GROUP BY n"),
    "agg_having": ("", "Ord", "c: number, v: number", "N(c, count(o)) :- Ord(o, c, _). R(c, v) :- N(c, v), v > 12.", "SELECT c, count(*) AS v FROM (SELECT DISTINCT c, o FROM q_Ord) GROUP BY c HAVING count(*) > 12"),
    "arity0": ("", "Region Ord", "k: number", 'Any() :- Ord(o, _, "F"), o > 5. R(k) :- Region(k, _), Any().', "SELECT DISTINCT r AS k FROM q_Region WHERE EXISTS (SELECT 1 FROM q_Ord WHERE status = 'F' AND o > 5)"),
    "bool_true": ("", "Region", "k: number", "R(k) :- Region(k, _), True. R(k + 100) :- Region(k, _), False.", "SELECT DISTINCT r AS k FROM q_Region"),
    "input_is_head": ("", "Deep", "x: number, y: number", "Deep(x, 0) :- Deep(x, y), y > 150. R(x, y) :- Deep(x, y).", "SELECT x, y FROM q_Deep UNION SELECT x, CAST(0 AS BIGINT) FROM q_Deep WHERE y > 150"),
    "tc": ("", "Arc", "x: number, y: number", "R(x, y) :- Arc(x, y). R(x, z) :- R(x, y), Arc(y, z).", _TC.format(e="q_Arc") + " SELECT x, y FROM t"),
    "tc_deep": ("", "Deep", "x: number, y: number", "R(x, y) :- Deep(x, y). R(x, z) :- R(x, y), Deep(y, z).", _TC.format(e="q_Deep") + " SELECT x, y FROM t"),
    "nonlinear_tc": ("", "Deep", "x: number, y: number", "R(x, y) :- Deep(x, y). R(x, z) :- R(x, y), R(y, z).", _TC.format(e="q_Deep") + " SELECT x, y FROM t"),
    "reach": ("", "Deep", "y: number", "R(y) :- Deep(60, y). R(z) :- R(y), Deep(y, z).", "WITH RECURSIVE t AS (SELECT y FROM q_Deep WHERE x = 60 UNION SELECT e.y FROM t JOIN q_Deep e ON t.y = e.x) SELECT y FROM t"),
    "sg": (
        "", "Arc", "x: number, y: number", "R(x, y) :- Arc(a, x), Arc(a, y), x != y. R(x, y) :- Arc(a, x), R(a, b), Arc(b, y).",
        "WITH RECURSIVE t AS (SELECT a.y AS x, b.y AS y FROM q_Arc a JOIN q_Arc b ON a.x = b.x WHERE a.y <> b.y UNION SELECT a.y, b.y FROM t JOIN q_Arc a ON a.x = t.x JOIN q_Arc b ON b.x = t.y) SELECT x, y FROM t",
    ),
    "cc": (
        "", "Arc", "n: number, c: number", "C(n, min(n)) :- Arc(n, _). C(n, min(c)) :- Arc(o, n), C(o, c). R(n, min(c)) :- C(n, c).",
        "WITH RECURSIVE t AS (SELECT x AS n, x AS c FROM q_Arc UNION SELECT e.y, t.c FROM t JOIN q_Arc e ON t.n = e.x) SELECT n, min(c) AS c FROM t GROUP BY n",
    ),
    "sssp": (
        "", "WDeep", "y: number, d: number", "D(y, min(w)) :- WDeep(60, y, w). D(z, min(d + w)) :- D(y, d), WDeep(y, z, w), d < 60. R(y, min(d)) :- D(y, d).",
        "WITH RECURSIVE t AS (SELECT y, w AS d FROM q_WDeep WHERE x = 60 UNION SELECT e.y, t.d + e.w FROM t JOIN q_WDeep e ON t.y = e.x WHERE t.d < 60) SELECT y, min(d) AS d FROM t GROUP BY y",
    ),
    "bipartite": (
        "", "Deep", "x: number", "Zero(1) :- Deep(1, _). One(y) :- Deep(x, y), Zero(x). One(x) :- Deep(x, y), Zero(y). Zero(y) :- Deep(x, y), One(x). Zero(x) :- Deep(x, y), One(y). R(x) :- One(x), Zero(x).",
        "WITH RECURSIVE u AS (SELECT x, y FROM q_Deep UNION SELECT y, x FROM q_Deep), t AS (SELECT CAST(1 AS BIGINT) AS x, 0 AS k FROM q_Deep WHERE x = 1 UNION SELECT u.y, 1 - t.k FROM t JOIN u ON t.x = u.x) "
        "SELECT x FROM t GROUP BY x HAVING count(DISTINCT k) = 2",
    ),
    "mutual": (
        "", "Arc", "x: number, y: number", "Odd(x, y) :- Arc(x, y). Odd(x, z) :- R(x, y), Arc(y, z). R(x, z) :- Odd(x, y), Arc(y, z).",
        "WITH RECURSIVE t AS (SELECT x, y, 1 AS k FROM q_Arc UNION SELECT t.x, e.y, 1 - t.k FROM t JOIN q_Arc e ON t.y = e.x) SELECT DISTINCT x, y FROM t WHERE k = 0",
    ),
    "negation_after_recursion": (
        "", "Deep", "x: number", "N(x) :- Deep(x, _). N(y) :- Deep(_, y). T(y) :- Deep(60, y). T(z) :- T(y), Deep(y, z). R(x) :- N(x), !T(x).",
        "WITH RECURSIVE t AS (SELECT y FROM q_Deep WHERE x = 60 UNION SELECT e.y FROM t JOIN q_Deep e ON t.y = e.x) SELECT x FROM (SELECT x FROM q_Deep UNION SELECT y FROM q_Deep) EXCEPT SELECT y FROM t",
    ),
    "recursion_with_arithmetic": (
        "", "Deep", "y: number, d: number", "R(y, 1) :- Deep(60, y). R(z, d + 1) :- R(y, d), Deep(y, z), d < 4.",
        "WITH RECURSIVE t AS (SELECT y, CAST(1 AS BIGINT) AS d FROM q_Deep WHERE x = 60 UNION SELECT e.y, t.d + 1 FROM t JOIN q_Deep e ON t.y = e.x WHERE t.d < 4) SELECT y, d FROM t",
    ),
    "udf_bind": (_PYTHON, "Li", "o: number, v: number", "R(o, v) :- Li(o, _, _, q), v = @call(capped, q, 20).", "SELECT DISTINCT o, least(q, 20) AS v FROM q_Li"),
    "udf_filter": (_PYTHON, "Cust Nation", "c: number", "R(c) :- Cust(c, n, _), @call(even, c), Nation(n, _, 1).", "SELECT DISTINCT c FROM q_Cust JOIN q_Nation USING (n) WHERE c % 2 = 0 AND r = 1"),
    "udf_symbol": (_PYTHON, "Nation", "t: symbol", "R(t) :- Nation(_, name, _), t = @call(tagged, name).", "SELECT DISTINCT name || '_x' AS t FROM q_Nation"),
    "sql_functions": (
        _SQL, "Nation", "n: number, d: number, t: symbol", "R(n, d, t) :- Nation(n, name, r), d = @call(spread, n, r), @call(far, d), t = @call(lowered, name).",
        "SELECT DISTINCT n, abs(n - r * 5) AS d, lower(name) AS t FROM q_Nation WHERE abs(n - r * 5) >= 4",
    ),
    "event_users": ("", "Ev Supp", "u: number, n: number", "B(u) :- Supp(u, _). R(u, count(e)) :- Ev(e, u, _), !B(u).", "SELECT u, count(DISTINCT e) AS n FROM q_Ev WHERE u NOT IN (SELECT s FROM q_Supp) GROUP BY u"),
    "part_brands": ("", "Part", "brand: symbol, v: number", "R(brand, sum(size)) :- Part(_, brand, size).", "SELECT brand, CAST(sum(DISTINCT size) AS BIGINT) AS v FROM q_Part GROUP BY brand"),
}


def frames(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    """The named relations, from temporary views that carry this folder's name."""
    prefix = f"hl_{abs(hash(sf_dir)):x}_"
    out = {}
    for name in names:
        sql = RELATIONS[name][1]
        for t in _TABLES:
            if f"FROM {t}" in sql:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(prefix + t)
                sql = sql.replace(f"FROM {t}", f"FROM {prefix}{t}")
        out[name] = spark.sql(sql.replace("SELECT DISTINCT", "SELECT", 1))  # relations are sets by meaning, however often a row is given
    return out


def program(key: str) -> str:
    blocks, inputs, output, rules, _ = PROGRAMS[key]
    decls = " ".join(f".decl {n}({RELATIONS[n][0]})" for n in inputs.split())
    return f"{blocks}.in {decls}\n.printsize .decl R({output})\n.rule\n{rules}\n"


def _runner(key: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark).query(program(key), frames(spark, sf_dir, PROGRAMS[key][1].split()), key)["R"]

    return run


def symbol_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64-bit ids of all nation names."""
    return frames(spark, sf_dir, ["Nation"])["Nation"].select("name", symbol_id_column(F.col("name")).alias("id")).distinct()


def witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the smallest edge is in a closure, and why its first node reaches as many as it does."""
    text = ".in .decl Deep(x: number, y: number) .out .decl T(x: number, y: number) .decl N(x: number, n: number) T(x, y) :- Deep(x, y). T(x, z) :- T(x, y), Deep(y, z). N(x, count(y)) :- T(x, y)."
    given = frames(spark, sf_dir, ["Deep"])
    engine = Engine(spark)
    edge = given["Deep"].orderBy("x", "y").first()
    result = engine.evaluate(text, frames=given)
    asked = [("T", list(edge))] + [("N", list(r)) for r in result.relations["N"].where(F.col("x") == edge["x"]).collect()]
    found = engine.explain(result, asked)
    shown = lambda row: ",".join(map(str, row))
    rows = [(w["relation"], shown(w["row"]), w["rule"], ";".join(shown(p["row"]) for p in w["parents"])) for w in found]
    return spark.createDataFrame(rows, "relation string, row string, rule bigint, parents string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _runner(k) for k in PROGRAMS} | {"symbol_id": symbol_ids, "explain": witnesses}


def oracle(key: str) -> str:
    """The SQL of a program over the plain tables."""
    _, inputs, _, _, sql = PROGRAMS[key]
    given = ", ".join(f"q_{n} AS ({RELATIONS[n][1]})" for n in inputs.split())
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {given}, {sql.removeprefix('WITH RECURSIVE ')}"
    return f"WITH {given} {sql}"


ORACLE = {k: oracle(k) for k in PROGRAMS} | {
    "symbol_id": "SELECT DISTINCT n_name AS name, CAST(CAST('0x' || substr(sha256(n_name), 1, 16) AS UBIGINT) & CAST(9223372036854775807 AS UBIGINT) AS BIGINT) AS id FROM nation",
    "explain": "WITH RECURSIVE q_Deep AS (" + RELATIONS["Deep"][1] + "), " + _TC.format(e="q_Deep").removeprefix("WITH RECURSIVE ") + ", e AS (SELECT x, y FROM q_Deep ORDER BY x, y LIMIT 1) "
    "SELECT 'T' AS relation, x || ',' || y AS \"row\", CAST(0 AS BIGINT) AS rule, x || ',' || y AS parents FROM e "
    "UNION ALL SELECT 'N', x || ',' || count(*), CAST(2 AS BIGINT), string_agg(x || ',' || y, ';' ORDER BY y) FROM t WHERE x = (SELECT x FROM e) GROUP BY x",
}
