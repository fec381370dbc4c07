"""Golden programs, and random ones against the naive evaluator."""

import random

import pytest

from hornlog import Diagnostic, Engine, EngineConfig, EvaluationOptions

from . import naive

MAX, MIN = (1 << 63) - 1, -(1 << 63)


def run(engine, text, rows, **options):
    result = engine.evaluate(text, rows, options=EvaluationOptions(**options))
    return {n: result.rows(n) for n in result.declared()}


#: name: (program, rows, expected)
GOLDEN = {
    "min_negative": (".in .decl E(k:number,v:number) .out .decl M(k:number,v:number) M(k,min(v)) :- E(k,v).", {"E": [(1, 3), (1, -4), (1, 7), (2, -1), (2, -9), (3, 5)]}, {"M": [(1, -4), (2, -9), (3, 5)]}),
    "wide_aggregates": (
        ".in .decl E(a:number,b:number,c:number,d:number,e:number,v:number) .out .decl S(a:number,b:number,c:number,d:number,e:number,v:number) .decl C(a:number,b:number,c:number,d:number,e:number,v:number)"
        " S(a,b,c,d,e,sum(v)) :- E(a,b,c,d,e,v). C(a,b,c,d,e,count(v)) :- E(a,b,c,d,e,v).",
        {"E": [(1, 2, 3, 4, 5, 6), (1, 2, 3, 4, 5, 7)]}, {"S": [(1, 2, 3, 4, 5, 13)], "C": [(1, 2, 3, 4, 5, 2)]},
    ),
    "cross": (".in .decl Round(r:number) .decl Arc(x:number,y:number) .out .decl O(r:number,x:number,y:number) O(r,x,y) :- Round(r), Arc(x,y).", {"Round": [(7,), (8,)], "Arc": [(1, 2), (3, 4)]}, {"O": [(7, 1, 2), (7, 3, 4), (8, 1, 2), (8, 3, 4)]}),
    "wide_antijoin": (".in .decl A(k:number,a:number,b:number,c:number,d:number) .decl B(k:number) .out .decl O(k:number,a:number,b:number,c:number,d:number) O(k,a,b,c,d) :- A(k,a,b,c,d), !B(k).", {"A": [(1, 2, 3, 4, 5), (9, 8, 7, 6, 5)], "B": [(9,)]}, {"O": [(1, 2, 3, 4, 5)]}),
    "guard": (".in .decl s(a:number) .decl t(b:number,c:number) .out .decl o(a:number) .decl p(a:number) o(A) :- s(A), t(_,_). p(A) :- s(A), t(B,_).", {"s": [(5,), (6,)], "t": [(7, 8), (9, 10), (11, 12)]}, {"o": [(5,), (6,)], "p": [(5,), (6,)]}),
    "guard_of_nothing": (".in .decl s(a:number) .decl t(b:number,c:number) .out .decl o(a:number) o(A) :- s(A), t(_,_).", {"s": [(5,)], "t": []}, {"o": []}),
    "guard_in_a_loop": (".in .decl s(a:number) .decl arc(a:number,b:number) .decl t(b:number,c:number) .out .decl r(a:number) r(x) :- s(x). r(y) :- r(x), arc(x,y), t(_,_).", {"s": [(5,)], "arc": [(5, 6), (6, 7)], "t": [(7, 8)]}, {"r": [(5,), (6,), (7,)]}),
    "antijoin_projects_after": (".in .decl c(f:number,o:number,l:number) .decl b(f:number,o:number,l:number) .out .decl u(f:number,o:number) u(F,O) :- c(F,O,L), !b(F,O,L).", {"c": [(0, 1, 3), (0, 1, 4), (2, 2, 2)], "b": [(0, 1, 3), (2, 2, 2)]}, {"u": [(0, 1)]}),
    "antijoin_after_recursion": (
        ".in .decl seed(f:number,l:number) .decl step(a:number,b:number) .decl blocked(f:number,l:number) .out .decl live(f:number,l:number) .decl reach(f:number)"
        " live(f,l) :- seed(f,l). live(g,l) :- live(f,l), step(f,g). reach(f) :- live(f,l), !blocked(f,l).",
        {"seed": [(0, 3), (0, 4)], "step": [(0, 1)], "blocked": [(0, 3), (0, 4), (1, 3)]}, {"live": [(0, 3), (0, 4), (1, 3), (1, 4)], "reach": [(1,)]},
    ),
    "antijoin_in_a_loop_blocks_all": (".in .decl s(a:number) .decl arc(a:number,b:number) .decl no(a:number) .out .decl r(a:number) r(x) :- s(x). r(y) :- r(x), arc(x,y), !no(y).", {"s": [(1,)], "arc": [(1, 2), (1, 3), (2, 4)], "no": [(2,), (3,)]}, {"r": [(1,)]}),
    "head_arithmetic": (".in .decl E(k:number,v:number) .out .decl R(k:number,c:number) .decl S(a:number,b:number) R(k,7) :- E(k,v). S(k + v * 2, k) :- E(k,v).", {"E": [(1, 2), (3, 4)]}, {"R": [(1, 7), (3, 7)], "S": [(6, 1), (14, 3)]}),
    "symbols": ('.in .decl E(k:number,v:symbol) .out .decl R(k:number) .decl N(v:symbol,k:number) R(k) :- E(k,v), v = "hello". N(v,k) :- E(k,v).', {"E": [(1, "hello"), (2, "world")]}, {"R": [(1,)], "N": [("hello", 1), ("world", 2)]}),
    "full_domain": (".in .decl E(k:number,v:number) .out .decl R(k:number,v:number) R(k,v) :- E(k,v), v > 4294967295.", {"E": [(1, MAX), (2, MIN), (3, 4294967296), (4, 7)]}, {"R": [(1, MAX), (3, 4294967296)]}),
    "aggregate_positions": (
        ".in .decl E(k:number,v:number) .out .decl F(v:number,k:number) .decl M(k:number,v:number,c:number) .decl C(k:number,n:number) .decl S(k:number,n:number)"
        " F(min(v),k) :- E(k,v). M(k,max(v),1) :- E(k,v). C(k,count(v)) :- E(k,v). S(k,sum(v * 10 + 1)) :- E(k,v).",
        {"E": [(1, 3), (1, 5), (2, -4), (2, 7)]}, {"F": [(-4, 2), (3, 1)], "M": [(1, 5, 1), (2, 7, 1)], "C": [(1, 2), (2, 2)], "S": [(1, 82), (2, 32)]},
    ),
    "arity_zero": (".in .decl E(k:number) .out .decl Any() .decl M(k:number) Any() :- E(k), k > 5. M(k) :- E(k), Any().", {"E": [(1,), (9,)]}, {"Any": [()], "M": [(1,), (9,)]}),
    "arity_zero_empty": (".in .decl E(k:number) .out .decl Any() .decl M(k:number) Any() :- E(k), k > 5. M(k) :- E(k), Any().", {"E": [(1,)]}, {"Any": [], "M": []}),
    "true_false": (".in .decl E(k:number) .out .decl R(k:number) .decl N(k:number) R(k) :- E(k), True. N(k) :- E(k), False.", {"E": [(1,)]}, {"R": [(1,)], "N": []}),
    "two_strata_head": (".in .decl A(x:number,y:number) .decl B(x:number,y:number) .out .decl H(x:number) .decl K(x:number) G(y) :- B(_,y). H(x) :- A(x,_). H(y) :- A(_,y). H(x) :- G(x). K(x) :- H(x).", {"A": [(1, 2)], "B": [(2, 3)]}, {"H": [(1,), (2,), (3,)], "K": [(1,), (2,), (3,)]}),
    "undefined_reads_empty": (".in .decl E(a:number,b:number) .out .decl Tag(a:number) .decl H(a:number) H(x) :- E(x,_). H(y) :- E(_,y). H(x) :- Tag(x).", {"E": [(1, 2)]}, {"H": [(1,), (2,)], "Tag": []}),
    "input_is_head": (".in .decl E(a:number,b:number) .out .decl O(a:number,b:number) E(x,z) :- E(x,y), E(y,z). O(x,y) :- E(x,y).", {"E": [(1, 2), (2, 3)]}, {"O": [(1, 2), (1, 3), (2, 3)]}),
    "wrapping": (".in .decl E(a:number,b:number) .out .decl R(x:number) .decl S(x:number) R(a + b) :- E(a,b). S(sum(a)) :- E(a,_).", {"E": [(MAX, 1), (MAX - 1, 5)]}, {"R": [(MIN,), (MIN + 3,)], "S": [(-3,)]}),
    "division": (".in .decl E(a:number,b:number) .out .decl R(q:number,r:number) R(a / b, a % b) :- E(a,b).", {"E": [(-7, 2), (7, -2), (MIN, -1)]}, {"R": [(MIN, 0), (-3, -1), (-3, 1)]}),
    "global_aggregate_of_nothing": (".in .decl E(a:number) .out .decl C(n:number) C(count(a)) :- E(a).", {"E": []}, {"C": []}),
    "case_matters": (".in .decl E(a:number,b:number) .out .decl R(a:number,b:number) R(x,X) :- E(x,X), x < X.", {"E": [(1, 2), (3, 1)]}, {"R": [(1, 2)]}),
    "calls": (
        ".code python\ndef normalize(v: int, limit: int) -> int:\n    return min(abs(v), limit)\n\n\ndef keep(v: int) -> bool:\n    return v > 0\n.endcode\n.code sql\nadd(a: int, b: int) -> int = a + b\ntag(s: str) -> str = concat(s, '_s')\n.endcode\n"
        ".in .decl I(k:number,v:number,s:symbol) .decl L(l:number) .out .decl O(k:number,v:number,n:number,m:number,s:symbol) O(k,v,n,m,t) :- I(k,v,s), L(l), n = @call(normalize,v,l), m = @call(add,n,1), @call(keep,k), m > 3, t = @call(tag,s).",
        {"I": [(1, -3, "a"), (2, 2, "b"), (3, 300, "c"), (-4, -4, "d")], "L": [(255,)]}, {"O": [(1, -3, 3, 4, "a_s"), (3, 300, 255, 256, "c_s")]},
    ),
    "call_in_a_loop": (".code python\ndef next(x: int) -> int:\n    return x + 1\n\n\ndef at_most(x: int, m: int) -> bool:\n    return x <= m\n.endcode\n.in .decl Seed(x:number) .out .decl N(x:number) N(x) :- Seed(x). N(y) :- N(x), y = @call(next,x), @call(at_most,y,3).", {"Seed": [(0,)]}, {"N": [(0,), (1,), (2,), (3,)]}),
    "prefilter_fault_spares_dropped_rows": (".code python\ndef small(x: int) -> bool:\n    if x > 100:\n        raise ValueError('large')\n    return True\n.endcode\n.in .decl E(a:number,b:number) .decl F(b:number,c:number) .decl G(c:number,d:number) .out .decl R(a:number,d:number) R(a,d) :- E(a,b), @call(small,a), F(b,c), G(c,d).", {"E": [(1, 2), (500, 4)], "F": [(2, 3), (4, 5)], "G": [(3, 7)]}, {"R": [(1, 7)]}),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(engine, name):
    text, rows, want = GOLDEN[name]
    assert run(engine, text, rows) == want


PROGRAMS = {
    "tc": "T(x,y) :- E(x,y). T(x,z) :- T(x,y), E(y,z).",
    "nonlinear": "T(x,y) :- E(x,y). T(x,z) :- T(x,y), T(y,z).",
    "sg": "T(x,y) :- E(a,x), E(a,y), x != y. T(x,y) :- E(a,x), T(a,b), E(b,y).",
    "mutual": "Z(x) :- N(x). O(y) :- E(x,y), Z(x). Z(y) :- E(x,y), O(x). T(x,x) :- Z(x), O(x).",
    "cc": "C(n,min(n)) :- E(n,_). C(n,min(c)) :- E(o,n), C(o,c). T(n,min(c)) :- C(n,c).",
    "sssp": "D(x,min(0)) :- N(x). D(y,min(d + w)) :- D(x,d), W(x,y,w). T(x,min(d)) :- D(x,d).",
    "negation": "P(x,y) :- E(x,y). P(x,z) :- P(x,y), E(y,z). T(x,y) :- E(x,_), E(_,y), !P(x,y).",
    "points_to": "T(y,x) :- N(x), E(y,x). T(y,x) :- E(y,z), T(z,x). T(y,w) :- W(y,x,1), T(x,z), T(z,w).",
    "aggregates": "A(k,count(v)) :- W(k,v,_). A(k,count(w)) :- W(k,_,w). T(k,n) :- A(k,n), n > 1.",
    "arith": "T(x * 2 - y, y % 3) :- E(x,y), x + y * 2 > 5, x != y.",
}
DECLS = ".in .decl E(x:number,y:number) .decl N(x:number) .decl W(x:number,y:number,w:number) .out .decl T(x:number,y:number) .rule "


@pytest.mark.parametrize("name", PROGRAMS)
def test_against_naive(engine, name):
    rng = random.Random(name)
    n = 9
    rows = {
        "E": [(rng.randrange(n), rng.randrange(n)) for _ in range(12)], "N": [(rng.randrange(n),)],
        "W": [(rng.randrange(n), rng.randrange(n), rng.randrange(1, 4)) for _ in range(14)],
    }
    text = DECLS + PROGRAMS[name]
    assert run(engine, text, rows)["T"] == naive.evaluate(text, rows)["T"]


#: Analyses of several strata: intermediate relations, mutual recursion, and negation below and above loops.
ANALYSES = {
    "ontology": (
        "P(x,y) :- E(x,y). Q(x,r,z) :- W(x,z,r). P(x,z) :- P(x,y), P(y,z). Q(x,r,z) :- P(x,y), Q(y,r,z). Q(x,r,u) :- Q(x,r,z), P(z,u). P(x,n) :- Q(x,1,z), P(z,n), N(n)."
        " T(x,y) :- P(x,y), Q(y,2,_). T(x,z) :- Q(x,3,z), !P(x,z)."
    ),
    "ordered_list": (
        "Child(p,c) :- E(p,c), p < c. Older(p,c) :- Child(p,c), Child(p,d), d > c. First(p,c) :- Child(p,c), !Older(p,c). Between(c,e) :- Child(p,c), Child(p,d), Child(p,e), c > d, d > e."
        " Sibling(c,e) :- Child(p,c), Child(p,e), c > e, !Between(c,e). Follows(c) :- Sibling(c,_). Up(c,n) :- Sibling(c,n). Up(c,n) :- Child(p,c), Up(p,n), !Follows(c). Inner(x) :- Child(x,_)."
        " Next(x,y) :- First(x,y). Next(x,n) :- Up(x,n), !Inner(x). Gone(x) :- N(x). Skip(x,y) :- Next(x,y). Skip(x,z) :- Skip(x,y), Gone(y), Next(y,z). T(x,y) :- Skip(x,y), !Gone(x), !Gone(y)."
    ),
    "loans": (
        "Cut(v,p) :- W(p,v,2). Live(v,p) :- W(p,v,1). Live(v,p) :- Live(v,q), E(p,q), !Cut(v,p). Held(l,p) :- W(p,l,3). Held(l,q) :- Held(l,p), E(p,q), !Cut(l,q)."
        " Sub(a,b,p) :- W(a,b,1), N(p). Sub(a,b,q) :- Sub(a,b,p), E(p,q), Live(a,q). Sub(a,c,p) :- Sub(a,b,p), Sub(b,c,p). T(l,p) :- Held(l,p), Live(l,p). T(l,p) :- Held(l,p), Sub(l,b,p), Live(b,p)."
    ),
    "brackets": "D(x,x) :- E(x,_). D(x,x) :- E(_,x). D(x,z) :- D(x,y), D(y,z). D(x,z) :- W(x,a,k), D(a,b), W(z,b,k). T(x,y) :- D(x,y), x != y.",
}


@pytest.mark.parametrize("name", ANALYSES)
def test_analyses_against_naive(engine, name):
    rng = random.Random(name)
    n = 7
    rows = {
        "E": [(rng.randrange(n), rng.randrange(n)) for _ in range(11)], "N": [(k,) for k in range(0, n, 3)],
        "W": [(rng.randrange(n), rng.randrange(n), rng.randrange(1, 4)) for _ in range(16)],
    }
    text = DECLS + ANALYSES[name]
    want = naive.evaluate(text, rows)["T"]
    assert want and run(engine, text, rows)["T"] == want


@pytest.mark.parametrize("level", [1, 2, 3])
def test_results_do_not_depend_on_optimizing(spark, level):
    text = ".in .decl A(x:number,y:number) .decl B(x:number,y:number) .decl C(x:number) .out .decl H(x:number,y:number,z:number) H(x,y,z) :- A(x,y), C(z). H(x,y,z) :- H(x,w,q), A(w,v), B(v,y), C(z), y > 0. .optimize"
    rows = {"A": [(1, 2), (2, 3)], "B": [(3, 4)], "C": [(7,)]}
    assert run(Engine(spark, EngineConfig(level, level == 2)), text, rows) == {"H": [(1, 2, 7), (1, 4, 7), (2, 3, 7)]}


def fault(engine, text, rows, **options):
    with pytest.raises(Diagnostic) as e:
        run(engine, text, rows, **options)
    return e.value


def test_faults_and_limits(engine):
    e = fault(engine, ".in .decl E(k:number,v:number) .out .decl R(k:number) R(k / v) :- E(k,v).", {"E": [(4, 2), (1, 0)]})
    assert e.kind == "evaluation" and "division by zero" in e.message and e.rule
    e = fault(engine, ".code python\n\ndef f(x: int) -> int:\n    return 1 // x\n.endcode\n.in .decl E(k:number) .out .decl R(k:number) R(y) :- E(k), y = @call(f,k).", {"E": [(0,)]})
    assert e.kind == "function" and e.function == "f" and "line 3" in e.message
    loop = ".in .decl Seed(k:number) .out .decl N(k:number) N(k) :- Seed(k). N(k + 1) :- N(k), k < 1000000000."
    e = fault(engine, loop, {"Seed": [(0,)]}, budget_seconds=2)
    assert e.kind == "resource" and "time budget" in e.message
    e = fault(engine, ".in .decl E(k:number) .out .decl R(k:number) R(k) :- E(k).", {"E": [(1,), (2,), (3,)]}, tuple_limit=2)
    assert e.kind == "resource" and "tuple ceiling" in e.message
    for rows in ({"X": [(1,)]}, {"E": [(1, 2)]}, {"E": [("a",)]}):
        assert fault(engine, ".in .decl E(k:number) .out .decl R(k:number) R(k) :- E(k).", rows).kind == "input"


def test_a_filter_refuses_the_rows_that_joins_keep(engine):
    """The early test of a filter spares rows that later joins drop; a row that they keep still faults."""
    text = (
        ".code python\ndef small(x: int) -> bool:\n    if x > 100:\n        raise ValueError('large')\n    return True\n.endcode\n"
        ".in .decl E(a:number,b:number) .decl F(b:number,c:number) .decl G(c:number) .out .decl R(a:number) R(a) :- E(a,b), @call(small,a), F(b,c), G(c)."
    )
    rows = {"E": [(1, 1), (101, 2)], "F": [(1, 5), (2, 6)], "G": [(5,)]}
    assert run(engine, text, rows) == {"R": [(1,)]}
    e = fault(engine, text, rows | {"G": [(5,), (6,)]})
    assert e.kind == "function" and e.function == "small"


def test_witness(engine):
    text = ".in\n.decl Edge(x: number, y: number)\n.printsize\n.decl Reach(x: number, y: number)\n.decl Count(x: number, c: number)\n.rule\nReach(x, y) :- Edge(x, y).\nReach(x, z) :- Reach(x, y), Edge(y, z).\nCount(x, count(y)) :- Reach(x, y).\n"
    asked = [("Reach", [1, 3]), ("Count", [1, 2]), ("Reach", [3, 1]), ("Edge", [1, 2])]
    reach, count, absent, given = engine.evaluate(text, {"Edge": [(1, 2), (2, 3)]}, options=EvaluationOptions(explain=asked)).witnesses
    assert (reach["rule"], reach["line"]) == (1, 8)
    assert [(p["relation"], p["row"]) for p in reach["parents"]] == [("Reach", [1, 2]), ("Edge", [2, 3])]
    assert (count["rule"], count["group_size"], len(count["parents"])) == (2, 2, 2)
    assert not absent["present"] and given["present"] and given["input"] and "rule" not in given
