import pytest

from hornlog import Diagnostic
from hornlog.functions.blocks import read_blocks
from hornlog.lang.ast import Const, Expr
from hornlog.lang.parser import parse
from hornlog.lang.validate import validate
from hornlog.plans.joins import join_order
from hornlog.plans.stratify import stratify

E = ".in .decl E(k: number, v: number) .decl S(k: number, s: symbol) .out .decl R(k: number) .rule "


def checked(text):
    p = parse(text)
    p.functions = read_blocks(p)
    return validate(p)


def refused(text, kind, *words):
    with pytest.raises(Diagnostic) as e:
        stratify(checked(text))
    assert e.value.kind == kind
    assert all(w in str(e.value) for w in words), str(e.value)
    return e.value


def test_parses_everything():
    p = parse(
        '.in // inputs\n.decl A(x: number, s: string)\n.input A-1.csv\n.decl B()\n# outputs\n.printsize\n.decl C(x: number)\n.output C.csv\n.rule\n'
        'C(x-1) :- A(x, "a#b // c"), !B2(x, _), x + -1 * 2 >= -3, True, False. .plan\nB2(x, 7) :- A(x, _).\n.out .decl D(a: number)\nD(count(x + 1)) :- C(x).sip(x) :- C(x).'
    )
    assert [d.file for d in p.decls.values()] == ["A-1.csv", None, "C.csv", None]
    assert p.decls["A"].attributes == [("x", "number"), ("s", "symbol")]
    assert [r.plan for r in p.rules] == [True, False, False, False]
    assert p.rules[0].line == 10 and p.rules[3].head.relation == "sip"
    assert p.rules[0].compares()[0].left.rest == (("+", Const(-1)), ("*", Const(2)))
    assert p.rules[0].atoms()[0].args[1] == Const("a#b // c")
    assert isinstance(p.rules[0].head.args[0], Expr) and p.rules[0].head.args[0].rest == (("-", Const(1)),)


@pytest.mark.parametrize(
    "text", ["R(x) :- E(x).", ".in .rule R(x) :- E(x).", E + "R(k) :- E(k, v)", E + "R(k) :- E(k, v), k == v.", E + "R(k).", E + "R(k) :- E(k, 9223372036854775808).", E + "R(_1) :- E(k, v).", ".in .decl E(k: float)", ".code python\nx"]
)
def test_refuses_text(text):
    refused(text, "parse")


def test_parse_errors_have_a_place():
    e = refused(".in\n.decl E(k: number)\n.out .decl R(k: number)\n.rule\nR(k) :- E(k) E(k).", "parse")
    assert (e.location.line, e.location.column) == (5, 14)


@pytest.mark.parametrize(
    ("rules", "words"),
    [
        ("R(k) :- k > 1.", "positive atom"),
        ("R(k) :- !E(k, k).", "positive atom"),
        ("R(k) :- E(k, v), !S(z, _).", "z"),
        ("R(k) :- E(k, v), !S(_, _).", "negates S without retaining any of its columns"),
        ("R(k) :- E(k, v), z > 1.", "z"),
        ("R(z) :- E(k, v).", "z"),
        ("T(count(k), sum(v)) :- E(k, v).", "one aggregate"),
        ("T(k, count(v)) :- E(k, v). T(k, sum(v)) :- E(k, v).", "aggregate differently"),
        ("T(k, count(v)) :- E(k, v). T(k, v) :- E(k, v).", "aggregate differently"),
        ("R(k, v) :- E(k, v).", "columns"),
        ("R(k) :- E(k).", "columns"),
        ("R(k) :- E(k, v), S(v, k).", "both"),
        ("R(k) :- S(k, 5).", "constant"),
        ('R(k) :- E(k, "a").', "constant"),
        ("R(k) :- S(k, s), s + 1 > 2.", "arithmetic"),
        ('R(k) :- S(k, s), s < "b".', "order"),
        ("R(k) :- S(k, s), s = k.", "comparison"),
        ("T(k, min(s)) :- S(k, s).", "over a symbol"),
        ("R(s) :- S(k, s).", "puts a symbol"),
        ("R(k) :- E(k, v), Missing(v).", "neither declared nor derived"),
        ("R(y) :- E(k, v), y = @call(nope, k).", "unknown function"),
    ],
)
def test_refuses_meaning(rules, words):
    e = refused(E + rules, "validation", words)
    assert e.rule and e.location.line == 1


@pytest.mark.parametrize(
    ("rule", "words"),
    [
        ("R(y) :- E(k, v), y = @call(one, k, v).", "takes 1"),
        ("R(y) :- E(k, v), y = @call(one, _).", "wildcard"),
        ("R(y) :- E(k, v), y = @call(one, z).", "not bound"),
        ("R(y) :- S(k, s), y = @call(one, s).", "wrong type"),
        ("R(y) :- E(k, v), y = @call(even, k).", "bool"),
        ("R(k) :- E(k, v), @call(one, k).", "cannot filter"),
        ("R(k) :- E(k, v), k = @call(one, v).", "bound already"),
    ],
)
def test_refuses_calls(rule, words):
    blocks = ".code python\ndef one(x: int) -> int:\n    return x\n\n\ndef even(x: int) -> bool:\n    return x % 2 == 0\n.endcode\n"
    refused(blocks + E + rule, "validation", words)


def test_refuses_blocks():
    refused(".code rust\nfn f() {}\n.endcode\n" + E + "R(k) :- E(k, v).", "validation", "unsupported embedded language")
    refused(".code python\ndef f(x):\n    return x\n.endcode\n" + E + "R(k) :- E(k, v).", "function", "annotated")
    refused(".code python\ndef f(:\n.endcode\n" + E + "R(k) :- E(k, v).", "function", "not Python")
    refused(".code sql\nf(x: int) -> int = x\nf(x: int) -> int = x\n.endcode\n" + E + "R(k) :- E(k, v).", "validation", "twice")
    refused(".in .decl E(k: number) .decl E(k: number) .out .decl R(k: number)", "validation", "twice")


def test_infers_types():
    p = checked('.in .decl S(k: number, s: symbol) .out .decl R(k: number) .rule H(s, k, 7, "x") :- S(k, s). G(a, b) :- H(a, b, _, _). R(k) :- G(_, k).')
    assert p.types["H"] == ["symbol", "number", "number", "symbol"] and p.types["G"] == ["symbol", "number"]


def test_strata():
    p = checked(E + "T(k, v) :- E(k, v). T(k, w) :- T(k, v), E(v, w). U(k) :- E(k, _), !T(k, k). R(k) :- U(k).")
    assert [([r.number for r in s.rules], s.recursive) for s in stratify(p)] == [([0], False), ([1], True), ([2], False), ([3], False)]
    refused(E + "R(k) :- E(k, v), !R(v).", "stratification", "not stratifiable")
    refused(E + "A(k) :- E(k, v), !B(k). B(k) :- A(k).", "stratification")


def test_join_orders():
    v = [{"x"}, {"y"}, {"x", "y"}]
    assert join_order(v) == [0, 2, 1] and join_order(v, 1) == [1, 2, 0]
    assert sorted(join_order(v, None, True)) == [0, 1, 2]
