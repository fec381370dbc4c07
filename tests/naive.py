"""An independent evaluator over Python sets, one row at a time."""

from hornlog.functions.blocks import read_blocks
from hornlog.lang.ast import Agg, Const, Var
from hornlog.lang.parser import parse
from hornlog.lang.validate import validate
from hornlog.plans.stratify import stratify


def wrap(x):
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def value(e, env):
    of = lambda f: env[f.name] if isinstance(f, Var) else f.value
    out = of(e.first)
    for op, f in e.rest:
        y = of(f)
        if op in "/%":
            q = abs(out) // abs(y) * (1 if (out < 0) == (y < 0) else -1)
            out = wrap(q) if op == "/" else out - q * y
        else:
            out = wrap(out + y if op == "+" else out - y if op == "-" else out * y)
    return out


def match(atom, row, env):
    env = dict(env)
    for a, v in zip(atom.args, row):
        if isinstance(a, Const) and a.value != v or isinstance(a, Var) and env.setdefault(a.name, v) != v:
            return None
    return env


def solutions(rule, states):
    envs = [{}]
    for atom in rule.atoms():
        envs = [e for env in envs for row in states.get(atom.relation, ()) if (e := match(atom, row, env)) is not None]
    for env in envs:
        if rule.never() or any(match(a, row, env) is not None for a in rule.negated() for row in states.get(a.relation, ())):
            continue
        tests = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        if all(tests[c.op](value(c.left, env), value(c.right, env)) for c in rule.compares()):
            yield tuple(value(a.expr if isinstance(a, Agg) else a, env) for a in rule.head.args)


def evaluate(text, rows):
    p = parse(text)
    p.functions = read_blocks(p)
    validate(p)
    states = {n: set(map(tuple, r)) for n, r in rows.items()}
    raw = {}
    for stratum in stratify(p):
        changed = True
        while changed:
            changed = False
            for r in stratum.rules:
                new, shape = set(solutions(r, states)), r.head.aggregate()
                name = r.head.relation
                if shape:
                    k, agg = shape
                    raw.setdefault(name, set()).update(new)
                    groups = {}
                    for row in raw[name]:
                        groups.setdefault(row[:k] + row[k + 1 :], set()).add(row[k])
                    how = {"count": len, "sum": lambda v: wrap(sum(v)), "min": min, "max": max}[agg.op]
                    out = {key[:k] + (how(v),) + key[k:] for key, v in groups.items()}
                else:
                    out = states.get(name, set()) | new
                if out != states.get(name, set()):
                    states[name] = out
                    changed = stratum.recursive
    return {n: sorted(states.get(n, ())) for n in p.types}
