"""One rule as a DataFrame plan.

Every atom is a relation's columns renamed to the rule's variables, filtered by
its constants and repeats.  Atoms are joined on shared variables; one that adds
no needed variable only restricts (a semi join), one without variables only has
to be non-empty.  Comparisons and negations are placed where their variables are
first bound.  Catalyst picks the physical joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import FAULT, Function
from ..lang.ast import Agg, Atom, Compare, Const, Expr, Rule, Var
from ..plans.joins import join_order

UNIT = "__unit"
#: Rows of a side of a spread join's cells, about, and pairs of one of its tasks; rows of a task that counts a join's pairs.
SIDE, PAIRS, COUNTED = 2_000, 16_000_000, 1_000_000


def cells(arity: int) -> list[str]:
    return [f"c{k}" for k in range(arity)] or [UNIT]


def constant(value: int | str) -> Column:
    return F.lit(value) if isinstance(value, str) else F.lit(value).cast("bigint")


def _literal(value: int | str) -> str:
    if isinstance(value, int):
        return f"cast('{value}' as bigint)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class RulePlan:
    """Builds a rule's head rows from a source of relations: source(atom, position) -> DataFrame of c0, c1, ..."""

    def __init__(self, rule: Rule, functions: dict[str, Function], optimize: int = 0):
        self.rule, self.functions = rule, functions
        self.atoms = rule.atoms()
        names = dict.fromkeys(v for p in rule.body if isinstance(p, Atom) for v in p.variables())
        names |= dict.fromkeys(c.target for c in rule.calls() if c.target)
        self.column = {v: f"v{k}" for k, v in enumerate(names)}  # Spark's names ignore case, variables' do not
        many = len(self.atoms) > 2
        self.structural = many and (rule.plan or optimize in (2, 3))
        self.sip = many and (rule.sip or optimize in (1, 3))
        self.tasks: int | None = None  # of joins, where the session's number would make them large

    def of(self, x: Var | Const) -> Column:
        return F.col(self.column[x.name]) if isinstance(x, Var) else constant(x.value)

    def expression(self, e: Expr) -> Column:
        out = self.of(e.first)
        for op, factor in e.rest:
            right = self.of(factor)
            if op in "/%":
                fault = F.raise_error(F.lit(f"{FAULT}|evaluation|{self.rule.number}||||division by zero in {e}|")).cast("bigint")
                value = F.call_function("div", out, right) if op == "/" else out % right
                out = F.when(right == 0, fault).otherwise(value)
            else:
                out = out + right if op == "+" else out - right if op == "-" else out * right
        return out

    def compare(self, c: Compare) -> Column:
        a, b = self.expression(c.left), self.expression(c.right)
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[c.op]

    def image(self, atom: Atom, df: DataFrame, keep: set[str]) -> DataFrame:
        """The atom's rows as variables; only those in ``keep`` stay."""
        first: dict[str, str] = {}
        for k, a in enumerate(atom.args):
            if isinstance(a, Const):
                df = df.where(F.col(f"c{k}") == constant(a.value))
            elif isinstance(a, Var):
                if a.name in first:
                    df = df.where(F.col(f"c{k}") == F.col(first[a.name]))
                else:
                    first[a.name] = f"c{k}"
        for v, c in first.items():  # a NULL of a given table binds no variable
            df = df.where(F.col(c).isNotNull()) if v in keep else df
        chosen = [F.col(c).alias(self.column[v]) for v, c in first.items() if v in keep]
        return df.select(*chosen) if chosen else df.select(F.lit(1).alias(UNIT)).limit(1)

    def needed(self) -> set[str]:
        """Variables that something besides their own atom reads."""
        rule = self.rule
        out = {v for a in rule.head.args for v in (a.expr if isinstance(a, Agg) else a).variables()}
        out |= {v for p in [*rule.compares(), *rule.negated()] for v in p.variables()}
        out |= {a.name for c in rule.calls() for a in c.args if isinstance(a, Var)}
        seen: set[str] = set()
        for a in self.atoms:
            out |= seen & set(a.variables())
            seen |= set(a.variables())
        return out

    def body(self, source: Callable[[Atom, int], DataFrame], first: int | None = None, keep_all: bool = False) -> DataFrame:
        """All solutions of the body, as variable columns.  ``first`` is the atom to begin with, if one is small."""
        rule = self.rule
        keep = {v for a in self.atoms for v in a.variables()} if keep_all else self.needed()
        order = join_order([set(a.variables()) & keep for a in self.atoms], first, self.structural)
        images = [self.image(a, source(a, k), keep) for k, a in enumerate(self.atoms)]
        if self.sip:
            images = self._reduced(images, order, keep)
        negated = [(a, self.image(Atom(a.relation, a.args), source(a, -1), set(a.variables()))) for a in rule.negated()]
        compares = list(rule.compares())
        calls = list(rule.calls())
        df, bound = None, set()
        waiting = {v for c in calls if c.target for v in [c.target]}
        for n, k in enumerate(order):
            mine = set(self.atoms[k].variables()) & keep
            if df is None:
                df = images[k]
            else:
                on = [self.column[v] for v in sorted(mine & bound, key=lambda v: self.column[v])]
                if on:
                    df, images[k] = self._dealt(df, on), self._dealt(images[k], on)
                if not mine or mine <= bound:  # restricts only
                    df = df.join(images[k], on, "left_semi") if on else df.crossJoin(images[k].withColumnRenamed(UNIT, f"{UNIT}{n}")).drop(f"{UNIT}{n}")
                else:
                    df = df.join(images[k], on, "inner") if on else df.crossJoin(images[k])
            bound |= mine
            for c in [c for c in compares if set(c.variables()) <= bound]:
                df = df.where(self.compare(c))
                compares.remove(c)
            for a, other in [x for x in negated if set(x[0].variables()) <= bound]:
                on = [self.column[v] for v in a.variables()]
                df = self._dealt(df, on).join(self._dealt(other, on), on, "left_anti") if on else df.join(other, on, "left_anti")
                negated.remove((a, other))
            if n + 1 < len(order):  # a filter that can be tested now spares later joins; if it faults, the row stays
                for c in calls:
                    names = {a.name for a in c.args if isinstance(a, Var)}
                    if c.target is None and names and names <= bound - waiting and names & mine:
                        df = df.where(self._call(c, lenient=True))
        for c in calls:
            df = df.withColumn(self.column[c.target], self._call(c)).where(F.col(self.column[c.target]).isNotNull()) if c.target else df.where(self._call(c))
        for c in compares:
            df = df.where(self.compare(c))
        return df.where(F.lit(False)) if rule.never() else df

    def _dealt(self, df: DataFrame, on: list[str]) -> DataFrame:
        return df.repartition(self.tasks, *on) if self.tasks else df

    def _call(self, c, lenient: bool = False) -> Column:
        f = self.functions[c.function]
        if f.expression is not None:
            return f.column([self.column[a.name] if isinstance(a, Var) else _literal(a.value) for a in c.args], self.rule.number)
        return f.column([self.of(a) for a in c.args], self.rule.number, lenient)

    def _reduced(self, images: list[DataFrame], order: list[int], keep: set[str]) -> list[DataFrame]:
        """Sideways information passing: a forward and a backward sweep of semi joins between neighbours."""
        images, vars_of = list(images), [set(a.variables()) & keep for a in self.atoms]
        for sweep in (order, order[::-1]):
            for a, b in zip(sweep, sweep[1:], strict=False):
                shared = sorted(vars_of[a] & vars_of[b])
                if shared:
                    names = [self.column[v] for v in shared]
                    images[b] = images[b].join(images[a].select(*names), names, "left_semi")
        return images

    def head(self, body: DataFrame) -> DataFrame:
        """Head rows, the aggregate's argument in its place; not yet distinct."""
        args = [self.expression(a.expr if isinstance(a, Agg) else a) for a in self.rule.head.args]
        return body.select(*[a.alias(f"c{k}") for k, a in enumerate(args)]) if args else body.select(F.lit(1).alias(UNIT))

    def rows(self, source: Callable[[Atom, int], DataFrame], first: int | None = None) -> DataFrame:
        out = self.head(self.body(source, first))
        return out if self.rule.negated() else self._dealt(out, out.columns)

    def pair(self) -> tuple[set[str], set[str], set[str]] | None:
        """Of two atoms joined on variables of which the head drops some: each one's other variables, and the shared ones."""
        if len(self.atoms) != 2 or self.rule.calls() or self.rule.never():
            return None
        a, b = (set(x.variables()) & self.needed() for x in self.atoms)
        head = {v for x in self.rule.head.args for v in (x.expr if isinstance(x, Agg) else x).variables()}
        return (a - b, b - a, a & b) if a & b and not a & b <= head else None

    def sizes(self, source: Callable[[Atom, int], DataFrame]) -> tuple[float, float]:
        """Rows that both atoms of a pair read, and rows that their join makes."""
        keys, given = [self.column[v] for v in sorted(self.pair()[2])], [source(x, k) for k, x in enumerate(self.atoms)]
        images = [self.image(x, g, self.needed()).select(*keys) for x, g in zip(self.atoms, given, strict=True)]
        both = images[0].select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).union(images[1].select(*keys, F.lit(0), F.lit(1)))
        tasks = sum(g.count() for g in given) // COUNTED + 1
        dealt = both.repartition(tasks, *keys) if tasks > 8 else both
        n = dealt.groupBy(*keys).agg(*[F.sum(c).cast("double").alias(c) for c in "lr"]).agg(F.sum("l"), F.sum("r"), F.sum(F.col("l") * F.col("r"))).first()
        return (n[0] or 0) + (n[1] or 0), n[2] or 0

    def spreads(self) -> bool:
        """Whether ``spread`` gives the rule's rows: a pair whose head is just both atoms' own variables."""
        a, b, shared = self.pair()
        head = [x.first if isinstance(x, Expr) and not x.rest else None for x in self.rule.head.args]
        if not a or not b or self.rule.negated() or not all(isinstance(x, Var) for x in head):
            return False
        return {x.name for x in head} == a | b and not any(set(c.variables()) & shared for c in self.rule.compares())

    def spread(self, source: Callable[[Atom, int], DataFrame], pairs: float) -> DataFrame:
        """The head's rows, each once, without comparing them, where few keys join many rows.

        The pairs of a key are cut into cells of SIDE rows by SIDE rows, dealt over all tasks.  Two rows meet once at
        most if one of them has a single key; only what is left of the others is made distinct."""
        *own, shared = self.pair()
        keys, tasks = [self.column[v] for v in sorted(shared)], int(pairs // PAIRS) + 1
        own = [[self.column[v] for v in sorted(x)] for x in own]
        sides = []
        for k, atom in enumerate(self.atoms):
            rows = self.image(atom, source(atom, k), self.needed()).distinct()
            sides.append(rows.withColumn(f"one{k}", F.count(F.lit(1)).over(Window.partitionBy(*own[k])) == 1))
        counts = [x.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("bigint").alias(f"n{k}")) for k, x in enumerate(sides)]
        cells_of = counts[0].join(counts[1], keys)

        def pieces(rows: DataFrame, k: int) -> DataFrame:
            mine, other = F.pmod(F.xxhash64(*own[k]), F.col(f"n{k}")), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"n{1 - k}") - 1))
            cut = rows.join(cells_of, keys).withColumn(f"p{k}", mine).withColumn(f"p{1 - k}", other)
            return cut.drop("n0", "n1").repartition(tasks, *keys, "p0", "p1")

        def met(a: DataFrame, b: DataFrame) -> DataFrame:
            df = pieces(a, 0).hint("merge").join(pieces(b, 1), [*keys, "p0", "p1"])
            for c in self.rule.compares():
                df = df.where(self.compare(c))
            return df

        left, right = sides
        once = self.head(met(left, right).where("one0 or one1"))
        return once.union(self.head(met(left.where("not one0"), right.where("not one1"))).distinct())

    def strict(self) -> bool:
        """Whether a value that nobody reads must be computed all the same, because it may fault."""
        return bool(self.rule.calls()) or any((a.expr if isinstance(a, Agg) else a).can_fault() for a in self.rule.head.args)


def aggregate(rows: DataFrame, position: int, op: str, arity: int, sets: bool = False) -> DataFrame:
    """One row per key from distinct head rows (``sets``: they are); a global aggregate of no rows is no row."""
    value = f"c{position}"
    keys = [c for c in cells(arity) if c != value]
    rows = rows.distinct() if op in ("count", "sum") and not sets else rows
    how = {"count": F.count(F.lit(1)), "sum": F.sum(value), "min": F.min(value), "max": F.max(value)}[op].alias(value)
    if keys:
        return rows.groupBy(*keys).agg(how).select(*cells(arity))
    return rows.groupBy(F.lit(1).alias(UNIT)).agg(how).select(value)
