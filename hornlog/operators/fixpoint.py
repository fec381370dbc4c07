"""Strata, one after another; recursive ones by semi-naive rounds.

A round derives rows only from rows that the last round added: each rule runs
once for each of its recursive atoms, with that atom reading the new rows, atoms
before it everything and atoms after it everything but the new rows.  What is
new is checkpointed, so the plan of a round never grows; everything so far is
kept as a list of parts that is compacted now and then.  Once that is large, a round
with few candidates looks them up in it by a broadcast, instead of shuffling it all.

A closure by one linear rule over two columns is squared: round k joins what is
reached so far with the pairs that are 2**k steps apart, so a chain of n steps takes
log n rounds.  A closure by R(x, y), R(y, z) is one by a linear rule.  Where degrees tell that squaring would derive many times more rows
than it keeps, as in dense graphs, the loop goes on step by step.

Before all that, loops over pairs of numbers are evaluated apart for each connected part
of their relations that fits one task (``local``); the rounds get the rows of the others.
"""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang.ast import Agg, Atom, Expr, Program, Rule, Var
from ..lang.diagnostics import Diagnostic, Location
from ..plans.stratify import Stratum
from . import local
from .context import Evaluation, wrapping
from .rules import RulePlan, aggregate, cells

COMPACT_EVERY = 8
#: Rows so far from which on candidates are looked up by a broadcast, and candidates that are broadcast at most.
LARGE, FEW = 5_000_000, 200_000
#: Squaring stops where a round would derive more rows than SQUARES for each row so far, and SPARE besides.
SQUARES, SPARE = 6, 1_000_000
#: A join is spread where it makes more rows than SPREAD for each row read, and SPARE besides; rows of a task of other joins, at most about.
SPREAD, TASK_ROWS = 16, 1_000_000


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


class Interpreter:
    """States of all relations, as DataFrames of c0, c1, ..."""

    def __init__(self, run: Evaluation, program: Program, facts: dict[str, DataFrame], optimize: int, share: bool):
        self.run, self.program, self.optimize, self.share = run, program, optimize, share
        self.spark = run.spark
        self.states: dict[str, DataFrame] = dict(facts)
        self.given = set(facts)  # may still hold a row twice
        self.raw: dict[str, DataFrame] = {}  # head rows of aggregated relations, before aggregation
        self.facts_of: dict[str, DataFrame] = {}  # given rows of aggregated relations
        self.written: set[str] = set()  # relations whose rows are read from written tables
        self.readers: dict[str, int] = {}
        for r in program.rules:
            for a in [*r.atoms(), *r.negated()]:
                self.readers[a.relation] = self.readers.get(a.relation, 0) + 1
        self.shape = {r.head.relation: r.head.aggregate() for r in program.rules}

    def arity(self, name: str) -> int:
        return len(self.program.types[name])

    def empty(self, name: str) -> DataFrame:
        kinds = ["bigint" if t == "number" else "string" for t in self.program.types[name]] or ["int"]
        return self.spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in zip(cells(self.arity(name)), kinds, strict=True)))

    def state(self, name: str) -> DataFrame:
        if name not in self.states:
            self.states[name] = self.empty(name)
        return self.states[name]

    def _cut(self, name: str) -> DataFrame:
        """The relation, a set, as a written table."""
        if name in self.written:
            return self.state(name)
        return self.run.cut(self.state(name).distinct() if name in self.given else self.state(name))

    def evaluate(self, strata: list[Stratum]) -> None:
        for stratum in strata:
            self.run.check()
            if stratum.recursive:
                self._recursive(stratum)
            else:
                self._plain(stratum)

    def plan(self, rule: Rule) -> RulePlan:
        return RulePlan(rule, self.program.functions, self.optimize)

    def _keeps_rows(self, rule: Rule) -> bool:
        """Whether the head rows are distinct because they keep all columns of one derived relation, which is a set."""
        atoms, kept = rule.atoms(), [a.expr if isinstance(a, Agg) else a for a in rule.head.args]
        if len(atoms) != 1 or atoms[0].relation not in self.shape or rule.calls() or not all(isinstance(x, Var) for x in atoms[0].args):
            return False
        return len(set(atoms[0].args)) == len(atoms[0].args) and set(atoms[0].args) <= {e.first for e in kept if not e.rest}

    def _settled(self, name: str, new: list[DataFrame], sets: bool = False) -> DataFrame:
        """The relation after new head rows (``sets``: all distinct): a set, aggregated over the union of all its rules' rows."""
        shape = self.shape[name]
        if shape:
            sets = sets and name not in self.raw
            rows = _union([self.raw[name], *new] if name in self.raw else new)
            self.raw[name] = rows
            out = aggregate(rows, shape[0], shape[1].op, self.arity(name), sets)
            return out if name not in self.facts_of else out.union(self.facts_of[name]).distinct()
        if sets and name not in self.states:
            return new[0]
        return _union([self.states[name], *new] if name in self.states else new).distinct()

    def _plain(self, stratum: Stratum) -> None:
        heads: dict[str, list[Rule]] = {}
        for r in stratum.rules:
            heads.setdefault(r.head.relation, []).append(r)
        out = {}
        for name, rules in heads.items():
            began, strict, parts = time.monotonic(), False, []
            if self.shape[name] and name in self.states and name not in self.raw and name not in self.facts_of:
                self.facts_of[name] = self.states[name]
            with wrapping(self.spark):
                for r in rules:
                    plan = self.plan(r)
                    strict |= plan.strict()
                    rows, sets = self._once(plan)
                    parts.append(rows)
                df = self._settled(name, parts, len(rules) == 1 and (sets or self._keeps_rows(rules[0])))
            self.written.discard(name)
            if strict or (self.share and self.readers.get(name, 0) > 1):
                df = self.run.cut(df)
                self.written.add(name)
            out[name] = df
            for r in rules:
                self.run.rule_seconds[r.number] = self.run.rule_seconds.get(r.number, 0) + (time.monotonic() - began) / len(rules)
        self.states.update(out)

    def _once(self, plan: RulePlan) -> tuple[DataFrame, bool]:
        """A rule's rows, and whether they are distinct; a join of given tables is counted first, to deal it over enough tasks."""

        def source(a: Atom, k: int) -> DataFrame:
            return self.state(a.relation)

        if plan.pair() and all(a.relation not in self.shape for a in plan.atoms):
            given, pairs = plan.sizes(source)
            if plan.spreads() and pairs > SPREAD * given + SPARE:
                return plan.spread(source, pairs), True
            tasks = int(max(given, pairs) // TASK_ROWS) + 1
            if tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
                plan.tasks = tasks
        return plan.rows(source), False

    def _recursive(self, stratum: Stratum) -> None:
        heads = list(dict.fromkeys(r.head.relation for r in stratum.rules))
        shapes = {h: self.shape[h] for h in heads}
        if any(s and s[1].op in ("count", "sum") for s in shapes.values()):
            self._naive(stratum, heads)
            return
        stratum, given = self._one_sided(stratum)
        full: dict[str, list[DataFrame]] = {h: [self._cut(h)] for h in heads}
        old = {h: self.empty(h) for h in heads}
        delta = {h: full[h][0] for h in heads}
        rows = {h: delta[h].count() for h in heads}
        alive = {h: rows[h] > 0 for h in heads}
        fixed: dict[str, DataFrame] = {given: full[heads[0]][0]} if given else {}

        def whole(h: str) -> DataFrame:
            """All rows of a relation so far; of an aggregated one each key's best."""
            parts = _union(full[h])
            return aggregate(parts, shapes[h][0], shapes[h][1].op, self.arity(h)) if shapes[h] and len(full[h]) > 1 else parts

        def constant(name: str) -> DataFrame:
            """What the loop reads but does not change is computed once."""
            if name not in fixed:
                fixed[name] = self.state(name) if name in self.written else self.run.cut(self.state(name))
            return fixed[name]

        for a in {a.relation for r in stratum.rules for a in [*r.atoms(), *r.negated()]} - set(heads):
            constant(a)
        apart: dict[str, list[DataFrame]] = {h: [] for h in heads}  # rows that the rounds below need not see
        if any(alive.values()) and (found := local.numbered(stratum.rules, heads, self.program)):
            self._round()
            tables = {n: full[n][0] if n in full else constant(n) for n in found[1]}
            rest = self._apart(*found, tables, apart)
            for h in heads:
                full[h] = [rest[h]] if rest else [self.empty(h)]
                delta[h] = full[h][0]
                rows[h] = delta[h].count() if rest else 0
                alive[h] = rows[h] > 0
            fixed.update({n: df for n, df in (rest or {}).items() if n not in heads})
        if any(alive.values()) and (linear := self._linear(stratum)):
            full[heads[0]], ended = self._square(full[heads[0]], constant(linear[0]), linear[1])
            alive[heads[0]] = not ended
            if not ended:  # everything so far may have unseen successors
                delta[heads[0]] = _union(full[heads[0]])
                rows[heads[0]] = delta[heads[0]].count()
        while any(alive.values()):
            self._round()
            produced: dict[str, list[DataFrame]] = {h: [] for h in heads}
            with wrapping(self.spark):
                everything = {h: whole(h) for h in heads}
                for r in stratum.rules:
                    plan = self.plan(r)
                    recursive = [k for k, a in enumerate(plan.atoms) if a.relation in shapes]
                    for i in recursive:
                        if not alive[plan.atoms[i].relation]:
                            continue

                        def source(a: Atom, k: int, i: int = i) -> DataFrame:
                            if a.relation not in shapes or k < 0:
                                return constant(a.relation)
                            if k == i:
                                return delta[a.relation]
                            return everything[a.relation] if k < i or shapes[a.relation] else old[a.relation]

                        produced[r.head.relation].append(plan.rows(source, i))
            fresh: dict[str, DataFrame] = {}
            for h in heads:
                if produced[h]:
                    with wrapping(self.spark):
                        fresh[h] = self._better(h, produced[h], everything[h]) if shapes[h] else self._new(h, produced[h], everything[h], rows[h])
            old = everything
            for h in heads:
                n = fresh[h].count() if h in fresh else 0
                alive[h] = n > 0
                if not alive[h]:
                    continue
                delta[h] = fresh[h]
                full[h].append(fresh[h])
                rows[h] += n
                if len(full[h]) > COMPACT_EVERY:
                    with wrapping(self.spark):
                        full[h] = [self.run.cut(whole(h))]
        for h in heads:
            with wrapping(self.spark):
                self.states[h] = _union([whole(h), *apart[h]] if rows[h] or not apart[h] else apart[h])
            if shapes[h]:
                self.raw[h] = self.states[h]
            else:
                self.written.add(h)

    def _new(self, name: str, produced: list[DataFrame], everything: DataFrame, n: int) -> DataFrame:
        """What of the head rows is not in ``everything``, which has n rows."""
        names, found = cells(self.arity(name)), _union(produced).distinct()
        if n >= LARGE:
            found = self.run.cut(found)
            if found.count() <= FEW:
                known = everything.join(F.broadcast(found), names, "left_semi")
                return self.run.cut(found.join(F.broadcast(known), names, "left_anti"))
        return self.run.cut(found.join(everything, names, "left_anti"))

    def _better(self, name: str, produced: list[DataFrame], everything: DataFrame) -> DataFrame:
        """Aggregated head rows (min or max) whose value betters their key's."""
        position, agg = self.shape[name]
        value, names = f"c{position}", cells(self.arity(name))
        keys = [c for c in names if c != value]
        best = aggregate(_union(produced), position, agg.op, len(names))
        if not keys:
            return self.run.cut(aggregate(best.union(everything), position, agg.op, len(names)).join(everything, names, "left_anti"))
        known = everything.withColumnRenamed(value, "known")
        wins = F.col(value) < F.col("known") if agg.op == "min" else F.col(value) > F.col("known")
        return self.run.cut(best.join(known, keys, "left").where(F.col("known").isNull() | wins).select(*names))

    def _apart(self, rules: list[local.Numbered], names: list[str], tables: dict[str, DataFrame], apart: dict[str, list[DataFrame]]) -> dict[str, DataFrame] | None:
        """Fills ``apart`` with what holds for connected parts that one task can evaluate; returns the tables' other rows, if any."""
        known = [tables[n].where("c0 is not null and c1 is not null").select(F.lit(k).alias("k"), F.col("c0").alias("a"), F.col("c1").alias("b")) for k, n in enumerate(names)]
        heads = list(apart)
        n = sum(tables[x].count() for x in names)
        small, large = local.parts(self.run, _union(known), n)
        new = local.added(self.run, small, n, rules, len(heads))

        def of(df: DataFrame, k: int) -> DataFrame:
            return df.where(F.col("k") == k).select(F.col("a").alias("c0"), F.col("b").alias("c1"))

        for k, h in enumerate(heads):
            apart[h] += [of(new, k), tables[h] if large is None else of(small, k).union(tables[h].where("c0 is null or c1 is null"))]
        return None if large is None else {x: self.run.cut(of(large, k)) for k, x in enumerate(names)}

    def _one_sided(self, stratum: Stratum) -> tuple[Stratum, str | None]:
        """R(x, z) :- R(x, y), R(y, z) derives what R(x, z) :- R(x, y), G(y, z) does, where G, named too, is R before the loop."""
        rule = stratum.rules[0]
        name, atoms = rule.head.relation, rule.atoms()
        if len(stratum.rules) == 1 and len(atoms) == 2 and all(a.relation == name for a in atoms):
            given = f"{name} given"  # no relation of a program has a space in its name
            body = [replace(p, relation=given) if p is atoms[1] else p for p in rule.body]
            once = Stratum([replace(rule, body=body)], True)
            if self._linear(once) == (given, True):
                return once, given
        return stratum, None

    def _linear(self, stratum: Stratum) -> tuple[str, bool] | None:
        """(E, whether the rule is R(x, z) :- R(x, y), E(y, z)) if that, or its mirror image, is all the stratum has."""
        if len(stratum.rules) != 1:
            return None
        rule = stratum.rules[0]
        name, atoms = rule.head.relation, rule.atoms()
        if self.shape[name] or len(rule.body) != 2 or len(atoms) != 2 or self.arity(name) != 2 or sum(a.relation == name for a in atoms) != 1:
            return None
        a, b = atoms if [x.name for x in atoms[0].args if isinstance(x, Var)][-1:] == [x.name for x in atoms[1].args if isinstance(x, Var)][:1] else atoms[::-1]
        args = [*a.args, *b.args, *rule.head.args]
        args = [x.first if isinstance(x, Expr) and not x.rest else x for x in args]
        if len(args) != 6 or not all(isinstance(x, Var) for x in args):
            return None
        x, y, y2, z, hx, hz = (v.name for v in args)
        if y != y2 or len({x, y, z}) != 3 or (hx, hz) != (x, z):
            return None
        return (b.relation, True) if a.relation == name else (a.relation, False)

    def _square(self, full: list[DataFrame], steps: DataFrame, right: bool) -> tuple[list[DataFrame], bool]:
        """Rows with all paths of up to 2**k steps, for growing k; and whether that is all, or dense graphs ask to go on step by step."""
        names, power = ["c0", "c1"], steps

        def then(a: DataFrame, b: DataFrame) -> DataFrame:
            a, b = a.select(F.col("c0"), F.col("c1").alias("y")).where("y is not null"), b.select(F.col("c0").alias("y"), "c1")
            return a.join(b, "y").select(*names).distinct()

        while True:
            reached = _union(full)
            one, none = F.lit(1), F.lit(0)
            ends = reached.select(F.col("c1" if right else "c0").alias("y"), one.alias("r"), none.alias("o"), none.alias("i"))
            ends = ends.union(power.select("c0", none, one, none)).union(power.select("c1", none, none, one)).groupBy("y").agg(*[F.sum(x).cast("double").alias(x) for x in "roi"])
            size = ends.agg(F.sum(F.col("r") * F.col("o" if right else "i")).alias("derived"), F.sum(F.col("o") * F.col("i")).alias("squared"), F.sum("r").alias("rows")).first()
            most = SQUARES * (size["rows"] or 0) + SPARE
            if not size["derived"]:
                return full, True
            if size["derived"] > most or size["squared"] > most:
                return full, False
            self._round()
            new = self.run.cut(then(reached, power).join(reached, names, "left_anti") if right else then(power, reached).join(reached, names, "left_anti"))
            if new.isEmpty():
                return full, True
            full.append(new)
            power = self.run.cut(then(power, power))

    def _naive(self, stratum: Stratum, heads: list[str]) -> None:
        """Counts and sums in a loop: everything anew from the last states until nothing changes."""
        base = {h: self.raw.get(h, None) for h in heads}
        start = {h: self.run.cut(self.state(h)) for h in heads}
        states = dict(start)
        while True:
            self._round()
            now, changed = {}, False
            for h in heads:
                with wrapping(self.spark):
                    rows = [self.plan(r).rows(lambda a, k: states.get(a.relation, None) if a.relation in states and k >= 0 else self.state(a.relation)) for r in stratum.rules if r.head.relation == h]
                    if self.shape[h]:
                        rows = _union([base[h], *rows] if base[h] is not None else rows)
                        df = aggregate(rows, self.shape[h][0], self.shape[h][1].op, self.arity(h))
                    else:
                        df = _union([start[h], *rows]).distinct()
                now[h] = self.run.cut(df)
                names = cells(self.arity(h))
                changed |= not now[h].join(states[h], names, "left_anti").isEmpty() or not states[h].join(now[h], names, "left_anti").isEmpty()
            states = now
            if not changed:
                break
        self.states.update(states)

    def _round(self) -> None:
        self.run.check()
        self.run.rounds += 1
        if self.run.rounds > self.run.max_rounds:
            raise Diagnostic("resource", f"no fixed point after {self.run.max_rounds} rounds", Location(self.program.name, 0))
