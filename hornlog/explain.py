"""One-step provenance: which rule derives a row, from which rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lang.ast import Agg, Program, Rule
from .operators.context import wrapping
from .operators.rules import RulePlan, cells, constant

MOST_PARENTS = 256


class Explainer:
    def __init__(self, spark, program: Program, states: dict[str, DataFrame]):
        self.spark, self.program, self.states = spark, program, states

    def witness(self, relation: str, row: list) -> dict:
        decl = self.program.decls.get(relation)
        out = {"relation": relation, "row": list(row), "present": False, "input": bool(decl and decl.role == "in"), "parents": []}
        df = self.states.get(relation)
        if df is None or len(row) != len(self.program.types[relation]):
            return out
        if df.where(self._same(list(row))).limit(1).isEmpty():
            return out
        out["present"] = True
        for rule in self.program.rules:
            if rule.head.relation == relation and (found := self._by(rule, list(row))) is not None:
                out.update(rule=rule.number, rule_text=str(rule), line=rule.line, **found)
                break
        return out

    @staticmethod
    def _same(row: list, skip: int | None = None):
        tests = [F.col(f"c{k}") == constant(v) for k, v in enumerate(row) if k != skip]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def _by(self, rule: Rule, row: list) -> dict | None:
        plan, shape = RulePlan(rule, self.program.functions), rule.head.aggregate()
        with wrapping(self.spark):
            body = plan.body(lambda a, _: self.states[a.relation], keep_all=True)
            values = [plan.expression(a.expr if isinstance(a, Agg) else a).alias(f"c{k}") for k, a in enumerate(rule.head.args)]
            solutions = body.select("*", *values).where(self._same(row, shape[0] if shape else None))
            solutions = solutions.distinct()
            if shape is None:
                found = solutions.limit(1).collect()
                return {"parents": self._parents(rule, plan, found)} if found else None
            value, op = f"c{shape[0]}", shape[1].op
            how = {"count": F.count_distinct(value), "sum": F.sum_distinct(F.col(value)), "min": F.min(value), "max": F.max(value)}[op]
            total = solutions.agg(how.alias("value"), F.count(F.lit(1)).alias("n")).first()
            if not total["n"] or total["value"] != row[shape[0]]:
                return None
            best = solutions.where(F.col(value) == constant(total["value"])) if op in ("min", "max") else solutions
            found = best.orderBy(*[c for c in best.columns]).limit(MOST_PARENTS).collect()
            return {"parents": self._parents(rule, plan, found), "group_size": total["n"]}

    def _parents(self, rule: Rule, plan: RulePlan, solutions: list) -> list[dict]:
        out = []
        for s in solutions:
            known = s.asDict()
            for atom in plan.atoms:
                wanted = [known[plan.column[a.name]] if hasattr(a, "name") else getattr(a, "value", None) for a in atom.args]
                if any(v is None for v in wanted):  # wildcards: any matching row
                    tests = [F.col(f"c{k}") == constant(v) for k, v in enumerate(wanted) if v is not None]
                    match = self.states[atom.relation].where(reduce(lambda a, b: a & b, tests, F.lit(True))).orderBy(*cells(len(wanted))).limit(1).collect()
                    wanted = [match[0][f"c{k}"] for k in range(len(wanted))]
                parent = {"relation": atom.relation, "row": wanted}
                if parent not in out:
                    out.append(parent)
        return out
