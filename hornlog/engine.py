"""The engine: check and evaluate programs over a Spark session."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .explain import Explainer
from .functions.blocks import read_blocks
from .functions.symbols import symbol_id
from .lang.ast import Program
from .lang.diagnostics import Diagnostic
from .lang.parser import parse
from .lang.validate import validate
from .operators.context import Evaluation, Limits, wrapping
from .operators.fixpoint import Interpreter
from .plans.stratify import Stratum, stratify
from .sources.facts import from_frames, from_rows, read_directory


@dataclass
class EngineConfig:
    opt_level: int = 0  # 1 sideways information passing, 2 structural join order, 3 both
    sharing: bool = True  # relations with several readers are computed once
    max_concurrent: int = 4
    delimiter: str = ","
    max_rounds: int = 1_000_000


@dataclass
class EvaluationOptions:
    budget_seconds: float | None = None
    tuple_limit: int | None = None
    memory_limit_bytes: int | None = None
    cancel: threading.Event | None = None
    explain: list[tuple[str, list]] = field(default_factory=list)
    explain_all: bool = False
    profile_path: str | None = None


@dataclass
class Result:
    program: Program
    relations: dict[str, DataFrame]
    stats: dict
    witnesses: list[dict] = field(default_factory=list)
    sizes: dict[str, int] = field(default_factory=dict)
    states: dict[str, DataFrame] = field(default_factory=dict)  # the relations with columns c0, c1, ...

    def declared(self) -> dict[str, DataFrame]:
        return {d.name: self.relations[d.name] for d in self.program.outputs() if d.name in self.relations}

    def rows(self, name: str) -> list[tuple]:
        """A relation's rows, sorted; for results that fit the driver."""
        return sorted(tuple(r) if self.program.types[name] else () for r in self.relations[name].collect())


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self._slots = threading.Semaphore(self.config.max_concurrent)
        self._lock = threading.Lock()
        self._running = self._completed = 0

    def prepare(self, text: str, name: str = "program") -> tuple[Program, list[Stratum]]:
        program = parse(text, name)
        program.functions = read_blocks(program)
        return validate(program), stratify(program)

    def check(self, text: str, name: str = "program") -> dict:
        """Everything short of evaluation."""
        program, strata = self.prepare(text, name)
        heads = set(program.heads())
        return {
            "relations": [
                {
                    "name": n, "columns": t, "derived": n in heads,
                    "input": n in program.decls and program.decls[n].role == "in", "output": n in program.decls and program.decls[n].role == "out",
                }
                for n, t in sorted(program.types.items())
            ],
            "rules": len(program.rules), "strata": len(strata), "recursive_strata": sum(s.recursive for s in strata),
            "functions": [f.signature() for f in program.functions.values()],
        }

    def query(self, text: str, frames: dict[str, DataFrame], name: str = "program") -> dict[str, DataFrame]:
        """Relations as lazy DataFrames under their declared names; only loops and faulting heads run now."""
        program, strata = self.prepare(text, name)
        run = Evaluation(self.spark, program, Limits(), self.config.max_rounds)
        with run.watched():
            states = self._interpret(run, program, strata, from_frames(program, frames)).states
        return self._named(program, states)

    def evaluate(self, text: str, rows: dict | None = None, frames: dict[str, DataFrame] | None = None, facts: str | None = None, options: EvaluationOptions | None = None, name: str = "program") -> Result:
        """Every relation's final state, computed in full: inputs are rows, DataFrames or a directory of fact files."""
        options = options or EvaluationOptions()
        began = time.monotonic()
        program, strata = self.prepare(text, name)
        limits = Limits(options.budget_seconds, options.tuple_limit, options.memory_limit_bytes, options.cancel or threading.Event())
        with self._slots:
            with self._lock:
                self._running += 1
            try:
                run = Evaluation(self.spark, program, limits, self.config.max_rounds, options.profile_path)
                with run.watched():
                    given = from_frames(program, frames or {})
                    if facts is not None:
                        given = read_directory(self.spark, program, facts, self.config.delimiter) | given
                    given |= from_rows(self.spark, program, rows or {})
                    planned = time.monotonic()
                    run.phase = "evaluating"
                    inter = self._interpret(run, program, strata, given)
                    states = inter.states
                    executed = time.monotonic()
                    run.phase = "settling"
                    sizes = {}
                    for relation in sorted(states):
                        if relation in program.heads():
                            if relation not in inter.written:
                                states[relation] = run.cut(states[relation])
                            sizes[relation] = states[relation].count()
                            run.count(sizes[relation])
                    settled = time.monotonic()
                    witnesses = self._explain(program, states, options)
            finally:
                with self._lock:
                    self._running -= 1
                    self._completed += 1
        micros = lambda a, b: int((b - a) * 1e6)
        stats = {
            "strata": len(strata), "rules": len(program.rules), "rounds": run.rounds, "planning_micros": micros(began, planned), "execution_micros": micros(planned, executed),
            "settle_micros": micros(executed, settled), "total_micros": micros(began, time.monotonic()), "materialized_rows": run.tuples,
        }
        if options.profile_path:
            run.profile("done", sizes=sizes, stats=stats)
        return Result(program, self._named(program, states), stats, witnesses, sizes, states)

    def _interpret(self, run: Evaluation, program: Program, strata: list[Stratum], given: dict[str, DataFrame]) -> Interpreter:
        inter = Interpreter(run, program, given, self.config.opt_level, self.config.sharing)
        for decl in program.inputs():
            inter.state(decl.name)
        for rule in program.rules:
            for relation in rule.reads():
                if relation not in program.heads():
                    inter.state(relation)
        inter.evaluate(strata)
        return inter

    def _named(self, program: Program, states: dict[str, DataFrame]) -> dict[str, DataFrame]:
        heads = set(program.heads())
        with wrapping(self.spark):
            sets = {n: df if n in heads else df.distinct() for n, df in states.items()}
            return {n: df.toDF(*program.columns(n)) if program.types[n] else df for n, df in sets.items()}

    def _explain(self, program: Program, states: dict[str, DataFrame], options: EvaluationOptions) -> list[dict]:
        explainer = Explainer(self.spark, program, states)
        asked = [(n, list(r)) for n, r in options.explain]
        if options.explain_all:
            for d in program.outputs():
                if d.name in states:
                    asked += [(d.name, list(r) if program.types[d.name] else []) for r in states[d.name].toLocalIterator()]
        return [explainer.witness(n, r) for n, r in asked]

    def explain(self, result: Result, asked: list[tuple[str, list]]) -> list[dict]:
        """Witnesses of rows of a result, which need not be known before it is evaluated."""
        return self._explain(result.program, result.states, EvaluationOptions(explain=asked))

    def status(self) -> dict:
        with self._lock:
            return {"running": self._running, "completed": self._completed, "max_concurrent": self.config.max_concurrent}

    @staticmethod
    def intern(text: str) -> int:
        return symbol_id(text)
