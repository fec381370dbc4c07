"""The session, its settings, checkpoints and limits during one evaluation."""

from __future__ import annotations

import json
import os
import re
import tempfile
import threading
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.blocks import FAULT
from ..lang.ast import Program
from ..lang.diagnostics import Diagnostic, Location

_MODE = threading.RLock()


@contextmanager
def wrapping(spark: SparkSession):
    """Expressions built inside wrap on overflow; the mode sticks to them, so it is restored at once."""
    with _MODE:
        before = spark.conf.get("spark.sql.ansi.enabled")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        try:
            yield
        finally:
            spark.conf.set("spark.sql.ansi.enabled", before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where none is named and the master is local."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise Diagnostic("resource", "spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="hornlog-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@dataclass
class Limits:
    budget_seconds: float | None = None
    tuple_limit: int | None = None
    memory_limit_bytes: int | None = None
    cancel: threading.Event = field(default_factory=threading.Event)


class Evaluation:
    """One run: cuts lineage, watches limits, turns faults into diagnostics."""

    def __init__(self, spark: SparkSession, program: Program, limits: Limits, max_rounds: int, profile_path: str | None = None):
        self.spark, self.program, self.limits, self.max_rounds, self.profile_path = spark, program, limits, max_rounds, profile_path
        self.phase = "planning"
        self.began = time.monotonic()
        self.tag = f"hornlog-{uuid.uuid4().hex}"
        self.over: str | None = None
        self.tuples = 0
        self.rule_seconds: dict[int, float] = {}
        self.rounds = 0
        self.cuts = 0
        self._done = threading.Event()

    @contextmanager
    def watched(self):
        """Jobs inside carry a tag; crossing the time budget or a cancellation interrupts them."""
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        watcher = threading.Thread(target=self._watch, daemon=True)
        watcher.start()
        try:
            yield
        except Diagnostic:
            raise
        except Exception as e:
            raise self.diagnose(e) from e
        finally:
            self._done.set()
            context.removeJobTag(self.tag)

    def _watch(self) -> None:
        written = 0.0
        while not self._done.wait(0.05):
            if self._crossed():
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
            if self.profile_path and time.monotonic() - written >= 0.5:
                written = time.monotonic()
                self.profile(self.phase)

    def profile(self, phase: str, **more) -> None:
        """Rewrite the profile file: phase, rounds, and rules by the seconds spent on them."""
        seconds = dict(self.rule_seconds)
        rules = [{"rule": str(self.program.rules[k]), "line": self.program.rules[k].line, "seconds": s} for k, s in sorted(seconds.items(), key=lambda x: -x[1])]
        with open(self.profile_path + ".new", "w") as f:
            json.dump({"phase": phase, "rounds": self.rounds, "elapsed": time.monotonic() - self.began, "tuples": self.tuples, "rules": rules} | more, f)
        os.replace(self.profile_path + ".new", self.profile_path)

    def _crossed(self) -> str | None:
        if self.limits.cancel.is_set():
            self.over = "the evaluation was cancelled"
        elif self.limits.budget_seconds is not None and time.monotonic() - self.began > self.limits.budget_seconds:
            self.over = f"the time budget of {self.limits.budget_seconds} s is used up"
        elif self.limits.memory_limit_bytes is not None:
            # the driver's own storage is all that can be seen here; executors spill instead of growing
            runtime = self.spark.sparkContext._jvm.Runtime.getRuntime()
            if runtime.totalMemory() - runtime.freeMemory() > self.limits.memory_limit_bytes:
                self.over = "the memory ceiling is crossed"
        return self.over

    def check(self) -> None:
        if self._crossed():
            raise Diagnostic("resource", self.over)

    def count(self, n: int) -> None:
        self.tuples += n
        if self.limits.tuple_limit is not None and self.tuples > self.limits.tuple_limit:
            raise Diagnostic("resource", f"the tuple ceiling of {self.limits.tuple_limit} rows is crossed")

    def cut(self, df: DataFrame) -> DataFrame:
        """The rows as a written table: computed now, once, readable by every executor, and of a size that later joins know."""
        self.check()
        path = f"{shared_folder(self.spark)}/{self.tag}/{self.cuts}"
        self.cuts += 1
        df.write.parquet(path)
        self.check()
        return self.spark.read.schema(df.schema).parquet(path)

    def diagnose(self, error: Exception) -> Diagnostic:
        if self.over:
            return Diagnostic("resource", self.over)
        text = str(error)
        m = re.search(rf"{FAULT}\|(\w+)\|(-?\d+)\|([^|]*)\|(\d*)\|(\d*)\|([^|]*)\|", text)
        if not m:
            return Diagnostic("internal", f"{type(error).__name__}: {text[:500]}")
        kind, number, name, block_line, line, message = m.groups()
        rule = self.program.rules[int(number)] if int(number) >= 0 else None
        place = Location(self.program.name, rule.line) if rule else None
        if kind == "function":
            return Diagnostic(kind, f"function {name} faulted at line {block_line} of its block: {message}", place, str(rule) if rule else None, function=name, detail=f"program line {line}")
        return Diagnostic(kind, message, place, str(rule) if rule else None, [rule.head.relation] if rule else [])
