"""Functions that a program brings along in its .code blocks.

``.code sql`` holds one function a line, ``name(a: int, b: str) -> int = expression``,
which becomes part of the plan.  ``.code python`` holds plain functions with
annotations, run over Arrow batches.
"""

from __future__ import annotations

import ast as pyast
import re
import traceback
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.ast import MAX64, MIN64, Block, Program
from ..lang.diagnostics import Diagnostic, Location

#: Marks a fault's parts inside an exception that comes back from an executor.
FAULT = "deductive-fault"
_SQL = re.compile(r"\s*([A-Za-z_]\w*)\s*\(([^)]*)\)\s*->\s*(\w+)\s*=\s*(.+?)\s*$")
_TYPES = {"int": "bigint", "str": "string", "bool": "boolean"}


@dataclass
class Function:
    name: str
    params: list[str]  # int or str
    result: str  # int, str or bool
    line: int
    names: list[str]
    expression: str | None = None
    source: str | None = None
    block_line: int = 0

    def signature(self) -> str:
        return f"fn {self.name}({', '.join(self.params)}) -> {self.result}"

    def column(self, args: list[str | Column], rule: int, lenient: bool = False) -> Column:
        """The call; arguments are SQL texts for a sql function, columns for a python one.  A lenient call that faults is true."""
        if self.expression is None:
            return _udf(self, rule, lenient)(*args)
        given = dict(zip(self.names, args, strict=True))
        pieces = re.split(r"('(?:[^'\\]|\\.)*')", self.expression)  # text in quotes stays
        pattern = re.compile(rf"(?<![\w.`])({'|'.join(map(re.escape, self.names)) or '(?!)'})(?![\w(])")
        text = "".join(p if k % 2 else pattern.sub(lambda m: given[m[1]], p) for k, p in enumerate(pieces))
        return F.expr(text).cast(_TYPES[self.result])


def _udf(f: Function, rule: int, lenient: bool) -> Callable[..., Column]:
    name, source, wanted, block_line = f.name, f.source, f.result, f.block_line
    held: list[Callable] = []

    def run(*columns: pd.Series) -> pd.Series:
        if not held:
            scope: dict = {"__name__": "block"}
            exec(compile(source, "<block>", "exec"), scope)  # the program's own code, by contract pure
            held.append(scope[name])
        out = []
        for row in zip(*columns, strict=True):
            try:
                value = held[0](*[x if isinstance(x, str) else int(x) for x in row])
                if wanted == "int" and (isinstance(value, bool) or not isinstance(value, int) or not MIN64 <= value <= MAX64):
                    raise TypeError(f"{value!r} is not a 64-bit integer")
                if wanted == "str" and not isinstance(value, str) or wanted == "bool" and not isinstance(value, bool):
                    raise TypeError(f"{value!r} is not of type {wanted}")
            except Exception as e:
                if lenient:
                    out.append(True)
                    continue
                line = next((s.lineno for s in reversed(traceback.extract_tb(e.__traceback__)) if s.filename == "<block>"), 0)
                raise RuntimeError(f"{FAULT}|function|{rule}|{name}|{line}|{block_line + line - 1}|{type(e).__name__}: {e}|") from e
            out.append(value)
        return pd.Series(out, dtype={"int": "int64", "str": "object", "bool": "bool"}[wanted])

    udf = F.pandas_udf(run, returnType=_TYPES[wanted])
    # a call that may fault must not be moved below a join that drops its row
    return udf if lenient else udf.asNondeterministic()


def read_blocks(program: Program) -> dict[str, Function]:
    out: dict[str, Function] = {}
    for block in program.blocks:
        found = _python(program, block) if block.language == "python" else _sql(program, block) if block.language == "sql" else None
        if found is None:
            raise Diagnostic("validation", f"unsupported embedded language {block.language}; python and sql are supported", Location(program.name, block.line - 1))
        for f in found:
            if f.name in out:
                raise Diagnostic("validation", f"function {f.name} is defined twice", Location(program.name, f.line), function=f.name)
            out[f.name] = f
    return out


def _sql(program: Program, block: Block) -> list[Function]:
    out = []
    for k, line in enumerate(block.text.split("\n")):
        if not line.strip() or line.strip().startswith("--"):
            continue
        m, at = _SQL.match(line), Location(program.name, block.line + k)
        if not m:
            raise Diagnostic("function", "expected name(a: int, ...) -> type = expression", at)
        pairs = [[x.strip() for x in p.split(":")] for p in m[2].split(",") if p.strip()]
        if m[3] not in _TYPES or any(len(p) != 2 or p[1] not in ("int", "str") for p in pairs):
            raise Diagnostic("function", f"parameters of {m[1]} are int or str, its result int, str or bool", at, function=m[1])
        out.append(Function(m[1], [p[1] for p in pairs], m[3], block.line + k, [p[0] for p in pairs], expression=m[4]))
    return out


def _python(program: Program, block: Block) -> list[Function]:
    try:
        tree = pyast.parse(block.text)
    except SyntaxError as e:
        raise Diagnostic("function", f"a block is not Python: {e.msg}", Location(program.name, block.line + (e.lineno or 1) - 1)) from e
    out = []
    for node in tree.body:
        if isinstance(node, pyast.AsyncFunctionDef):
            raise Diagnostic("function", f"{node.name} is asynchronous", Location(program.name, block.line + node.lineno - 1), function=node.name)
        if not isinstance(node, pyast.FunctionDef) or node.name.startswith("_"):
            continue
        a, at = node.args, Location(program.name, block.line + node.lineno - 1)
        kinds = [getattr(x.annotation, "id", None) for x in a.args]
        result = getattr(node.returns, "id", None)
        if not node.name.isascii() or a.vararg or a.kwarg or a.kwonlyargs or a.posonlyargs or a.defaults or result not in _TYPES or any(k not in ("int", "str") for k in kinds):
            raise Diagnostic("function", f"{node.name} needs plain parameters annotated int or str and a result int, str or bool", at, function=node.name)
        out.append(Function(node.name, kinds, result, at.line, [x.arg for x in a.args], source=block.text, block_line=block.line))
    return out
