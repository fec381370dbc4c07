"""Fact files: one row a line, cells between delimiters, no header, no quoting."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.ast import NUMBER, SYMBOL, Decl, Program
from ..lang.diagnostics import Diagnostic
from ..operators.rules import UNIT, cells

QUOTED = 120
#: Column types that a DataFrame may give each type in.
_TYPES = {NUMBER: (T.ByteType, T.ShortType, T.IntegerType, T.LongType), SYMBOL: (T.StringType, T.VarcharType, T.CharType)}


def _shown(cell: str) -> str:
    """A cell in an error message, bounded."""
    raw = cell.encode()
    return cell if len(raw) <= QUOTED else raw[:QUOTED].decode(errors="ignore") + "..."


def read_relation(spark: SparkSession, name: str, types: list[str], path: str, delimiter: str = ",", check: bool = True) -> DataFrame:
    """The file's rows as a set of c0, c1, ...; a bad line refuses the file, naming cell and line."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"))
    if not types:
        return lines.select(F.lit(1).alias(UNIT)).limit(1)
    split = lines.where("line <> ''").select("line", F.split("line", re.escape(delimiter), -1).alias("x"))
    wrong = F.size("x") != len(types)
    columns = []
    for k, t in enumerate(types):
        cell = F.get("x", F.lit(k))
        if t == NUMBER:
            value = F.when(cell.rlike(r"^[+-]?[0-9]+$"), F.expr(f"try_cast(get(x, {k}) as bigint)"))
            wrong = wrong | value.isNull()
            columns.append(value.alias(f"c{k}"))
        else:
            columns.append(cell.alias(f"c{k}"))
    if check and not split.where(wrong).limit(1).isEmpty():
        raise _first_bad_line(spark, name, types, path, delimiter)
    return split.select(*columns).distinct()


def _first_bad_line(spark: SparkSession, name: str, types: list[str], path: str, delimiter: str) -> Diagnostic:
    """Only on the way to a refusal: number the lines and describe the first bad one."""

    def problem(line: str) -> str | None:
        row = line.removesuffix("\r").split(delimiter)
        if row == [""]:
            return None
        if len(row) != len(types):
            return f"expected {len(types)} values, got {len(row)}"
        for cell, t in zip(row, types, strict=True):
            if t == NUMBER and not (re.fullmatch(r"[+-]?[0-9]+", cell) and -(1 << 63) <= int(cell) < 1 << 63):
                return f"the cell '{_shown(cell)}' is not a number"
        return None

    rows = spark.read.option("lineSep", "\n").text(path).rdd.map(lambda r: r[0]).zipWithIndex()
    bad = rows.map(lambda x: (x[1] + 1, problem(x[0]))).filter(lambda x: x[1] is not None)
    line, what = bad.first()
    return Diagnostic("input", f"{path}, line {line}: {what}", relations=[name])


def file_of(decl: Decl) -> str:
    return decl.file or f"{decl.name}.facts"


def read_directory(spark: SparkSession, program: Program, directory: str, delimiter: str = ",") -> dict[str, DataFrame]:
    """Every input relation from its file; a missing file is refused."""
    out = {}
    for decl in program.inputs():
        path = os.path.join(directory, file_of(decl))
        if "://" not in path and not os.path.exists(path):
            raise Diagnostic("input", f"the file {path} of {decl.name} does not exist", relations=[decl.name])
        out[decl.name] = read_relation(spark, decl.name, program.types[decl.name], path, delimiter)
    return out


def from_rows(spark: SparkSession, program: Program, rows: dict[str, list]) -> dict[str, DataFrame]:
    """In-memory rows; a symbol cell is its text."""
    out = {}
    for name, given in rows.items():
        if name not in program.decls or program.decls[name].role != "in":
            raise Diagnostic("input", f"{name} is not a declared input relation", relations=[name])
        types = program.types[name]
        for row in given:
            if len(row) != len(types):
                raise Diagnostic("input", f"a row of {name} has {len(row)} cells, not {len(types)}", relations=[name])
            for cell, t in zip(row, types, strict=True):
                if isinstance(cell, bool) or not isinstance(cell, int if t == NUMBER else str) or (t == NUMBER and not -(1 << 63) <= cell < 1 << 63):
                    raise Diagnostic("input", f"the cell {cell!r} of {name} is not a {t}", relations=[name])
        kinds = ["bigint" if t == NUMBER else "string" for t in types] or ["int"]
        schema = ", ".join(f"{c} {k}" for c, k in zip(cells(len(types)), kinds, strict=True))
        out[name] = spark.createDataFrame([tuple(r) if types else (1,) for r in given], schema).distinct()
    return out


def from_frames(program: Program, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """DataFrames, columns by position; whole numbers become 64-bit, other types than whole numbers and text are refused.

    A NULL cell is no value: no variable, constant or repeat matches it, only a wildcard does.
    They are sets by meaning, but are not made distinct here: every head is, so a large table is spared that shuffle."""
    out = {}
    for name, df in frames.items():
        if name not in program.decls or program.decls[name].role != "in":
            raise Diagnostic("input", f"{name} is not a declared input relation", relations=[name])
        types = program.types[name]
        if not types:
            out[name] = df.select(F.lit(1).alias(UNIT)).limit(1)
            continue
        if len(df.columns) != len(types):
            raise Diagnostic("input", f"{name} has {len(types)} columns, but is given {len(df.columns)}", relations=[name])
        for field, t in zip(df.schema.fields, types, strict=True):
            if not isinstance(field.dataType, _TYPES[t]):
                raise Diagnostic("input", f"column {field.name} of {name} is {field.dataType.simpleString()}, not a {t}", relations=[name])
        positional = df.toDF(*[f"c{k}" for k in range(len(types))])
        out[name] = positional.select(*[F.col(f"c{k}").cast("bigint" if t == NUMBER else "string").alias(f"c{k}") for k, t in enumerate(types)])
    return out
