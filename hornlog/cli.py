"""The command line: ``python -m hornlog -p program.dl -f facts [-c output] [options]``; data on standard output only."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .engine import Engine, EngineConfig, EvaluationOptions
from .lang.diagnostics import Diagnostic
from .sources.writers import write_result


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="hornlog", description="Evaluate a program of rules.")
    p.add_argument("-p", "--program", required=True, help="the program")
    p.add_argument("-f", "--facts", help="folder of fact files")
    p.add_argument("-c", "--csvs", help="write results below this folder")
    p.add_argument("-d", "--delimiter", default=",")
    p.add_argument("-w", "--workers", type=int, default=4, help="local threads, where no master is configured")
    p.add_argument("-O", dest="opt_level", type=int, choices=range(4), default=0)
    p.add_argument("--no-sharing", action="store_true")
    p.add_argument("--check", action="store_true", help="print a report on the program, do not evaluate it")
    p.add_argument("--budget-seconds", type=float)
    p.add_argument("--memory-limit-mib", type=int)
    p.add_argument("--tuple-limit", type=int)
    p.add_argument("--explain", action="store_true", help="a witness for every output row")
    p.add_argument("--profile-json")
    p.add_argument("--daemon-socket")
    p.add_argument("--max-concurrent", type=int, default=4)
    return p.parse_args(argv)


def session(workers: int) -> SparkSession:
    builder = SparkSession.builder.appName("hornlog").config("spark.ui.showConsoleProgress", "false")
    if not os.environ.get("MASTER") and "spark.master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", "") and not SparkSession.getActiveSession():
        builder = builder.master(f"local[{workers}]").config("spark.sql.shuffle.partitions", str(workers))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    try:
        try:
            with open(args.program, encoding="utf-8") as f:
                text = f.read()
        except OSError as e:
            raise Diagnostic("input", f"the program cannot be read: {e}") from e
        engine = Engine(session(args.workers), EngineConfig(args.opt_level, not args.no_sharing, args.max_concurrent, args.delimiter))
        if args.check:
            print(json.dumps(engine.check(text, args.program), indent=2))
            return 0
        if args.daemon_socket:
            from .service import Service

            Service(engine, args).serve(args.daemon_socket)
            return 0
        options = EvaluationOptions(
            args.budget_seconds, args.tuple_limit, args.memory_limit_mib and args.memory_limit_mib << 20, explain_all=args.explain, profile_path=args.profile_json,
        )
        result = engine.evaluate(text, facts=args.facts, options=options, name=args.program)
        if args.csvs:
            write_result(result, args.csvs, args.delimiter)
        for name, n in result.sizes.items():
            print(f"{name}: {n} rows", file=sys.stderr)
        return 0
    except Diagnostic as d:
        print(d, file=sys.stderr)
        if os.environ.get("HORNLOG_DIAGNOSTIC_JSON") == "1":
            print(d.to_json(), file=sys.stderr)
        return 1
