"""A client of the service: ``python -m hornlog.ctl -s /tmp/s evaluate --program p.dl --facts dir --inline``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .service import COMMANDS, ask


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="hornlog.ctl")
    p.add_argument("-s", "--socket", required=True)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--id")
    p.add_argument("--program")
    p.add_argument("--facts")
    p.add_argument("--csvs")
    p.add_argument("--inline", action="store_true")
    p.add_argument("--budget-seconds", type=float)
    p.add_argument("--tuple-limit", type=int)
    p.add_argument("--explain", action="store_true")
    a = p.parse_args(argv)
    full = lambda x: x and os.path.abspath(x)
    request: dict = {"command": a.command, "id": a.id}
    if a.command == "reload":
        request |= {"program": full(a.program), "facts": full(a.facts), "csvs": full(a.csvs)}
    elif a.program:
        request |= {
            "program": {"path": full(a.program)}, "inputs": {"facts": full(a.facts)} if a.facts else {}, "output": {"csvs": full(a.csvs), "inline": a.inline},
            "options": {"budget_seconds": a.budget_seconds, "tuple_limit": a.tuple_limit, "explain_all": a.explain},
        }
    answer = ask(a.socket, request)
    print(json.dumps(answer))
    return 0 if answer.get("ok") else 1


if __name__ == "__main__":
    sys.exit(main())
