"""A service on a Unix-domain socket: one JSON object per request line, one per response line; a thread for each connection."""

from __future__ import annotations

import json
import os
import socketserver
import threading

from .engine import Engine, EvaluationOptions
from .lang.diagnostics import Diagnostic
from .sources.writers import write_result

VERSION = 3
COMMANDS = ("evaluate", "check", "cancel", "stats", "shutdown", "reload")


class Service:
    def __init__(self, engine: Engine, args=None):
        self.engine, self.args = engine, args
        self.cancels: dict[str, threading.Event] = {}
        self.lock = threading.Lock()
        self.server: socketserver.BaseServer | None = None

    def handle(self, request: dict) -> dict:
        command = request.get("command")
        out = {"version": VERSION, "ok": True, "command": command, "id": request.get("id")}
        try:
            if command == "evaluate":
                out |= self._evaluate(request)
            elif command == "reload":
                inputs = {"facts": request.get("facts") or self.args.facts}
                out |= self._evaluate({"program": {"path": request.get("program") or self.args.program}, "inputs": inputs, "output": {"csvs": request.get("csvs") or self.args.csvs}})
            elif command == "check":
                out["report"] = self.engine.check(*self._program(request))
            elif command == "cancel":
                with self.lock:
                    found = self.cancels.get(str(request.get("id")))
                if found is None:
                    raise Diagnostic("input", f"no evaluation {request.get('id')} is running")
                found.set()
            elif command == "stats":
                out |= self.engine.status()
            elif command == "shutdown":
                threading.Thread(target=self.server.shutdown, daemon=True).start()
            else:
                raise Diagnostic("input", f"unknown command {command!r}; commands are {', '.join(COMMANDS)}")
        except Diagnostic as d:
            out |= {"ok": False, "error": str(d), "diagnostic": d.to_dict()}
        except Exception as e:  # a request must not end the service
            d = Diagnostic("internal", f"{type(e).__name__}: {e}")
            out |= {"ok": False, "error": str(d), "diagnostic": d.to_dict()}
        return out

    @staticmethod
    def _program(request: dict) -> tuple[str, str]:
        program = request.get("program") or {}
        if "text" in program:
            return program["text"], program.get("name", "request")
        try:
            with open(program["path"], encoding="utf-8") as f:
                return f.read(), program["path"]
        except (KeyError, OSError) as e:
            raise Diagnostic("input", f"the program cannot be read: {e}") from e

    def _evaluate(self, request: dict) -> dict:
        text, name = self._program(request)
        inputs, output, given = request.get("inputs") or {}, request.get("output") or {}, request.get("options") or {}
        cancel, key = threading.Event(), str(request.get("id"))
        with self.lock:
            self.cancels[key] = cancel
        try:
            options = EvaluationOptions(
                given.get("budget_seconds"), given.get("tuple_limit"), given.get("memory_limit_bytes"), cancel,
                [(e["relation"], e["row"]) if isinstance(e, dict) else tuple(e) for e in given.get("explain") or []], bool(given.get("explain_all")),
            )
            result = self.engine.evaluate(text, inputs.get("rows"), facts=inputs.get("facts"), options=options, name=name)
            if output.get("csvs"):
                write_result(result, output["csvs"], self.engine.config.delimiter)
            out = {"run": result.stats, "sizes": result.sizes}
            if result.witnesses:
                out["witnesses"] = result.witnesses
            if output.get("inline"):
                out["relations"] = {n: [list(r) for r in result.rows(n)] for n in result.declared()}
            return out
        finally:
            with self.lock:
                self.cancels.pop(key, None)

    def serve(self, path: str) -> None:
        service = self

        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                for line in self.rfile:
                    if not line.strip():
                        continue
                    try:
                        request = json.loads(line)
                        answer = service.handle(request if isinstance(request, dict) else {})
                    except ValueError as e:
                        answer = {"version": VERSION, "ok": False, "error": f"input: not JSON: {e}", "diagnostic": {"kind": "input", "message": f"not JSON: {e}"}}
                    self.wfile.write(json.dumps(answer).encode() + b"\n")
                    self.wfile.flush()

        class Server(socketserver.ThreadingMixIn, socketserver.UnixStreamServer):
            daemon_threads = True

        if os.path.exists(path):
            os.unlink(path)
        with Server(path, Handler) as self.server:
            self.server.serve_forever()
        os.unlink(path)


def ask(path: str, request: dict) -> dict:
    """A client: one request, its response."""
    import socket

    with socket.socket(socket.AF_UNIX) as s:
        s.connect(path)
        s.sendall(json.dumps(request).encode() + b"\n")
        with s.makefile() as f:
            return json.loads(f.readline())
