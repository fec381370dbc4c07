"""One structured refusal for everything that can go wrong."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

#: What refused: the text, its meaning, negation through recursion, planning, inputs, a function, the data, a limit, this engine.
KINDS = ("parse", "validation", "stratification", "planning", "input", "function", "evaluation", "resource", "internal")


@dataclass
class Location:
    source: str
    line: int
    column: int = 0

    def __str__(self) -> str:
        return f"{self.source}:{self.line}" + (f":{self.column}" if self.column else "")


@dataclass
class Diagnostic(Exception):
    kind: str
    message: str
    location: Location | None = None
    rule: str | None = None
    relations: list[str] = field(default_factory=list)
    function: str | None = None
    detail: str | None = None

    def __str__(self) -> str:
        place = f"{self.location}: " if self.location else ""
        return f"{place}{self.kind}: {self.message}" + (f" (in {self.rule})" if self.rule else "") + (f"\n{self.detail}" if self.detail else "")

    def to_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v not in (None, [])}

    def to_json(self) -> str:
        return json.dumps(self.to_dict())
