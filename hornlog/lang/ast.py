"""The parsed program."""

from __future__ import annotations

from dataclasses import dataclass, field

NUMBER, SYMBOL = "number", "symbol"
MIN64, MAX64 = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Const:
    value: int | str

    def __str__(self) -> str:
        return f'"{self.value}"' if isinstance(self.value, str) else str(self.value)


@dataclass(frozen=True)
class Wild:
    def __str__(self) -> str:
        return "_"


@dataclass(frozen=True)
class Expr:
    """Factors joined from left to right, without precedence."""

    first: Var | Const
    rest: tuple[tuple[str, Var | Const], ...] = ()

    def factors(self) -> list[Var | Const]:
        return [self.first, *[f for _, f in self.rest]]

    def variables(self) -> list[str]:
        return [f.name for f in self.factors() if isinstance(f, Var)]

    def can_fault(self) -> bool:
        return any(op in "/%" for op, _ in self.rest)

    def __str__(self) -> str:
        return " ".join([str(self.first), *[f"{op} {f}" for op, f in self.rest]])


@dataclass(frozen=True)
class Agg:
    op: str
    expr: Expr

    def __str__(self) -> str:
        return f"{self.op}({self.expr})"


@dataclass(frozen=True)
class Atom:
    relation: str
    args: tuple[Var | Const | Wild, ...]
    negated: bool = False

    def variables(self) -> list[str]:
        return list(dict.fromkeys(a.name for a in self.args if isinstance(a, Var)))

    def __str__(self) -> str:
        return ("!" if self.negated else "") + f"{self.relation}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Compare:
    op: str
    left: Expr
    right: Expr

    def variables(self) -> list[str]:
        return [*self.left.variables(), *self.right.variables()]

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Bool:
    value: bool

    def __str__(self) -> str:
        return str(self.value)


@dataclass(frozen=True)
class Call:
    """Binds ``target`` to the function's result, or filters if there is none."""

    function: str
    args: tuple[Var | Const | Wild, ...]
    target: str | None = None

    def __str__(self) -> str:
        call = f"@call({', '.join([self.function, *map(str, self.args)])})"
        return f"{self.target} = {call}" if self.target else call


@dataclass(frozen=True)
class Head:
    relation: str
    args: tuple[Expr | Agg, ...]

    def aggregate(self) -> tuple[int, Agg] | None:
        return next(((k, a) for k, a in enumerate(self.args) if isinstance(a, Agg)), None)

    def __str__(self) -> str:
        return f"{self.relation}({', '.join(map(str, self.args))})"


@dataclass
class Rule:
    head: Head
    body: list[Atom | Compare | Bool | Call]
    line: int
    plan: bool = False
    sip: bool = False
    number: int = 0

    def atoms(self) -> list[Atom]:
        return [p for p in self.body if isinstance(p, Atom) and not p.negated]

    def negated(self) -> list[Atom]:
        return [p for p in self.body if isinstance(p, Atom) and p.negated]

    def compares(self) -> list[Compare]:
        return [p for p in self.body if isinstance(p, Compare)]

    def calls(self) -> list[Call]:
        return [p for p in self.body if isinstance(p, Call)]

    def never(self) -> bool:
        return any(isinstance(p, Bool) and not p.value for p in self.body)

    def reads(self) -> set[str]:
        return {p.relation for p in self.body if isinstance(p, Atom)}

    def __str__(self) -> str:
        return f"{self.head} :- {', '.join(map(str, self.body))}."


@dataclass
class Decl:
    name: str
    attributes: list[tuple[str, str]]
    role: str  # "in" or "out"
    line: int
    file: str | None = None


@dataclass
class Block:
    language: str
    text: str
    line: int  # of its first inner line


@dataclass
class Program:
    name: str
    decls: dict[str, Decl] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    #: relation -> column types, filled by validation
    types: dict[str, list[str]] = field(default_factory=dict)
    functions: dict = field(default_factory=dict)

    def inputs(self) -> list[Decl]:
        return [d for d in self.decls.values() if d.role == "in"]

    def outputs(self) -> list[Decl]:
        return [d for d in self.decls.values() if d.role == "out"]

    def heads(self) -> list[str]:
        return list(dict.fromkeys(r.head.relation for r in self.rules))

    def columns(self, relation: str) -> list[str]:
        """Declared attribute names if they are distinct, else c0, c1, ..."""
        n = len(self.types[relation])
        decl = self.decls.get(relation)
        names = [a for a, _ in decl.attributes] if decl else []
        return names if len({x.lower() for x in names}) == n and n else [f"c{k}" for k in range(n)]
