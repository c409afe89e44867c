"""Custom transforms: one Python function per record, checked before it is stored and locked by its digest.

The check is a whitelist of syntax and names. It keeps honest code simple; it is no sandbox, so run only code that someone
has approved.
"""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_BYTES = 256 * 1024
KINDS = ("transform", "extract")
STATES = ("draft", "validated", "tested", "available", "revoked")
#: Names that a transform may use besides its own, and names that it may not.
ALLOWED = {
    "abs": abs, "all": all, "any": any, "bool": bool, "dict": dict, "enumerate": enumerate, "float": float, "int": int, "isinstance": isinstance, "len": len, "list": list,
    "max": max, "min": min, "range": range, "reversed": reversed, "round": round, "set": set, "sorted": sorted, "str": str, "sum": sum, "tuple": tuple, "zip": zip,
}
FORBIDDEN = {"eval", "exec", "open", "compile", "getattr", "setattr", "delattr", "globals", "locals", "vars", "input", "breakpoint", "type", "object", "super", "memoryview"}
#: Methods through which text formatting reaches attributes.
FORMATTERS = {"format", "format_map"}


def problems(source: str) -> list[str]:
    """What keeps a source from being a transform; empty if nothing."""
    if len(source.encode()) > MAX_BYTES:
        return ["too long"]
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return [f"syntax: line {e.lineno}"]
    out = []
    functions = [n for n in tree.body if isinstance(n, ast.FunctionDef)]
    if [f.name for f in functions].count("transform") != 1:
        out.append("exactly one function transform(record, config) is needed")
    elif [a.arg for a in next(f for f in functions if f.name == "transform").args.args] != ["record", "config"]:
        out.append("transform takes record and config")
    for n in ast.walk(tree):
        line = getattr(n, "lineno", 0)
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            out.append(f"import: line {line}")
        elif isinstance(n, (ast.ClassDef, ast.AsyncFunctionDef, ast.Await, ast.Global, ast.Nonlocal)):
            out.append(f"{type(n).__name__}: line {line}")
        elif isinstance(n, ast.Name) and (n.id in FORBIDDEN or n.id.startswith("_")):
            out.append(f"name {n.id}: line {line}")
        elif isinstance(n, ast.Attribute) and (n.attr.startswith("_") or n.attr in FORMATTERS):
            out.append(f"attribute {n.attr}: line {line}")
    return out


def digest(source: str) -> str:
    return hashlib.sha256(source.encode()).hexdigest()


@dataclass
class Module:
    name: str
    kind: str
    source: str
    state: str = "draft"
    digest: str = ""


@dataclass
class Registry:
    """Modules by name. draft, validated, tested, available, revoked; an available module never changes."""

    modules: dict[str, Module] = field(default_factory=dict)

    def create(self, name: str, kind: str, source: str) -> Module:
        if kind not in KINDS:
            raise ValueError(f"kind {kind} can't be custom")
        if name in self.modules and self.modules[name].state in ("available", "revoked"):
            raise ValueError(f"{name} can't change any more")
        wrong = problems(source)
        if wrong:
            raise ValueError("; ".join(wrong))
        self.modules[name] = Module(name, kind, source, "validated", digest(source))
        return self.modules[name]

    def test(self, name: str, record: dict, config: dict | None = None) -> dict | None:
        m = self.modules[name]
        got = _function(m.source)(dict(record), dict(config or {}))
        if got is not None and not isinstance(got, dict):
            raise ValueError("transform returns a record or None")
        if m.state == "validated":
            m.state = "tested"
        return got

    def approve(self, name: str) -> None:
        if self.modules[name].state != "tested":
            raise ValueError(f"{name} isn't tested")
        self.modules[name].state = "available"

    def revoke(self, name: str) -> None:
        self.modules[name].state = "revoked"

    def apply(self, name: str, df: DataFrame, config: dict | None = None, locked: str | None = None) -> DataFrame:
        """The records of a DataFrame through an available module; None drops a record, unknown columns of a result are left out."""
        m = self.modules[name]
        if m.state != "available":
            raise ValueError(f"{name} isn't available")
        if digest(m.source) != (locked or m.digest):
            raise ValueError(f"{name} isn't what was locked")
        source, settings = m.source, json.dumps(config or {})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f, c = _function(source), json.loads(settings)
            for b in batches:
                rows = [r for r in (f(x, c) for x in b.to_pylist()) if r is not None]
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in b.schema.names} for r in rows], schema=b.schema)

        return df.mapInArrow(run, df.schema)


def _function(source: str):
    space = {"__builtins__": dict(ALLOWED)}
    exec(compile(source, "<module>", "exec"), space)  # noqa: S102 - checked by problems() and approved
    return space["transform"]
