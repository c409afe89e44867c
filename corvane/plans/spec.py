"""Declarative flows: a typed graph of modules, checked as a whole and composed into one lazy plan.

``check`` reports every problem of a document as (path, code); ``compose`` turns a flow into DataFrames. Nothing is written
between nodes: Catalyst sees the whole flow.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

#: Kinds of nodes with what goes in and what comes out; names of the port types; limits; name of the document form.
KINDS: dict[str, tuple[str | None, str | None]] = {
    "discover": (None, "WorkUnit"), "receive": ("DocumentBatch", "ExtractedDoc"), "fetch": ("WorkUnit", "RawBlob"), "catalog": ("RawBlob", "PartitionRecord"),
    "extract": ("RawBlob", "ExtractedDoc"), "transform": ("ExtractedDoc", "ExtractedDoc"), "collect": ("PartitionRecord", None), "load": ("ExtractedDoc", None),
}
PORTS = ("DocumentBatch", "WorkUnit", "RawBlob", "PartitionRecord", "ExtractedDoc")
LIMITS = {"flows": 8, "nodes": 64, "edges": 256, "stores": 16}
FORM = "corvane/1"
NAME = re.compile(r"[a-z][a-z0-9_]{0,63}")
REFERENCE = re.compile(r"@param\.([a-z][a-z0-9_]*)")
PARAMETER_KINDS = {"int": int, "float": (int, float), "str": str, "bool": bool, "csv": str, "choice": str, "date": str, "url": str, "url_list": list, "regex_list": list, "secret_ref": str, "duration": (int, str)}


@dataclass(frozen=True)
class Param:
    """A setting of a module or a flow: kind, default and range. Numbers are clamped to the range, or rejected if ``strict``."""

    kind: str = "str"
    default: object = None
    required: bool = False
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()
    strict: bool = False

    def resolve(self, value: object) -> object:
        kinds = PARAMETER_KINDS[self.kind]
        if self.kind == "csv" and isinstance(value, (list, tuple)):
            value = ",".join(map(str, value))
        if isinstance(value, bool) != (self.kind == "bool") or not isinstance(value, kinds):
            raise ValueError(f"{value!r} is no {self.kind}")
        if self.choices and value not in self.choices:
            raise ValueError(f"{value!r} isn't one of {', '.join(self.choices)}")
        if self.kind == "regex_list":
            for p in value:
                re.compile(p)
        if self.kind in ("int", "float"):
            clamped = max(value, self.low) if self.low is not None else value
            clamped = min(clamped, self.high) if self.high is not None else clamped
            if clamped != value and self.strict:
                raise ValueError(f"{value!r} is out of range")
            value = clamped
        if self.kind == "duration" and isinstance(value, str):
            m = re.fullmatch(r"(\d+)\s*([smhd])", value)
            if not m:
                raise ValueError(f"{value!r} is no duration")
            value = int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]
        return value


@dataclass(frozen=True)
class Module:
    """What a node uses: its kind, its settings, and a function of the input DataFrame (None for roots) and the settings."""

    kind: str
    run: Callable[[DataFrame | None, dict], DataFrame]
    params: dict[str, Param] = field(default_factory=dict)


@dataclass(frozen=True)
class Issue:
    path: str
    code: str


@dataclass
class Checker:
    modules: dict[str, Module]
    issues: list[Issue] = field(default_factory=list)

    def say(self, path: str, code: str) -> None:
        self.issues.append(Issue(path, code))

    def named(self, value: object, path: str) -> bool:
        ok = isinstance(value, str) and bool(NAME.fullmatch(value))
        if not ok:
            self.say(path, "invalid_identifier")
        return ok

    def shape(self, raw: object, path: str, allowed: set[str]) -> bool:
        if not isinstance(raw, dict):
            self.say(path, "invalid_type")
            return False
        for key in sorted(set(raw) - allowed):
            self.say(f"{path}.{key}".lstrip("."), "unknown_field")
        return True

    def document(self, body: object) -> list[Issue]:
        if not self.shape(body, "", {"schema", "parameters", "state", "flows"}):
            return self.issues
        if body.get("schema") != FORM:
            self.say("schema", "unsupported_schema")
        parameters: dict[str, Param] = {}
        for name, p in (body.get("parameters") or {}).items():
            path = f"parameters.{name}"
            if self.named(name, path) and self.shape(p, path, {"kind", "default", "required", "low", "high", "choices", "strict"}):
                if p.get("kind", "str") not in PARAMETER_KINDS:
                    self.say(f"{path}.kind", "unknown_parameter_kind")
                else:
                    parameters[name] = Param(**p)
        stores = body.get("state") or {}
        if not isinstance(stores, dict):
            self.say("state", "invalid_type")
            stores = {}
        if len(stores) > LIMITS["stores"]:
            self.say("state", "limit_exceeded")
        flows = body.get("flows")
        if not isinstance(flows, dict) or not flows:
            self.say("flows", "required")
            return self.issues
        if len(flows) > LIMITS["flows"]:
            self.say("flows", "limit_exceeded")
        for name, flow in flows.items():
            if self.named(name, f"flows.{name}"):
                self.flow(f"flows.{name}", flow, parameters, set(stores))
        return self.issues

    def node(self, path: str, raw: object, parameters: dict[str, Param], stores: set[str]) -> str | None:
        """Kind of a node if it can be told."""
        if not self.shape(raw, path, {"kind", "uses", "with"}):
            return None
        kind, module = raw.get("kind"), self.modules.get(raw.get("uses"))
        if kind not in KINDS:
            self.say(f"{path}.kind", "unknown_kind")
            kind = None
        if module is None:
            self.say(f"{path}.uses", "unknown_module")
            return kind
        if kind and module.kind != kind:
            self.say(f"{path}.kind", "module_kind_mismatch")
        given = raw.get("with") or {}
        if not isinstance(given, dict):
            self.say(f"{path}.with", "invalid_type")
            return kind
        for key in sorted(set(given) - set(module.params)):
            self.say(f"{path}.with.{key}", "unknown_module_parameter")
        for key, p in module.params.items():
            at = f"{path}.with.{key}"
            if key not in given:
                if p.required:
                    self.say(at, "required")
                continue
            value = given[key]
            ref = REFERENCE.fullmatch(value) if isinstance(value, str) else None
            if ref:
                if ref[1] not in parameters:
                    self.say(at, "unknown_parameter")
                elif parameters[ref[1]].kind != p.kind:
                    self.say(at, "parameter_type_mismatch")
            else:
                try:
                    p.resolve(value)
                except (ValueError, re.error):
                    self.say(at, "invalid_value")
            if key in ("store", "into") and isinstance(value, str) and not ref and value not in stores:
                self.say(at, "undeclared_store")
        return kind

    def flow(self, path: str, raw: object, parameters: dict[str, Param], stores: set[str]) -> None:
        if not self.shape(raw, path, {"inputs", "outputs", "nodes", "edges"}):
            return
        ends: dict[str, dict[str, str | None]] = {"input": {}, "output": {}}
        for side in ends:
            for k, b in enumerate(raw.get(f"{side}s") or []):
                at = f"{path}.{side}s.{k}"
                if not self.shape(b, at, {"id", "type", "required", "max_items", "max_bytes"}) or not self.named(b.get("id"), f"{at}.id"):
                    continue
                if b["id"] in ends[side]:
                    self.say(f"{at}.id", "duplicate_boundary")
                if b.get("type") not in PORTS:
                    self.say(f"{at}.type", "unknown_port_type")
                ends[side][b["id"]] = b.get("type")
        nodes = raw.get("nodes")
        if not isinstance(nodes, dict) or not nodes:
            self.say(f"{path}.nodes", "required")
            return
        if len(nodes) > LIMITS["nodes"]:
            self.say(f"{path}.nodes", "limit_exceeded")
        kinds = {n: self.node(f"{path}.nodes.{n}", v, parameters, stores) for n, v in nodes.items() if self.named(n, f"{path}.nodes.{n}")}
        edges = raw.get("edges") or []
        if len(edges) > LIMITS["edges"]:
            self.say(f"{path}.edges", "limit_exceeded")
        seen, feeds, fed = set(), set(), set()
        graph: dict[str, set[str]] = {n: set() for n in kinds}
        for k, e in enumerate(edges):
            at = f"{path}.edges.{k}"
            if not isinstance(e, dict) or set(e) != {"from", "to"} or any(not isinstance(x, dict) or len(x) != 1 for x in e.values()):
                self.say(at, "invalid_edge")
                continue
            (a_kind, a), (b_kind, b) = next(iter(e["from"].items())), next(iter(e["to"].items()))
            if a_kind not in ("input", "node") or b_kind not in ("node", "output"):
                self.say(at, "edge_direction")
                continue
            known = True
            for role, kind, name in (("from", a_kind, a), ("to", b_kind, b)):
                there = kinds if kind == "node" else ends[kind]
                if name not in there:
                    self.say(f"{at}.{role}.{kind}", "unknown_node" if kind == "node" else "unknown_boundary")
                    known = False
            if not known:
                continue
            if (a_kind, a, b_kind, b) in seen:
                self.say(at, "duplicate_edge")
            seen.add((a_kind, a, b_kind, b))
            out = KINDS[kinds[a]][1] if a_kind == "node" and kinds[a] else ends["input"].get(a)
            into = KINDS[kinds[b]][0] if b_kind == "node" and kinds[b] else ends["output"].get(b)
            if out != into or out is None:
                self.say(at, "port_type_mismatch")
            if a_kind == "node":
                feeds.add(a)
            if b_kind == "node":
                fed.add(b)
                if a_kind == "node":
                    graph[b].add(a)
        try:
            TopologicalSorter(graph).prepare()
        except CycleError:
            self.say(path, "cycle")
        for n, kind in kinds.items():
            if kind and KINDS[kind][0] and n not in fed:
                self.say(f"{path}.nodes.{n}", "missing_input")
            if kind and KINDS[kind][1] and n not in feeds:
                self.say(f"{path}.nodes.{n}", "dangling_output")


def check(body: object, modules: dict[str, Module]) -> list[Issue]:
    """Every problem of a document, in the order of the document."""
    return Checker(modules).document(body)


def indexable(body: dict, modules: dict[str, Module]) -> list[Issue]:
    """Problems that keep a valid document from feeding a search source: no ingress, mixed ingress, staging that no root reaches."""
    out, ways = [], set()
    for name, flow in body["flows"].items():
        kinds = {n: v["kind"] for n, v in flow["nodes"].items()}
        after: dict[str, set[str]] = {n: set() for n in kinds}
        for e in flow.get("edges") or []:
            if "node" in e["from"] and "node" in e["to"]:
                after[e["from"]["node"]].add(e["to"]["node"])
        roots = {n for n, k in kinds.items() if k in ("discover", "receive")}
        ways |= {{"discover": "pull", "receive": "push"}[kinds[n]] for n in roots}
        reached, todo = set(), list(roots)
        while todo:
            n = todo.pop()
            if n not in reached:
                reached.add(n)
                todo += after[n]
        out += [Issue(f"flows.{name}.nodes.{n}", "unreachable_staging") for n, k in kinds.items() if k == "load" and n not in reached]
    if not ways:
        out.append(Issue("flows", "no_ingress"))
    if len(ways) > 1:
        out.append(Issue("flows", "mixed_ingress"))
    if not any(v["kind"] == "load" for f in body["flows"].values() for v in f["nodes"].values()):
        out.append(Issue("flows", "no_staging"))
    return out


def compose(body: dict, modules: dict[str, Module], flow: str, inputs: dict[str, DataFrame] | None = None, bindings: dict | None = None) -> dict[str, DataFrame]:
    """DataFrames of the nodes without a follower, and of the outputs, by name. Several inputs of a node are united by name."""
    issues = check(body, modules)
    if issues:
        raise ValueError(", ".join(f"{i.path}: {i.code}" for i in issues))
    declared = {n: Param(**p) for n, p in (body.get("parameters") or {}).items()}
    values = {n: p.resolve((bindings or {})[n]) if n in (bindings or {}) else p.default for n, p in declared.items()}
    missing = [n for n, p in declared.items() if p.required and values[n] is None]
    if missing:
        raise ValueError(f"parameters without a value: {', '.join(missing)}")
    raw = body["flows"][flow]
    before: dict[str, list[tuple[str, str]]] = {n: [] for n in raw["nodes"]}
    outs: dict[str, str] = {}
    for e in raw.get("edges") or []:
        (a_kind, a), (b_kind, b) = next(iter(e["from"].items())), next(iter(e["to"].items()))
        if b_kind == "node":
            before[b].append((a_kind, a))
        else:
            outs[b] = a
    done: dict[str, DataFrame] = {}
    for n in TopologicalSorter({n: {a for k, a in v if k == "node"} for n, v in before.items()}).static_order():
        node, module = raw["nodes"][n], modules[raw["nodes"][n]["uses"]]
        settings = {k: p.default for k, p in module.params.items()}
        for k, v in (node.get("with") or {}).items():
            ref = REFERENCE.fullmatch(v) if isinstance(v, str) else None
            settings[k] = values[ref[1]] if ref else module.params[k].resolve(v)
        parts = [(inputs or {})[a] if kind == "input" else done[a] for kind, a in before[n]]
        source = parts[0] if parts else None
        for more in parts[1:]:
            source = source.unionByName(more, allowMissingColumns=True)
        done[n] = module.run(source, settings)
    used = {a for v in before.values() for k, a in v if k == "node"}
    return {n: d for n, d in done.items() if n not in used} | {b: done[a] for b, a in outs.items()}
