"""Declarations: what a vertex says of its kinds, as text, objects and documents.

A declaration is nodes of a name, values, properties and children in braces.
``load`` reads the text, ``Vertex`` holds what it means, ``documents`` takes it
apart into one JSON document a subject, which live in the log as ``_decl.*``
facts; ``declared`` folds those, so that a past declaration can be read at any
receipt or time.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.folds import Avg, Collect, Count, Fold, Latest, Max, Min, Spec, Sum, Tail, Upsert
from ..operators.parse import Coerce, Explode, Flatten, Pick, Project, Rename, Select, Skip, Split, Step, Transform, Where


class DeclarationError(ValueError):
    """What is wrong with a declaration, with its line where it is known."""


# text --------------------------------------------------------------------------------
_TOKEN = re.compile(
    r"""(?P<space>[ \t]+|\\[ \t]*(?://[^\n]*)?\n)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<end>\n|;)|(?P<open>\{)|(?P<close>\})
    |(?P<text>"(?:[^"\\]|\\.)*")|(?P<raw>\#"[^"]*"\#)|(?P<equals>=)|(?P<word>[^\s{}=;"\\]+)""",
    re.S | re.X,
)


@dataclass
class Node:
    name: str
    values: list = field(default_factory=list)
    properties: dict = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    line: int = 0

    def child(self, name: str) -> Node | None:
        return next((c for c in self.children if c.name == name), None)

    def value(self, default=None):
        return self.values[0] if self.values else default


def _tokens(text: str):
    at, line = 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise DeclarationError(f"line {line}: can't read {text[at : at + 20]!r}")
        kind, shown = m.lastgroup, m[0]
        if kind not in ("space", "comment"):
            yield kind, shown, line
        line += shown.count("\n")
        at = m.end()
    yield "end", "\n", line


def _scalar(kind: str, shown: str):
    if kind == "text":
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), shown[1:-1])
    if kind == "raw":
        return shown[2:-2]
    named = {"#true": True, "true": True, "#false": False, "false": False, "#null": None, "null": None}
    if shown in named:
        return named[shown]
    if re.fullmatch(r"[+-]?\d[\d_]*", shown):
        return int(shown.replace("_", ""))
    if re.fullmatch(r"[+-]?\d[\d_]*\.\d+(e[+-]?\d+)?", shown, re.I):
        return float(shown.replace("_", ""))
    return shown


def load(text: str) -> list[Node]:
    """Nodes of a declaration's text."""
    root = Node("")
    stack, now, held = [root], None, None
    for kind, shown, line in _tokens(text):
        if kind == "equals":
            if now is None or held is None:
                raise DeclarationError(f"line {line}: = without a name")
            now.values.pop()
            now.properties[held] = ...
            continue
        if kind in ("word", "text", "raw"):
            if now is None:
                now = Node(shown if kind == "word" else _scalar(kind, shown), line=line)
                stack[-1].children.append(now)
                held = None
            elif held is not None and now.properties.get(held) is ...:
                now.properties[held] = _scalar(kind, shown)
                held = None
            else:
                now.values.append(_scalar(kind, shown))
                held = shown
        elif kind == "open":
            if now is None:
                raise DeclarationError(f"line {line}: {{ without a name")
            stack.append(now)
            now = held = None
        elif kind == "close":
            if len(stack) == 1:
                raise DeclarationError(f"line {line}: }} without {{")
            stack.pop()
            now = held = None
        else:
            now = held = None
    if len(stack) > 1:
        raise DeclarationError(f"line {stack[-1].line}: {stack[-1].name} isn't closed")
    return root.children


# meaning ---------------------------------------------------------------------------------
@dataclass
class Boundary:
    """Closes a window: mode when (a kind), after or every (a count), with payload members and state conditions."""

    mode: str
    kind: str | None = None
    count: int | None = None
    match: dict[str, str] = field(default_factory=dict)
    conditions: list[tuple[str, str, str]] = field(default_factory=list)


@dataclass
class Kind:
    name: str
    folds: list[Fold] = field(default_factory=list)
    boundary: Boundary | None = None
    search: list[str] = field(default_factory=list)
    preview: list[str] = field(default_factory=list)
    edges: dict[str, str] = field(default_factory=dict)
    lifecycle: tuple[str, list[str]] | None = None
    parse: list[Step] = field(default_factory=list)

    def spec(self) -> Spec:
        return Spec(self.name, tuple(self.folds))


@dataclass
class Vertex:
    name: str
    kinds: dict[str, Kind] = field(default_factory=dict)
    routes: list[tuple[str, str]] = field(default_factory=list)
    boundaries: list[Boundary] = field(default_factory=list)
    observers: dict[str, list[str]] = field(default_factory=dict)
    combine: list[str] = field(default_factory=list)
    discover: str | None = None
    strict: bool = False

    def specs(self) -> dict[str, Spec]:
        """By kind; ``cite`` is collected whole unless it is declared."""
        out = {name: k.spec() for name, k in self.kinds.items()}
        return out | ({} if "cite" in out else {"cite": Spec("cite", (Collect("items", 0),))})

    # a builder of the same thing
    def fold(self, kind: str, *folds: Fold) -> Vertex:
        self.kinds.setdefault(kind, Kind(kind)).folds.extend(folds)
        return self

    def closes(self, kind: str, boundary: Boundary) -> Vertex:
        self.kinds.setdefault(kind, Kind(kind)).boundary = boundary
        return self


def fold_of(target: str, op: str, args: list) -> Fold:
    """A fold by its keyword. Least and most start from 0, as state of a number does."""
    first = args[0] if args else None
    makers = {
        "inc": lambda: Count(target), "count": lambda: Count(target), "latest": lambda: Latest(target), "by": lambda: Upsert(target, first),
        "sum": lambda: Sum(target, first), "max": lambda: Max(target, first), "min": lambda: Min(target, first), "avg": lambda: Avg(target, first),
        "collect": lambda: Collect(target, first), "window": lambda: Tail(target, str(args[1]), first),
    }
    if op not in makers:
        raise DeclarationError(f"{target}: no fold is called {op}")
    if op in ("by", "sum", "max", "min", "avg") and not isinstance(first, str):
        raise DeclarationError(f"{target}: {op} needs a field")
    if (op in ("collect", "window") and not isinstance(first, int)) or (op == "window" and len(args) < 2):
        raise DeclarationError(f"{target}: {op} needs a size" + " and a field" * (op == "window"))
    return makers[op]()


def _boundary(node: Node) -> Boundary:
    modes = [m for m in ("when", "after", "every") if m in node.properties]
    if len(modes) != 1:
        raise DeclarationError(f"line {node.line}: a boundary has one of when, after, every")
    mode, value = modes[0], node.properties[modes[0]]
    match = {k: v for k, v in node.properties.items() if k not in (mode, "run")}
    allowed = {"condition", "run"} if mode == "when" else {"run"}
    for c in node.children:
        if c.name not in allowed:
            raise DeclarationError(f"line {c.line}: {c.name} has no place in a boundary with {mode}")
    conditions = [tuple(str(v) for v in c.values) for c in node.children if c.name == "condition"]
    return Boundary(mode, value if mode == "when" else None, int(value) if mode != "when" else None, {k: str(v) for k, v in match.items()}, conditions)


def vertex(text: str) -> Vertex:
    """What a declaration's text means; names that aren't known are refused."""
    out = Vertex("")
    known = {"name", "store", "strict", "observer_scoped", "emit", "loops", "routes", "sources", "vertices", "discover", "combine", "observers", "lens", "boundary"}
    for node in load(text):
        if node.name not in known:
            raise DeclarationError(f"line {node.line}: {node.name} isn't known")
        match node.name:
            case "name":
                out.name = node.value()
            case "strict":
                out.strict = node.value(True)
            case "discover":
                out.discover = node.value()
            case "combine":
                out.combine = [*map(str, node.values), *[c.name for c in node.children]]
            case "routes":
                out.routes = [(c.name, c.value()) for c in node.children]
            case "boundary":
                out.boundaries.append(_boundary(node))
            case "observers":
                for c in node.children:
                    grant = c.child("grant")
                    potential = grant.child("potential") if grant else None
                    out.observers[c.name] = list(potential.values) if potential else []
            case "loops":
                for c in node.children:
                    out.kinds[c.name] = _kind(c)
    problems = problems_of(out)
    if problems:
        raise DeclarationError("; ".join(problems))
    return out


def _kind(node: Node) -> Kind:
    k = Kind(node.name)
    for c in node.children:
        match c.name:
            case "fold":
                k.folds = [fold_of(f.name, f.value(), f.values[1:]) for f in c.children]
            case "boundary":
                k.boundary = _boundary(c)
            case "search":
                k.search = list(c.values)
            case "preview":
                k.preview = list(c.values)
            case "edge":
                k.edges[c.value()] = c.properties["targets"]
            case "lifecycle":
                k.lifecycle = (c.value(), [x.strip() for x in c.properties["active"].split(",")])
            case "parse":
                k.parse = [step for x in c.children for step in _steps(x)]
            case _:
                raise DeclarationError(f"line {c.line}: {c.name} isn't known")
    return k


def _steps(node: Node) -> list[Step]:
    """The steps of one line of a parse block; a step that isn't known or lacks something is refused."""

    def refuse(why: str) -> DeclarationError:
        return DeclarationError(f"line {node.line}: {node.name} {why}")

    texts, given = [str(x) for x in node.values], node.properties
    if node.name == "split":
        return [Split(texts[0] if texts else None, given.get("max"))]
    if node.name == "project":
        if not node.children or any("path" not in c.properties for c in node.children):
            raise refuse("needs fields, each with a path")
        return [Project({c.name: str(c.properties["path"]) for c in node.children})]
    if node.name == "where":
        if "path" not in given:
            raise refuse("needs a path")
        for op in ("equals", "not_equals"):
            if op in given:
                return [Where(given["path"], op, str(given[op]))]
        listed = {"in": "in_", "not_in": "not_in"}.get(texts[0]) if texts else None
        if listed and len(texts) < 2:
            raise refuse("needs values")
        return [Where(given["path"], listed, values=tuple(texts[1:]))] if listed else [Where(given["path"], "exists")]
    if node.name == "explode":
        path = given.get("path", texts[0] if texts else None)
        if path is None:
            raise refuse("needs a path")
        carried = [x.strip().split(":") for x in given.get("carry", "").split(",") if x.strip()]
        if any(len(set(x)) > 1 for x in carried):
            raise refuse("can't carry a field under another name")
        return [Explode(path, tuple(x[0] for x in carried))]
    if node.name not in ("skip", "pick", "select", "transform", "flatten"):
        raise refuse("isn't a step of a parse block")
    if not texts:
        raise refuse("needs a value")
    if node.name == "skip":
        return [Skip(startswith=texts[0][1:]) if texts[0].startswith("^") else Skip(contains=texts[0])]
    if node.name == "select":
        return [Select(tuple(texts))]
    if node.name == "pick":
        names = node.child("names")
        picked = [Pick(tuple(int(x) for x in texts))]
        return picked + [Rename({i: str(name) for i, name in enumerate(names.values)})] if names else picked
    if node.name == "flatten":
        taken = node.child("extract")
        if "into" not in given or not taken or not taken.values:
            raise refuse("needs into and extract")
        return [Flatten(texts[0], given["into"], tuple(map(str, taken.values)))]
    done = {c.name: [str(x) for x in c.values] for c in node.children}
    unknown = done.keys() - {"strip", "lstrip", "rstrip", "replace", "coerce"}
    if not done or unknown or len(done.get("replace", "ab")) != 2:
        raise refuse("needs strip, lstrip, rstrip, coerce with a value, or replace with two")
    out: list[Step] = []
    if done.keys() - {"coerce"}:
        trims = {name: done[name][0] for name in ("strip", "lstrip", "rstrip") if name in done}
        out.append(Transform(texts[0], **trims, replace=tuple(done["replace"]) if "replace" in done else None))
    if "coerce" in done:
        if done["coerce"][0] not in ("int", "float", "bool", "str"):
            raise refuse("coerces to int, float, bool or str")
        out.append(Coerce({texts[0]: done["coerce"][0]}))
    return out


def problems_of(v: Vertex) -> list[str]:
    """Kinds need folds, reserved names are refused, boundaries don't collide."""
    out = [f"{k.name}: no fold" for k in v.kinds.values() if not k.folds]
    out += [f"{k}: reserved" for k in v.kinds if k.startswith("_")]
    inner = {k.boundary.kind for k in v.kinds.values() if k.boundary and k.boundary.kind}
    out += [f"{b.kind}: both a vertex's boundary and a kind's" for b in v.boundaries if b.kind and b.kind in inner]
    out += [f"{loop}: a route to a kind that isn't declared" for _, loop in v.routes if loop not in v.kinds]
    for k in v.kinds.values():
        targets = {f.target for f in k.folds}
        out += [f"{k.name}: a condition on {c[0]}, which isn't folded" for c in (k.boundary.conditions if k.boundary else []) if c[0] not in targets]
    return out


def merged_specs(many: list[dict[str, Spec]]) -> dict[str, Spec]:
    """Specs of several vertices together; one kind folded in two ways is refused."""
    out: dict[str, Spec] = {}
    for specs in many:
        for name, spec in specs.items():
            if name in out and set(out[name].folds) != set(spec.folds):
                raise DeclarationError(f"{name}: folded in different ways")
            out[name] = spec
    return out


# documents and history ----------------------------------------------------------------------
def documents(v: Vertex) -> dict[tuple[str, str], str]:
    """A JSON document for each (section, subject)."""
    out = {("vertex", v.name): {"strict": v.strict, "routes": v.routes, "combine": v.combine, "discover": v.discover, "boundaries": [asdict(b) for b in v.boundaries]}}
    for k in v.kinds.values():
        out["kind", k.name] = asdict(k) | {name: [[type(x).__name__, asdict(x)] for x in getattr(k, name)] for name in ("folds", "parse")}
    for name, potential in v.observers.items():
        out["observer", name] = {"potential": potential}
    return {key: json.dumps(value, sort_keys=True) for key, value in out.items()}


def from_documents(docs: dict[tuple[str, str], str]) -> Vertex:
    """The vertex that gives these documents."""
    makers = {c.__name__: c for c in (Avg, Collect, Count, Latest, Max, Min, Sum, Tail, Upsert)}
    steps = {c.__name__: c for c in (Coerce, Explode, Flatten, Pick, Project, Rename, Select, Skip, Split, Transform, Where)}

    def step(name: str, given: dict) -> Step:
        """JSON has lists for tuples and text for numbers as names."""
        fixed = {k: tuple(x) if isinstance(x, list) else x for k, x in given.items()}
        return steps[name](**(fixed if name != "Rename" else {"names": {int(i): x for i, x in given["names"].items()}}))

    out = Vertex("")

    def boundary(b: dict | None) -> Boundary | None:
        return b and Boundary(b["mode"], b["kind"], b["count"], b["match"], [tuple(c) for c in b["conditions"]])

    for (section, subject), text in docs.items():
        d = json.loads(text)
        if section == "vertex":
            out.name, out.strict, out.combine, out.discover = subject, d["strict"], d["combine"], d["discover"]
            out.routes, out.boundaries = [tuple(r) for r in d["routes"]], [boundary(b) for b in d["boundaries"]]
        elif section == "observer":
            out.observers[subject] = d["potential"]
        else:
            life = d["lifecycle"] and (d["lifecycle"][0], d["lifecycle"][1])
            out.kinds[subject] = Kind(subject, [makers[n](**f) for n, f in d["folds"]], boundary(d["boundary"]), d["search"], d["preview"], d["edges"], life, [step(n, x) for n, x in d.get("parse", [])])
    return out


def fingerprint(docs: dict[tuple[str, str], str]) -> str:
    return hashlib.sha256(json.dumps(sorted([*k, v] for k, v in docs.items())).encode()).hexdigest()


def changed(before: dict, after: dict) -> dict[tuple[str, str], str]:
    """added, changed or removed, by (section, subject)."""
    out = {k: "added" for k in after.keys() - before.keys()} | {k: "removed" for k in before.keys() - after.keys()}
    return out | {k: "changed" for k in before.keys() & after.keys() if before[k] != after[k]}


def declared(facts: DataFrame) -> DataFrame:
    """(section, subject, document): the last of each subject in the log's ``_decl.*`` facts, without removed ones.

    Payloads are {"subject": ..., "document": ...}; a removal has no document. Cut
    the facts first to read a past declaration.
    """
    rows = facts.where(F.startswith("kind", F.lit("_decl."))).select(
        F.regexp_extract("kind", r"^_decl\.(\w+)-", 1).alias("section"), F.get_json_object("payload", "$.subject").alias("subject"),
        F.get_json_object("payload", "$.document").alias("document"), "seq",
    )
    return rows.groupBy("section", "subject").agg(F.max_by(F.struct("document"), "seq")["document"].alias("document")).where(F.col("document").isNotNull())


# admission, order of sources ---------------------------------------------------------------------
def admitted(facts: DataFrame, v: Vertex) -> DataFrame:
    """Facts with ``refused``: why each isn't admitted, or null.

    Reserved kinds are refused, and with ``strict`` kinds that aren't declared;
    where observers are declared, one that isn't is refused, and kinds beyond its potential.
    """
    known = list(v.kinds)
    why = F.when(F.startswith("kind", F.lit("_decl.")), F.lit("reserved"))
    if v.strict:
        why = why.when(~F.col("kind").isin(*known), F.lit("undeclared"))
    if v.observers:
        why = why.when(~F.substring_index("observer", "/", -1).isin(*v.observers), F.lit("unknown observer"))
        for name, potential in v.observers.items():
            if potential:
                why = why.when((F.substring_index("observer", "/", -1) == name) & ~F.col("kind").isin(*potential), F.lit("no grant"))
    return facts.withColumn("refused", why)


def tiers(needs: dict[str, list[str]]) -> list[list[str]]:
    """Sources in tiers, each after the sources it needs; a cycle is an error."""
    left, out = {k: {x for x in v if x in needs} for k, v in needs.items()}, []
    while left:
        ready = sorted(k for k, v in left.items() if not v)
        if not ready:
            raise DeclarationError("a cycle among " + ", ".join(sorted(left)))
        out.append(ready)
        left = {k: v - set(ready) for k, v in left.items() if k not in ready}
    return out


def seconds(text: str) -> float:
    """A duration: 500ms, 5s, 1m, 1h30m, 7d."""
    units = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}
    if not re.fullmatch(r"(\d+(ms|s|m|h|d))+", text):
        raise DeclarationError(f"{text!r} is no duration")
    return float(sum(int(n) * units[u] for n, u in re.findall(r"(\d+)(ms|s|m|h|d)", text)))
