"""The semantic model: YAML with strict keys and positions, a registry, name resolution and join paths."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path

import yaml

from ..errors import JoinPathError, policy_denied, unknown
from ..functions.names import suggest

PROVENANCE = ("introspection", "profiling", "db_comment", "query_log", "llm_draft", "human")
CARDINALITY = ("one-to-many", "many-to-one", "many-to-many")
_ENTITY = {"name": str, "description": str, "provenance": str, "verified": bool}


class ModelError(Exception):
    def __init__(self, message: str, line: int = 1, column: int = 1, path: str = ""):
        super().__init__(f"{path}:{line}:{column}: {message}" if path else f"{line}:{column}: {message}")
        self.line, self.column = line, column


@dataclass(frozen=True)
class Entity:
    name: str
    description: str = ""
    provenance: str = "human"
    verified: bool = False
    mark: tuple[int, int] = field(default=(1, 1), compare=False)


@dataclass(frozen=True)
class ModelColumn(Entity):
    dataType: str = ""
    sourceColumn: str | None = None
    nullable: bool | None = None
    isPrimaryKey: bool | None = None
    isUnique: bool | None = None
    profile: dict | None = None

    @property
    def source(self) -> str:
        return self.sourceColumn or self.name


@dataclass(frozen=True)
class Model(Entity):
    source: str = ""
    table: str = ""
    kind: str = "table"
    columns: tuple[ModelColumn, ...] = ()

    def column(self, name: str) -> ModelColumn | None:
        return next((c for c in self.columns if c.name == name), None)


@dataclass(frozen=True)
class Relationship(Entity):
    fromModel: str = ""
    toModel: str = ""
    cardinality: str = ""
    joinKeys: tuple[tuple[str, str], ...] = ()
    throughModel: str | None = None


@dataclass(frozen=True)
class Metric(Entity):
    model: str = ""
    expression: str = ""


@dataclass(frozen=True)
class View(Entity):
    model: str = ""
    columns: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()


@dataclass(frozen=True)
class Cube(Entity):
    model: str = ""
    dimensions: tuple[str, ...] = ()
    measures: tuple[str, ...] = ()


# key -> (type, required)
_SHAPES = {
    "models": (Model, {"source": (str, True), "table": (str, True), "kind": (str, False), "columns": (list, True)}),
    "relationships": (Relationship, {"fromModel": (str, True), "toModel": (str, True), "cardinality": (str, True), "joinKeys": (list, True), "throughModel": (str, False)}),
    "metrics": (Metric, {"model": (str, True), "expression": (str, True)}),
    "views": (View, {"model": (str, True), "columns": (list, False), "metrics": (list, False)}),
    "cubes": (Cube, {"model": (str, True), "dimensions": (list, True), "measures": (list, True)}),
}
_COLUMN = {"dataType": (str, True), "sourceColumn": (str, False), "nullable": (bool, False), "isPrimaryKey": (bool, False), "isUnique": (bool, False), "profile": (dict, False)}


class _Marked(dict):
    mark = (1, 1)


class _Loader(yaml.SafeLoader):
    pass


def _mapping(loader: _Loader, node: yaml.MappingNode) -> _Marked:
    out, at = _Marked(), node.start_mark
    out.mark = (at.line + 1, at.column + 1)
    for k, v in node.value:
        key = loader.construct_object(k, deep=True)
        if key in out:
            raise ModelError(f"key {key!r} is there twice", k.start_mark.line + 1, k.start_mark.column + 1)
        out[key] = loader.construct_object(v, deep=True)
    return out


_Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)
# Dates stay text: a profile's bounds are plain scalars.
_Loader.yaml_implicit_resolvers = {k: [x for x in v if x[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}


def load_yaml(text: str, path: str = ""):
    try:
        return yaml.load(text, _Loader)
    except yaml.MarkedYAMLError as e:
        at = e.problem_mark
        raise ModelError(str(e.problem), at.line + 1 if at else 1, at.column + 1 if at else 1, path) from None


def _take(raw, shape: dict, what: str, path: str) -> dict:
    if not isinstance(raw, dict):
        raise ModelError(f"{what} is not a mapping", path=path)
    mark = getattr(raw, "mark", (1, 1))
    if extra := sorted(set(raw) - set(shape) - set(_ENTITY)):
        raise ModelError(f"{what} has the unknown key {extra[0]}", *mark, path)
    out = {}
    for k, kind in _ENTITY.items():
        if k in raw:
            if not isinstance(raw[k], kind):
                raise ModelError(f"{k} of {what} is not a {kind.__name__}", *mark, path)
            out[k] = raw[k]
    if not out.get("name"):
        raise ModelError(f"{what} has no name", *mark, path)
    if out.setdefault("provenance", "human") not in PROVENANCE:
        raise ModelError(f"provenance of {what} is none of {', '.join(PROVENANCE)}", *mark, path)
    for k, (kind, needed) in shape.items():
        if k in raw:
            if not isinstance(raw[k], kind) or (needed and kind in (str, list) and not raw[k] and k not in ("dimensions", "measures")):
                raise ModelError(f"{k} of {what} is not a filled {kind.__name__}", *mark, path)
            out[k] = raw[k]
        elif needed:
            raise ModelError(f"{what} lacks {k}", *mark, path)
    return out | {"mark": mark}


def parse_document(text: str, path: str = "") -> dict[str, list]:
    raw = load_yaml(text, path) or {}
    if not isinstance(raw, dict) or (extra := sorted(set(raw) - set(_SHAPES))):
        raise ModelError(f"unknown section {extra[0]}" if isinstance(raw, dict) else "not a mapping", path=path)
    out: dict[str, list] = {}
    for section, (cls, shape) in _SHAPES.items():
        out[section] = []
        for i, item in enumerate(raw.get(section) or []):
            what = f"{section}[{i}]"
            f = _take(item, shape, what, path)
            mark = f["mark"]
            if cls is Model:
                f["columns"] = tuple(ModelColumn(**_take(c, _COLUMN, f"{what}.columns[{j}]", path)) for j, c in enumerate(f["columns"]))
                if f.get("kind", "table") not in ("table", "view"):
                    raise ModelError(f"kind of {what}", *mark, path)
            elif cls is Relationship:
                if f["cardinality"] not in CARDINALITY:
                    raise ModelError(f"cardinality of {what} is none of {', '.join(CARDINALITY)}", *mark, path)
                if any(not isinstance(k, dict) or set(k) != {"fromColumn", "toColumn"} for k in f["joinKeys"]):
                    raise ModelError(f"joinKeys of {what} are pairs of fromColumn and toColumn", *mark, path)
                f["joinKeys"] = tuple((k["fromColumn"], k["toColumn"]) for k in f["joinKeys"])
            else:
                f |= {k: tuple(f[k]) for k, (kind, _) in shape.items() if kind is list and k in f}
            out[section].append(cls(**f))
    return out


def _plain(e) -> dict:
    out = {"name": e.name, "description": e.description, "provenance": e.provenance, "verified": e.verified}
    for k, v in vars(e).items():
        if k in out or k == "mark" or v is None:
            continue
        if k == "joinKeys":
            v = [{"fromColumn": a, "toColumn": b} for a, b in v]
        elif isinstance(v, tuple):
            v = [_plain(x) if isinstance(x, Entity) else x for x in v]
        out[k] = v
    return out


def dump_document(doc: dict[str, list]) -> str:
    return yaml.safe_dump({s: [_plain(e) for e in doc.get(s, [])] for s in _SHAPES}, sort_keys=False, allow_unicode=True, width=1000)


class Registry:
    """All documents together; names are case-sensitive here."""

    def __init__(self, documents: Iterable[dict[str, list]]):
        docs = list(documents)
        for section in _SHAPES:
            named: dict[str, Entity] = {}
            for e in (e for d in docs for e in d.get(section, [])):
                if e.name in named:
                    raise ModelError(f"{section} has {e.name} twice", *e.mark)
                named[e.name] = e
            setattr(self, section, named)
        for m in self.models.values():
            if len({c.name for c in m.columns}) < len(m.columns):
                raise ModelError(f"model {m.name} has a column twice", *m.mark)
        for r in self.relationships.values():
            self._known(r, r.fromModel, [a for a, _ in r.joinKeys])
            self._known(r, r.toModel, [b for _, b in r.joinKeys])
            if r.throughModel:
                self._known(r, r.throughModel, [])
        for e in self.metrics.values():
            self._known(e, e.model, [])
        for e in self.views.values():
            self._known(e, e.model, e.columns)
            self._metrics(e, e.metrics)
        for e in self.cubes.values():
            self._known(e, e.model, e.dimensions)
            self._metrics(e, e.measures)

    def _known(self, e: Entity, model: str, columns: Iterable[str]) -> None:
        m = self.models.get(model)
        if m is None:
            raise ModelError(f"{e.name} names the unknown model {model}", *e.mark)
        sources = {c.source for c in m.columns}
        for c in columns:
            if m.column(c) is None and c not in sources:
                raise ModelError(f"{e.name} names the unknown column {model}.{c}", *e.mark)

    def _metrics(self, e: Entity, names: Iterable[str]) -> None:
        for n in names:
            if n not in self.metrics:
                raise ModelError(f"{e.name} names the unknown metric {n}", *e.mark)

    @classmethod
    def load(cls, folder: str | Path) -> Registry:
        files = sorted(p for p in Path(folder).rglob("*") if p.suffix in (".yml", ".yaml"))
        return cls(parse_document(p.read_text(), str(p)) for p in files)

    def model(self, name: str) -> Model:
        if name not in self.models:
            raise unknown("table", name, suggest(name, self.models))
        return self.models[name]

    def model_column(self, model: str, column: str, hidden: Iterable[str] = ()) -> ModelColumn:
        m = self.model(model)
        c = m.column(column)
        if c is None:
            raise unknown("column", f"{model}.{column}", suggest(column, [x.name for x in m.columns], hidden))
        return c

    def spellings(self, hidden, model: str | None = None) -> set[str]:
        """hidden names in lower case, each with the other name of the columns that have it as semantic or source name."""
        veil = {h.lower() for h in hidden}
        out = set(veil)
        for m in self.models.values():
            if model is None or m.name == model:
                for c in m.columns:
                    both = {c.name.lower(), c.source.lower()}
                    if both & veil:
                        out |= both
        return out

    def visible(self, name: str, hidden: dict[str, str]) -> Model:
        m = self.model(name)
        if "*" in hidden:
            raise policy_denied("clac", "The model is not visible.")
        return replace(m, columns=tuple(c for c in m.columns if c.name.lower() not in hidden and c.source.lower() not in hidden))

    def find_path(self, start: str, goal: str) -> list[tuple[Relationship, bool]]:
        """The one shortest route as (relationship, reversed) steps."""
        self.model(start), self.model(goal)
        if start == goal:
            return []
        steps: dict[str, list] = {}
        for r in self.relationships.values():
            steps.setdefault(r.fromModel, []).append((r, False, r.toModel))
            steps.setdefault(r.toModel, []).append((r, True, r.fromModel))
        front = [((start,), ())]
        while front:
            wave = [((*seen, to), (*path, (r, back))) for seen, path in front for r, back, to in steps.get(seen[-1], []) if to not in seen]
            if found := [path for seen, path in wave if seen[-1] == goal]:
                if len(found) > 1:
                    routes = tuple(sorted(" -> ".join(r.name for r, _ in p) for p in found))
                    raise JoinPathError("E_AMBIGUOUS_JOIN_PATH", f"{start} and {goal} are joined by several routes: {'; '.join(routes)}", routes)
                return list(found[0])
            front = wave
        raise JoinPathError("E_NO_JOIN_PATH", f"{start} and {goal} are not joined")
