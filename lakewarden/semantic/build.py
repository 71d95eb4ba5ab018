"""Building and maintaining a model: bootstrap from a source, an optional drafted description, and drift checks."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from ..operators.profile import profile
from ..sources.registry import Source
from .model import Metric, Model, ModelColumn, Registry, Relationship, dump_document, parse_document


def bootstrap(source: Source, path: str | Path, draft: Callable[[Model], dict] | None = None) -> bool:
    """Write the source's tables (no views) as a model; True if the file changed. Every column has its profile."""
    models, metrics = [], []
    schema = source.get_schema()
    for t in source.list_tables():
        if t["kind"] != "table":
            continue
        columns = [c for c in schema if c["table"] == t["name"]]
        stats = {r["column"]: r for r in profile(source.tables[t["name"]]).collect()}
        if missing := [c["name"] for c in columns if c["name"] not in stats]:
            raise RuntimeError(f"{t['name']}: no profile of {', '.join(missing)}")
        cols = []
        for c in columns:
            s = stats[c["name"]]
            p = {"distinctCount": s["distinctCount"], "nullRate": s["nullRate"]} | ({"min": s["min"], "max": s["max"]} if s["min"] is not None else {})
            if s["topValues"]:
                p["topValues"] = [{"value": v["value"], "count": v["count"]} for v in s["topValues"]]
            cols.append(ModelColumn(c["name"], c.get("comment", ""), "introspection", False, dataType=c["dataType"], nullable=c["nullable"], isPrimaryKey=c["isPrimaryKey"], isUnique=c["isUnique"], profile=p))
        m = Model(t["name"], t.get("comment", ""), "introspection", False, source=source.config.name, table=t["name"], kind="table", columns=tuple(cols))
        if draft:
            m, more = drafted(m, draft(m))
            metrics += more
        models.append(m)
    text = dump_document({"models": models, "relationships": relationships(source, {m.name for m in models}), "metrics": metrics})
    parse_document(text, str(path))
    p = Path(path)
    if p.exists() and p.read_text() == text:
        return False
    p.write_text(text)
    return True


def drafted(m: Model, answer) -> tuple[Model, list[Metric]]:
    """A drafted description and metrics, never verified; what is malformed is left out."""
    from dataclasses import replace

    if not isinstance(answer, dict) or not isinstance(answer.get("description"), str):
        return m, []
    items = [x for x in answer.get("metrics", []) if isinstance(x, dict) and all(isinstance(x.get(k), str) and x[k] for k in ("name", "expression"))]
    return replace(m, description=answer["description"], provenance="llm_draft"), [Metric(x["name"], x.get("description", ""), "llm_draft", False, model=m.name, expression=x["expression"]) for x in items]


def relationships(source: Source, known: set[str]) -> list[Relationship]:
    """Foreign keys, several columns of one constraint together: many-to-one if all parent columns are keys."""
    unique = {(c["table"], c["name"]) for c in source.get_schema() if c["isPrimaryKey"] or c["isUnique"]}
    groups: dict[tuple, list[dict]] = {}
    for r in source.get_relations():
        groups.setdefault((r["childTable"], r["constraintName"], r["parentTable"]), []).append(r)
    out = []
    for (child, name, parent), keys in sorted(groups.items()):
        if child in known and parent in known:
            one = all((parent, k["parentColumn"]) in unique for k in keys)
            out.append(Relationship(name, "", "introspection", False, fromModel=child, toModel=parent, cardinality="many-to-one" if one else "many-to-many", joinKeys=tuple((k["childColumn"], k["parentColumn"]) for k in keys)))
    return out


@dataclass(frozen=True)
class Finding:
    code: str
    message: str
    line: int
    column: int

    def text(self, path: str = "") -> str:
        return f"{path}:{self.line}:{self.column}: {self.code}: {self.message}"


# Names that mean one type.
ALIASES = {"int4": "int", "integer": "int", "int8": "bigint", "long": "bigint", "int2": "smallint", "short": "smallint", "character varying": "varchar", "double precision": "double"}


def _type(t: str) -> str:
    t = re.sub(r"\s+", " ", t.strip().lower())
    base, paren, rest = t.partition("(")
    return ALIASES.get(base.strip(), base.strip()) + paren + rest


def lint(registry: Registry, source: Source) -> list[Finding]:
    """Where the model has drifted from the source, and what has no description."""
    live = {t: {c["name"]: c for c in source.get_schema(t)} for t in source.tables}
    declared: dict[tuple, set] = {}
    for r in source.get_relations():
        declared.setdefault((r["childTable"], r["constraintName"], r["parentTable"]), set()).add((r["childColumn"], r["parentColumn"]))
    out = []
    add = lambda code, message, e: out.append(Finding(code, message, *e.mark))
    for m in registry.models.values():
        if m.source != source.config.name:
            continue
        if m.table not in live:
            add("missing_model_table", f"{m.name}: table {m.table} is gone", m)
        for c in m.columns if m.table in live else ():
            got = live[m.table].get(c.source)
            if got is None:
                add("missing_column", f"{m.name}.{c.name} is gone", c)
            elif _type(got["dataType"]) != _type(c.dataType):
                add("column_type_changed", f"{m.name}.{c.name} was {c.dataType}, is {got['dataType']}", c)
    for r in registry.relationships.values():
        a, b = registry.models[r.fromModel], registry.models[r.toModel]
        src = lambda m, c: next((x.source for x in m.columns if x.name == c), c)
        keys = {(src(a, x), src(b, y)) for x, y in r.joinKeys}
        back = {(y, x) for x, y in keys}
        there = any((ch, pa) == (a.table, b.table) and keys <= k or (ch, pa) == (b.table, a.table) and back <= k for (ch, _, pa), k in declared.items())
        if a.source == source.config.name and not there:
            add("missing_foreign_key", f"{r.name} has no foreign key", r)
    for e in [*registry.models.values(), *(c for m in registry.models.values() for c in m.columns), *registry.metrics.values()]:
        if not e.description.strip():
            add("missing_description", f"{e.name} has no description", e)
    return sorted(out, key=lambda f: (f.line, f.column, f.code))


def description_coverage(registry: Registry) -> float:
    every = [*registry.models.values(), *(c for m in registry.models.values() for c in m.columns), *registry.metrics.values()]
    return sum(bool(e.description.strip()) for e in every) / len(every) if every else 1.0
