"""Metrics with dimensions as DataFrames over the governed views; no SQL text in between."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.gate import DEFAULT_ROWS, MAX_ROWS, GovernedSession, Plan, mint
from .model import Registry

_METRIC = re.compile(r"\s*(COUNT|SUM|AVG|MIN|MAX)\s*\(\s*(DISTINCT\s+)?(\*|[A-Za-z_][A-Za-z0-9_]*)\s*\)\s*", re.I)


def parse_metric(expression: str) -> tuple[str, bool, str]:
    m = _METRIC.fullmatch(expression)
    if not m:
        raise ValueError(f"not one aggregate of one column: {expression}")
    op, distinct, what = m[1].lower(), bool(m[2]), m[3]
    if what == "*" and (op != "count" or distinct):
        raise ValueError(f"only COUNT(*) takes a star: {expression}")
    return op, distinct, what


def aggregate(op: str, distinct: bool, c: Column) -> Column:
    if distinct:
        return {"count": F.count_distinct, "sum": F.sum_distinct, "avg": lambda x: F.expr("NULL"), "min": F.min, "max": F.max}[op](c) if op != "avg" else F.sum_distinct(c) / F.count_distinct(c)
    return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[op](c)


class _Frames:
    """Each model once, under its name, with semantic column names."""

    def __init__(self, session: GovernedSession, registry: Registry):
        self.session, self.registry, self.joined, self.frame, self.warnings = session, registry, [], None, []

    def base(self, model: str) -> None:
        self.frame, self.joined = self._of(model), [model]

    def _of(self, model: str) -> DataFrame:
        m = self.registry.model(model)
        hidden = self.session.policy.hidden_of(m.name, m.table)
        d = self.session.use(m.name if m.name.lower() in self.session.names and m.name.lower() != m.table.lower() else m.table)
        have = {c.lower() for c in d.columns}
        shown = [c for c in m.columns if c.name.lower() not in hidden and (c.source.lower() in have or c.name.lower() in have)]
        return d.select(*[F.col(f"`{c.source if c.source.lower() in have else c.name}`").alias(c.name) for c in shown]).alias(m.name)

    def column(self, model: str, name: str) -> Column:
        c = next((c for c in self.registry.model(model).columns if name in (c.name, c.source)), None) or self.registry.model_column(model, name)
        hidden = self.session.policy.hidden_of(model, self.registry.model(model).table)
        if rule := hidden.get(c.name.lower()) or hidden.get(c.source.lower()):
            from ..errors import policy_denied

            raise policy_denied(rule, "The selection uses a column that is not visible.")
        return F.col(f"`{model}`.`{c.name}`")

    def reach(self, goal: str) -> None:
        at = self.joined[0]
        for r, back in self.registry.find_path(at, goal):
            to = r.fromModel if back else r.toModel
            if to not in self.joined:
                cond = F.lit(True)
                for a, b in r.joinKeys:
                    cond = cond & (self.column(r.fromModel, a) == self.column(r.toModel, b))
                self.frame = self.frame.join(self._of(to), cond, "inner")
                self.joined.append(to)
                if r.cardinality == "many-to-many" or r.cardinality == ("many-to-one" if back else "one-to-many"):
                    self.warnings.append(f"{r.name} leads to the many side: sums and counts may repeat rows")


def compile_selection(session: GovernedSession, registry: Registry, metric: str, dimensions: Sequence[str] = (), limit: int = DEFAULT_ROWS) -> Plan:
    """metric by dimensions ("model.column"), ordered by them, as a plan that may run."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit <= 0:
        raise ValueError("the limit is a positive whole number")
    if metric not in registry.metrics:
        raise ValueError(f"unknown metric {metric}")
    m = registry.metrics[metric]
    op, distinct, what = parse_metric(m.expression)
    f = _Frames(session, registry)
    f.base(m.model)
    dims = []
    for d in dimensions:
        model, _, column = d.partition(".")
        registry.model_column(model, column)
        f.reach(model)
        dims.append((f.column(model, column), f"{model}_{column}"))
    value = aggregate(op, distinct, F.lit(1) if what == "*" else f.column(m.model, what)).alias(metric)
    out = f.frame.groupBy(*[c.alias(a) for c, a in dims]).agg(value).orderBy(*[a for _, a in dims]) if dims else f.frame.agg(value)
    limit = min(limit, MAX_ROWS)
    out = out.limit(limit)
    policies = list(dict.fromkeys([f"limit:{limit}", "read-only", *session.policies({registry.model(x).table.lower() for x in f.joined})]))
    return mint(sql=selection_sql(registry, metric, dimensions, limit), params=(), applied_limit=limit, applied_policies=tuple([*policies, *f.warnings]), frame=out, ordered=bool(dims), relations=tuple(f.joined))


def selection_sql(registry: Registry, metric: str, dimensions: Sequence[str], limit: int) -> str:
    """The same selection as SQL, to be shown."""
    m = registry.metrics[metric]
    op, distinct, what = parse_metric(m.expression)
    name = lambda model, c: f"{model}.{next((x.source for x in registry.model(model).columns if x.name == c), c)}"
    joined, lines = [m.model], [f"FROM {registry.model(m.model).table} {m.model}"]
    for d in dimensions:
        for r, back in registry.find_path(m.model, d.partition(".")[0]):
            to = r.fromModel if back else r.toModel
            if to not in joined:
                joined.append(to)
                lines.append(f"JOIN {registry.model(to).table} {to} ON " + " AND ".join(f"{name(r.fromModel, a)} = {name(r.toModel, b)}" for a, b in r.joinKeys))
    dims = [(name(*d.split(".", 1)), d.replace(".", "_")) for d in dimensions]
    head = ", ".join([*(f"{c} AS {a}" for c, a in dims), f"{op.upper()}({'DISTINCT ' * distinct}{what if what == '*' else name(m.model, what)}) AS {metric}"])
    tail = [f"GROUP BY {', '.join(c for c, _ in dims)}", f"ORDER BY {', '.join(a for _, a in dims)}"] if dims else []
    return "\n".join([f"SELECT {head}", *lines, *tail, f"LIMIT {limit}"])


def compile_view(session: GovernedSession, registry: Registry, view: str, limit: int = DEFAULT_ROWS) -> Plan:
    """A view without metrics as its columns; with metrics, each by the view's columns."""
    v = registry.views[view]
    return _projection(session, registry, v.model, v.columns, v.metrics, limit)


def compile_cube(session: GovernedSession, registry: Registry, cube: str, limit: int = DEFAULT_ROWS) -> Plan:
    c = registry.cubes[cube]
    return _projection(session, registry, c.model, c.dimensions, c.measures, limit)


def _projection(session, registry, model, columns, metrics, limit) -> Plan:
    f = _Frames(session, registry)
    f.base(model)
    cols = [f.column(model, c).alias(c) for c in columns]
    if metrics:
        aggs = []
        for x in metrics:
            op, distinct, what = parse_metric(registry.metrics[x].expression)
            aggs.append(aggregate(op, distinct, F.lit(1) if what == "*" else f.column(model, what)).alias(x))
        out = f.frame.groupBy(*cols).agg(*aggs).orderBy(*columns)
    else:
        out = f.frame.select(*cols)
    limit = min(limit, MAX_ROWS)
    policies = [f"limit:{limit}", "read-only", *session.policies({registry.model(model).table.lower()})]
    return mint(sql=f"-- {model}", params=(), applied_limit=limit, applied_policies=tuple(policies), frame=out.limit(limit), relations=(model,))
