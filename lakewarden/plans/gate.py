"""The SQL gate. Each principal works in a session of its own whose temporary views already hold the row and column policy, so
nothing a statement says (OR 1=1, UNION, self-join, CTE) reaches other rows or columns; Catalyst pushes the policy's filters to
the scan like any other. Around that: read-only by allow-list, a row limit, and a frozen plan."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GovernanceError, policy_denied, syntax_error, unknown
from ..functions.names import suggest
from ..semantic.model import Registry
from .bands import banded
from .policy import OPEN, UNKNOWN_PRINCIPAL, Resolved
from .syntax import Statement, parse

DEFAULT_ROWS, MAX_ROWS = 1000, 10_000
#: What a plan raises on the cluster where an arm of a $facet has more than MAX_ROWS rows.
FACET_TOO_LARGE = "LAKEWARDEN_FACET_TOO_LARGE"
_MINT = object()


@dataclass(frozen=True)
class Plan:
    """What may run: only the gate makes one."""

    sql: str
    params: tuple
    applied_limit: int | None
    applied_policies: tuple[str, ...]
    frame: DataFrame
    ordered: bool = False
    relations: tuple[str, ...] = ()
    token: object = None

    def __post_init__(self):
        if self.token is not _MINT:
            raise TypeError("plans come from the gate only")


def mint(**fields) -> Plan:
    return Plan(**fields, token=_MINT)


class GovernedSession:
    """The tables of one source as one principal sees them. A table's view is made when it is first named; tables may be given as
    functions that read them."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]], policy: Resolved = OPEN, registry: Registry | None = None):
        self.policy, self.registry, self.parent = policy, registry, spark
        if policy.hidden and registry is None:
            raise policy_denied("clac", "Column policies need a semantic model.")
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        self.names = {t.lower(): t for t in tables}
        self.columns: dict[str, list[str]] = {}
        self._tables = dict(tables)
        self._of: dict[str, object] = {}
        for m in registry.models.values() if registry else ():
            if m.name.lower() not in self.names and m.table in tables:
                self.names[m.name.lower()] = m.name
                self._of[m.name.lower()] = m

    def use(self, name: str) -> DataFrame:
        """The governed view of a table or model that is in names."""
        key = name.lower()
        if key not in self.columns:
            m = self._of.get(key)
            table = m.table if m else self.names[key]
            df = self._tables[table]
            df = df() if callable(df) and not isinstance(df, DataFrame) else df
            # Under a model's name its columns have their semantic names, and only the declared ones are there.
            if m:
                self._register(m.name, df, [m.name, m.table], {c.source: c.name for c in m.columns})
            else:
                self._register(table, df, [table, *(x.name for x in self._models(table))], {})
        return self.spark.table(self.names[key])

    def _models(self, table: str):
        return [m for m in self.registry.models.values() if m.table.lower() == table.lower()] if self.registry else []

    def _register(self, name: str, df: DataFrame, also: list[str], rename: dict[str, str]) -> None:
        view = governed(df, self.policy, also, {c.name.lower(): c.source for m in self._models(also[-1] if rename else name) for c in m.columns}, rename)
        self.columns[name.lower()] = view.columns
        # The view is made in the new session from the same plan; the parent's views stay out of sight.
        DataFrame(self._adopt(view), self.spark).createOrReplaceTempView(name)

    def _adopt(self, df: DataFrame):
        jvm = self.spark._jvm
        return jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.queryExecution().logical())

    def hidden(self, relations: set[str]) -> dict[str, str]:
        out: dict[str, str] = {}
        for r in relations:
            out |= self.policy.hidden_of(r, *(m.name for m in self._models(r)), *([self.registry.models[self.names[r]].table] if self.registry and self.names.get(r) in self.registry.models else []))
        return out

    def policies(self, relations: set[str]) -> list[str]:
        if not self.policy.allowed:
            return [UNKNOWN_PRINCIPAL]
        every = {x for r in relations for x in (r, *(m.name.lower() for m in self._models(r)))}
        clac = sorted({n for m, _, n in self.policy.hidden if m in every})
        return clac + sorted({r.name for r in self.policy.rows if r.model.lower() in every})


def governed(df: DataFrame, policy: Resolved, names: Sequence[str], sources: Mapping[str, str] | None = None, rename: Mapping[str, str] | None = None) -> DataFrame:
    """df as policy lets it be seen under any of names: rows first, for a rule may use a hidden column, then the columns."""
    if not policy.allowed:
        df = df.where(F.lit(False))
    by = {c.lower(): c for c in df.columns}
    for r in policy.rows_of(*names):
        c = by.get((sources or {}).get(r.column.lower(), r.column).lower()) or by.get(r.column.lower())
        if c is None:
            raise policy_denied(r.name, "A row policy names a column that is not there.")
        df = df.where(r.condition(F.col(f"`{c}`")))
    veil = set(policy.hidden_of(*names))
    veil |= {s.lower() for n, s in (sources or {}).items() if n in veil}
    shown = [c for c in df.columns if c.lower() not in veil and (not rename or c in rename)]
    return df.select(*[F.col(f"`{c}`").alias((rename or {}).get(c, c)) for c in shown])


def build_plan(session: GovernedSession, sql: str, params: Sequence = (), default: int = DEFAULT_ROWS, most: int = MAX_ROWS) -> Plan:
    """Parse, check, analyse under the policy, and limit."""
    st = parse(session.spark, sql)
    frame = analyse(session, st, params)
    limit = min(st.limit if st.limit is not None else default, most)
    if not session.policy.allowed and not st.relations:
        frame = frame.limit(0)
    policies = list(dict.fromkeys([f"limit:{limit}", "read-only", *session.policies(st.relations)]))
    return mint(sql=st.text, params=tuple(params), applied_limit=limit, applied_policies=tuple(policies), frame=frame.limit(limit), ordered=st.ordered, relations=tuple(sorted(st.relations)))


def analyse(session: GovernedSession, st: Statement, params: Sequence = ()) -> DataFrame:
    for r in sorted(st.relations):
        if r not in session.names:
            raise unknown("table", r, suggest(r, session.names.values()))
        session.use(r)
    marks = len(re.findall(r"\?", re.sub(r"'(?:[^'\\]|\\.|'')*'|`[^`]*`|--[^\n]*|/\*.*?\*/|\"[^\"]*\"", "", st.text, flags=re.S)))
    if marks != len(params):
        raise syntax_error(f"the statement has {marks} parameters and {len(params)} values were given")
    try:
        frame = session.spark.sql(st.text, args=list(params) if params else None)
    except AnalysisException as e:
        raise translate(session, st, e) from None
    return banded(frame)


def translate(session: GovernedSession, st: Statement, e: AnalysisException) -> GovernanceError:
    """Spark's error in the gate's words; its own suggestions could name anything."""
    condition, given = e.getCondition() or "", e.getMessageParameters() or {}
    name = re.sub(r"`", "", given.get("objectName", given.get("relationName", given.get("fieldName", ""))))
    last = name.split(".")[-1]
    if condition.startswith(("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND", "AMBIGUOUS_REFERENCE", "UNRESOLVED_FIELD")):
        if rule := session.hidden(st.relations).get(last.lower()):
            return policy_denied(rule, "The statement uses a column that is not visible.")
        known = {c for r in st.relations for c in session.columns.get(r, ())}
        return unknown("column", name or "?", suggest(last, known, session.hidden(st.relations)))
    if condition.startswith("TABLE_OR_VIEW_NOT_FOUND"):
        return unknown("table", name, suggest(last, session.names.values()))
    if condition.startswith("DATATYPE_MISMATCH") or "CAST" in condition:
        return GovernanceError("E_TYPE_MISMATCH", "The types of an expression do not fit.", expected=str(given.get("requiredType", given.get("left", "?"))), actual=str(given.get("inputType", given.get("right", "?"))))
    return syntax_error(condition.lower().replace("_", " ") or "the statement can't be analysed")


def dry_plan(session: GovernedSession, sql: str, params: Sequence = ()) -> dict:
    """What would run, resolved against the semantic model; nothing is executed or audited."""
    st = parse(session.spark, sql)
    if session.registry is None:
        raise ValueError("a dry plan needs a semantic model")
    tables = {m.table.lower(): m for m in session.registry.models.values()} | {m.name.lower(): m for m in session.registry.models.values()}
    for r in sorted(st.relations):
        if r not in tables:
            raise unknown("table", r, suggest(r, [m.name for m in session.registry.models.values()]))
    plan = build_plan(session, sql, params)
    warnings = [{"code": "E_UNVERIFIED_MODEL", "model": tables[r].name} for r in sorted(st.relations) if not tables[r].verified]
    return {"sql": plan.sql, "params": list(plan.params), "appliedLimit": plan.applied_limit, "appliedPolicies": list(plan.applied_policies), "columns": plan.frame.columns, "models": sorted({tables[r].name for r in st.relations}), "warnings": warnings}
