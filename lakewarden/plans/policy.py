"""Row and column policies of principals."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {"eq": "__eq__", "neq": "__ne__", "lt": "__lt__", "lte": "__le__", "gt": "__gt__", "gte": "__ge__"}
UNKNOWN_PRINCIPAL = "deny:unknown-principal"
_NAME, _WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_.:-]*"), re.compile(r"[A-Za-z_][A-Za-z0-9_$]*")


@dataclass(frozen=True)
class RowRule:
    name: str  # role:rule
    model: str
    column: str
    operator: str
    values: tuple

    def condition(self, column: Column) -> Column:
        """A null value compares as null, so the row is never let through."""
        if self.operator == "in":
            out = F.lit(False)
            for v in self.values:
                out = out | (column == F.lit(v))
            return out
        return getattr(column, OPERATORS[self.operator])(F.lit(self.values[0]))


@dataclass(frozen=True)
class Resolved:
    """What holds for one principal. hidden: (model, column) in lower case, with the rule's name."""

    principal: str
    allowed: bool
    roles: tuple[str, ...] = ()
    rows: tuple[RowRule, ...] = ()
    hidden: tuple[tuple[str, str, str], ...] = ()

    def rows_of(self, *names: str) -> list[RowRule]:
        n = {x.lower() for x in names}
        return [r for r in self.rows if r.model.lower() in n]

    def hidden_of(self, *names: str) -> dict[str, str]:
        n = {x.lower() for x in names}
        return {c: rule for m, c, rule in self.hidden if m in n}


OPEN = Resolved("", True)


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(f"policy: {what}")


class PolicyEngine:
    """document: {"roles": {name: {"rowFilters": [...], "hiddenColumns": [...]}}, "principals": {name: {"roles": [...]}}}."""

    def __init__(self, document: Mapping):
        _check(set(document) <= {"roles", "principals"}, "unknown keys")
        self.roles, self.principals = dict(document.get("roles", {})), dict(document.get("principals", {}))
        for role, body in self.roles.items():
            _check(bool(_NAME.fullmatch(role)) and set(body) <= {"rowFilters", "hiddenColumns"}, f"role {role}")
            for r in body.get("rowFilters", []):
                keys = {"name", "model", "column", "operator", "values" if r.get("operator") == "in" else "value"}
                _check(set(r) == keys and (r["operator"] in OPERATORS or r["operator"] == "in"), f"row filter {r.get('name')} of {role}")
                _check(bool(_NAME.fullmatch(r["name"])) and all(_WORD.fullmatch(r[k]) for k in ("model", "column")), f"names in row filter {r['name']}")
                values = r["values"] if r["operator"] == "in" else [r["value"]]
                _check(bool(values) and all(v is None or isinstance(v, (str, int, float, bool)) for v in values), f"values of {r['name']}")
            for h in body.get("hiddenColumns", []):
                _check(set(h) == {"name", "model", "columns"} and bool(h["columns"]), f"hidden columns {h.get('name')} of {role}")
        for who, body in self.principals.items():
            _check(bool(body.get("roles")) and set(body) == {"roles"}, f"principal {who}")
            for role in body["roles"]:
                _check(role in self.roles, f"principal {who} has the unknown role {role}")

    def resolve(self, principal: str) -> Resolved:
        """All row rules of all roles hold together; hidden columns add up. Who is not listed sees no row."""
        if principal not in self.principals:
            return Resolved(principal, False)
        roles = tuple(sorted(set(self.principals[principal]["roles"])))
        rows, hidden = [], {}
        for role in roles:
            for r in self.roles[role].get("rowFilters", []):
                rows.append(RowRule(f"{role}:{r['name']}", r["model"], r["column"], r["operator"], tuple(r["values"] if r["operator"] == "in" else [r["value"]])))
            for h in self.roles[role].get("hiddenColumns", []):
                for c in h["columns"]:
                    hidden.setdefault((h["model"].lower(), c.lower()), f"{role}:{h['name']}")
        return Resolved(principal, True, roles, tuple(sorted(rows, key=lambda r: r.name)), tuple((m, c, n) for (m, c), n in sorted(hidden.items())))
