"""Reading SQL with Catalyst's own parser: one statement, read-only by an allow-list of plan nodes, and the facts that the gate
needs (relations, functions, row limit)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from ..errors import policy_denied, syntax_error, write_forbidden

#: Logical plan nodes of queries; anything else is refused.
READ_NODES = frozenset(
    "Project Aggregate UnresolvedHaving Distinct Union Intersect Except Sort GlobalLimit LocalLimit LimitAll Offset UnresolvedWith UnresolvedRelation LocalRelation Filter Join "
    "SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction OneRowRelation UnresolvedInlineTable LateralJoin Generate Window WithWindowDefinition Pivot "
    "UnresolvedPivot Unpivot Sample Range UnresolvedHint RepartitionByExpression Repartition UnresolvedOrdinal Deduplicate InlineTable ResolvedInlineTable UnresolvedTVFAliases "
    "UnionLoop UnionLoopRef".split()
)
#: Functions that leave the engine.
FUNCTIONS_REFUSED = frozenset({"reflect", "java_method", "try_reflect", "input_file_name", "read_files"})
_VERBS = {
    "DeleteFromTable": "delete", "DropTable": "drop", "DropView": "drop", "InsertIntoStatement": "insert", "UpdateTable": "update", "MergeIntoTable": "merge", "TruncateTable": "truncate",
    "CreateTableAsSelect": "create", "CreateTable": "create", "CreateViewCommand": "create", "CreateView": "create", "SetCommand": "set", "ExplainCommand": "explain", "CompoundBody": "script",
    "UnresolvedExecuteImmediate": "execute", "ScriptTransformation": "transform", "CacheTable": "cache", "Call": "call", "DescribeRelation": "describe", "ShowTables": "show",
}


@dataclass
class Statement:
    text: str
    relations: set[str] = field(default_factory=set)
    functions: set[str] = field(default_factory=set)
    ctes: set[str] = field(default_factory=set)
    limit: int | None = None
    ordered: bool = False
    nodes: set[str] = field(default_factory=set)


def split_statements(sql: str) -> list[tuple[list[str], str]]:
    """(bare words and symbols, text) of each statement; strings, quoted names and comments are not looked into."""
    out, words, start, i = [], [], 0, 0
    pattern = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|[A-Za-z_][A-Za-z0-9_]*|\S", re.S)
    for m in pattern.finditer(sql):
        t = m[0]
        if t == ";":
            out.append((words, sql[start : m.start()]))
            words, start = [], m.end()
        elif not t.startswith(("--", "/*")):
            words.append(t.lower() if re.match(r"[A-Za-z_(]", t) else t[0])
        i = m.end()
    out.append((words, sql[start:]))
    return [x for x in out if x[0]]


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


class _Walk:
    def __init__(self, st: Statement):
        self.st = st

    def plan(self, node, scope: frozenset[str]) -> None:
        name = node.nodeName()
        kind = node.getClass().getSimpleName()
        self.st.nodes.add(kind)
        if kind not in READ_NODES and name not in READ_NODES:
            raise write_forbidden(_VERBS.get(kind, kind.lower()))
        if kind == "UnresolvedRelation":
            parts = [str(x) for x in _seq(node.multipartIdentifier())]
            if len(parts) > 1:
                raise policy_denied("relation-name", "Relations are named without a catalog, a schema or a path.")
            if parts[0].lower() not in scope:
                self.st.relations.add(parts[0].lower())
        if kind == "UnresolvedTableValuedFunction":
            self.st.functions.add(".".join(str(x) for x in _seq(node.name())).lower())
        if kind == "UnresolvedWith":
            for pair in _seq(node.cteRelations()):
                name_of = str(pair._1()).lower()
                # Under WITH RECURSIVE a query may name itself.
                self.plan(pair._2(), scope | {name_of} if node.allowRecursion() else scope)
                scope = scope | {name_of}
                self.st.ctes.add(str(pair._1()).lower())
        for e in _seq(node.expressions()):
            self.expr(e, scope)
        for c in _seq(node.children()):
            self.plan(c, scope)

    def expr(self, e, scope: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            self.st.functions.add(str(_seq(e.nameParts())[-1]).lower())
        if kind in ("Exists", "ScalarSubquery", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            self.plan(e.plan(), scope)
        for c in _seq(e.children()):
            self.expr(c, scope)


def _top(node) -> tuple[int | None, bool]:
    """(literal limit, whether there is an ORDER BY) of the outermost query."""
    kind, limit, ordered = node.getClass().getSimpleName(), None, False
    while kind in ("GlobalLimit", "LocalLimit", "Offset", "Sort", "UnresolvedWith", "LimitAll"):
        if kind == "GlobalLimit" and limit is None and node.limitExpr().getClass().getSimpleName() == "Literal":
            limit = int(str(node.limitExpr().value()))
        ordered = ordered or kind == "Sort"
        node = node.children().apply(0)
        kind = node.getClass().getSimpleName()
    return limit, ordered


def parse(spark: SparkSession, sql: str) -> Statement:
    """The statement's facts, or E_PARSE, E_WRITE_FORBIDDEN or E_POLICY_DENIED. Nothing is resolved or run."""
    if not isinstance(sql, str) or not (parts := split_statements(sql)):
        raise syntax_error("statement is empty")
    if len(parts) > 1:
        raise write_forbidden("multi-statement", f"Send one statement; found {len(parts)}: {', '.join(w[0] for w, _ in parts)}.")
    words, text = parts[0]
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise _classify(words, e) from None
    st = Statement(text.strip())
    _Walk(st).plan(plan, frozenset())
    if bad := st.functions & FUNCTIONS_REFUSED:
        raise policy_denied("function", f"Function {min(bad)} is not permitted.")
    st.limit, st.ordered = _top(plan)
    return st


def _classify(words: list[str], e: Exception):
    """What Catalyst's grammar refuses may still be a write by intent."""
    depth = 0
    for i, w in enumerate(words):
        depth += (w == "(") - (w == ")")
        if w == "(" and i and words[i - 1] == "as" and i + 1 < len(words) and words[i + 1] in ("insert", "update", "delete", "merge"):
            return write_forbidden(words[i + 1])
        if w == "into" and depth == 0 and words[0] in ("select", "with") and "from" not in words[:i]:
            return write_forbidden("select-into")
    if words[0] in ("insert", "update", "delete", "merge", "drop", "alter", "create", "truncate", "grant", "revoke", "copy", "vacuum"):
        return write_forbidden(words[0])
    text = str(e.java_exception if hasattr(e, "java_exception") else e)
    at = re.search(r"line (\d+), pos (\d+)", text)
    what = re.search(r"Syntax error at or near ([^\n.]+)", text)
    near = f"syntax error near {what[1].strip()}" if what else ("syntax error" if not isinstance(e, ParseException) else (e.getCondition() or "syntax error"))
    return syntax_error(near, int(at[1]) if at else None, int(at[2]) + 1 if at else None, "Statements follow Spark SQL's grammar.")
