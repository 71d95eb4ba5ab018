"""Joins, rules and metrics that a query log uses again and again."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import GovernanceError
from ..plans.syntax import _seq, parse


@dataclass
class Mined:
    joins: list[dict] = field(default_factory=list)
    rules: list[dict] = field(default_factory=list)
    metrics: list[dict] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line, sql): blanks and # comments are left out; the numbers are those of the file's lines."""
    # Lines are numbered within the part of the file that a task reads; the parts' sizes, one row each, give the rest.
    place = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    sizes = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    lines = lines.join(F.broadcast(before), "part").select((F.col("before") + F.col("i") + 1).cast("int").alias("line"), F.trim(F.regexp_replace("value", "\r$", "")).alias("sql"))
    return lines.where((F.col("sql") != "") & ~F.col("sql").startswith("#"))


def mine_rules(log: DataFrame, least: int = 2) -> DataFrame:
    """(name, rule, frequency) of WHERE clauses, by their text in lower case with single spaces; all in Spark."""
    rule = F.regexp_extract("sql", r"(?is)\bwhere\b(.*?)(?:\bgroup\s+by\b|\bhaving\b|\border\s+by\b|\blimit\b|;|$)", 1)
    key = F.trim(F.regexp_replace(F.lower(rule), r"\s+", " "))
    d = log.select(key.alias("rule")).where("rule <> ''").groupBy("rule").agg(F.count(F.lit(1)).alias("frequency")).where(F.col("frequency") >= least)
    name = F.concat(F.lit("rule_"), F.substring(F.regexp_replace(F.regexp_replace("rule", "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 48))
    return d.select(name.alias("name"), "rule", "frequency").orderBy(F.desc("frequency"), "rule")


def mine(spark: SparkSession, log: DataFrame, least: int = 2) -> Mined:
    """Everything that occurs `least` times or more (2 at least), most frequent first, and the lines that can't be read."""
    if least < 2:
        raise ValueError("what occurs once is not mined")
    joins: dict[tuple, int] = {}
    metrics: dict[tuple, int] = {}
    good, out = [], Mined()
    # A log is text for people; its lines are parsed one at a time by Catalyst's parser, which lives in the driver.
    for r in log.orderBy("line").toLocalIterator():
        try:
            st = parse(spark, r["sql"])
        except GovernanceError as e:
            out.warnings.append({"line": r["line"], "message": str(e)})
            continue
        good.append((r["line"], st.text))
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(st.text)
        names: dict[str, str] = {}
        found = {"joins": [], "aggs": []}
        _walk(plan, names, found, True)
        tables = list(dict.fromkeys(names.values()))
        for a, b in found["joins"]:
            pair = tuple(sorted((_full(a, names), _full(b, names))))
            if all(pair):
                joins[pair] = joins.get(pair, 0) + 1
        for op, distinct, what in found["aggs"]:
            model = names.get(what[0], what[0]) if len(what) > 1 else (tables[0] if tables else "")
            k = (model, f"{op}({'DISTINCT ' * distinct}{what[-1]})")
            metrics[k] = metrics.get(k, 0) + 1
    rank = lambda d: sorted(((k, n) for k, n in d.items() if n >= least), key=lambda x: (-x[1], x[0]))
    out.joins = [{"left": a, "right": b, "frequency": n} for (a, b), n in rank(joins)]
    out.metrics = [{"model": m, "expression": e, "frequency": n} for (m, e), n in rank(metrics)]
    if good:
        out.rules = [r.asDict() for r in mine_rules(spark.createDataFrame(good, "line int, sql string"), least).toLocalIterator()]
    return out


def _full(parts: list[str], names: dict[str, str]) -> str:
    return f"{names[parts[0]]}.{parts[1]}" if len(parts) == 2 and parts[0] in names else ""


def _kind(x) -> str:
    return x.getClass().getSimpleName()


def _walk(node, names: dict, found: dict, top: bool) -> None:
    kind = _kind(node)
    if kind == "SubqueryAlias" and _kind(node.children().apply(0)) == "UnresolvedRelation":
        names[str(node.alias())] = str(_seq(node.children().apply(0).multipartIdentifier())[-1])
        return
    if kind == "UnresolvedRelation":
        t = str(_seq(node.multipartIdentifier())[-1])
        names[t] = t
    if kind in ("Project", "Aggregate") and top:
        for e in _seq(node.projectList() if kind == "Project" else node.aggregateExpressions()):
            while _kind(e) in ("Alias", "UnresolvedAlias"):
                e = e.children().apply(0)
            if _kind(e) == "UnresolvedFunction" and (op := str(_seq(e.nameParts())[-1]).upper()) in ("COUNT", "SUM", "AVG", "MIN", "MAX"):
                args = _seq(e.children())
                if len(args) == 1:
                    a = args[0]
                    what = ["*"] if _kind(a) in ("UnresolvedStar", "Literal") else [str(x) for x in _seq(a.nameParts())] if _kind(a) == "UnresolvedAttribute" else None
                    if what:
                        found["aggs"].append((op, bool(e.isDistinct()), what))
        top = False
    for c in _seq(node.children()):
        _walk(c, names, found, top)
    if kind == "Join" and node.condition().isDefined():
        e = node.condition().get()
        if _kind(e) == "EqualTo" and all(_kind(x) == "UnresolvedAttribute" for x in _seq(e.children())):
            found["joins"].append(tuple([str(p) for p in _seq(x.nameParts())] for x in _seq(e.children())))
