"""JSON queries on nested tables: five read operations; pipelines are compiled, stage by stage, to DataFrame operations over the
caller's governed tables. A stage or operator that is not known is refused, never skipped. A $facet gathers each arm into one
row; an arm of more than MAX_ROWS rows is refused when the plan runs (E_RESULT_TOO_LARGE), never cut. Where only an arm's $size is
asked for, its rows are counted and not gathered, however many."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import partial
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import policy_denied, unknown, write_forbidden
from ..functions.names import suggest
from .gate import DEFAULT_ROWS, FACET_TOO_LARGE, MAX_ROWS, GovernedSession, Plan, mint

OPERATIONS = ("find", "findOne", "aggregate", "countDocuments", "distinct")
STAGES_MOST = 50
WRITES = ("$out", "$merge")


def _refuse(what: str):
    return policy_denied("mongo-query-shape", what)


def _frozen(v):
    if isinstance(v, Mapping):
        return MappingProxyType({k: _frozen(x) for k, x in v.items()})
    return tuple(_frozen(x) for x in v) if isinstance(v, (list, tuple)) else v


@dataclass(frozen=True)
class DocumentPlan:
    """payload is frozen; plan is None for a count, whose frame has one row."""

    payload: Mapping
    applied_limit: int | None
    applied_policies: tuple[str, ...]
    plan: Plan

    def result(self, rows: list[dict]):
        """What the operation answers: findOne a document or None, countDocuments a number, all others a list."""
        op = self.payload.get("operation", self.payload.get("op"))
        if op == "countDocuments":
            return rows[0]["count"]
        return (rows[0] if rows else None) if op == "findOne" else rows


#: Types by their names in a filter.
_KINDS = {
    "string": ("string",), "bool": ("boolean",), "int": ("integer", "short", "byte"), "long": ("long",), "double": ("double", "float"), "decimal": ("decimal",),
    "date": ("timestamp", "timestamp_ntz", "date"), "array": ("array",), "object": ("struct", "map"), "number": ("integer", "short", "byte", "long", "double", "float", "decimal"),
}
#: Parts of a date, by their mark in a format.
_DATE = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%L": "SSS", "%j": "DDD"}


def _count(v, what: str, least: int) -> int:
    if isinstance(v, bool) or not isinstance(v, int) or v < least or v > 2**53 - 1:
        raise _refuse(f"{what} is a whole number from {least}")
    return v


def _no_writes(v) -> None:
    if isinstance(v, Mapping):
        for k, x in v.items():
            if k in WRITES:
                raise write_forbidden(k)
            _no_writes(x)
    elif isinstance(v, (list, tuple)):
        for x in v:
            _no_writes(x)


def build_document_plan(session: GovernedSession, payload, default: int = DEFAULT_ROWS, most: int = MAX_ROWS) -> DocumentPlan:
    if isinstance(payload, str):
        try:
            payload = json.loads(payload)
        except ValueError:
            raise _refuse("the query is not JSON") from None
    if not isinstance(payload, Mapping):
        raise _refuse("the query is an object")
    op = payload.get("operation", payload.get("op"))
    if op not in OPERATIONS:
        raise write_forbidden(str(op), f"Permitted: {', '.join(OPERATIONS)}.")
    name = payload.get("collection")
    if not isinstance(name, str) or not name:
        raise _refuse("the query names a collection")
    if name.lower() not in session.names:
        raise unknown("table", name, suggest(name, session.names.values()))
    _no_writes(payload)
    c = Compiler(session)
    df, limit, policies = c.table(name), None, []
    if op in ("find", "findOne"):
        df = c.where(df, payload.get("filter", {}))
        if sort := payload.get("sort"):
            df = c.sort(df, sort)
        if "skip" in payload:
            df = df.offset(_count(payload["skip"], "skip", 0))
        limit = 1 if op == "findOne" else min(_count(payload["limit"], "limit", 1) if "limit" in payload else default, most)
        df = c.project(df.limit(limit), payload["projection"]) if payload.get("projection") else df.limit(limit)
    elif op == "aggregate":
        stages = payload.get("pipeline")
        if not isinstance(stages, (list, tuple)):
            raise _refuse("a pipeline is a list")
        if len(stages) > STAGES_MOST:
            raise policy_denied("mongo-stage-limit", f"A pipeline has at most {STAGES_MOST} stages.")
        for s in stages:
            if not isinstance(s, Mapping) or len(s) != 1 or not next(iter(s)).startswith("$"):
                raise _refuse("a stage has exactly one $operator")
        given = [_count(s["$limit"], "$limit", 1) for s in stages if "$limit" in s]
        limit = min([*given, most] if given else [default, most])
        last = stages and "$limit" in stages[-1]
        df = c.pipeline(df, stages[:-1] if last else stages).limit(limit)
        payload = {**payload, "pipeline": [*(stages[:-1] if last else stages), {"$limit": limit}]}
    elif op == "countDocuments":
        df = c.where(df, payload.get("filter", {})).agg(F.count(F.lit(1)).alias("count"))
    else:
        field = payload.get("field")
        if not isinstance(field, str) or not field:
            raise _refuse("distinct names a field")
        limit = min(_count(payload["limit"], "limit", 1) if "limit" in payload else most, most)
        df = c.distinct(c.where(df, payload.get("filter", {})), field).limit(limit)
    names = {name.lower()} | c.used
    policies = [*([f"limit:{limit}"] if limit else []), *([f"facet-refuse-over:{MAX_ROWS}"] if c.facets else []), "read-only", *session.policies(names)]
    frozen = _frozen(payload)
    plan = mint(sql=json.dumps(payload, sort_keys=True), params=(), applied_limit=limit, applied_policies=tuple(policies), frame=df, relations=tuple(sorted(names)))
    return DocumentPlan(frozen, limit, tuple(policies), plan)


class Compiler:
    def __init__(self, session: GovernedSession):
        self.session, self.used, self.facets = session, set(), False
        self.names: dict[str, Column] = {}  # of $map and $filter
        self.order: Mapping | None = None  # of the last $sort, while it holds

    def table(self, name: str) -> DataFrame:
        if name.lower() not in self.session.names:
            raise unknown("table", name, suggest(name, self.session.names.values()))
        self.used.add(name.lower())
        return self.session.use(name)

    def field(self, df: DataFrame, path: str) -> Column:
        """A dotted path; its first part must be a visible column."""
        first = path.split(".")[0]
        if first.lower() not in {c.lower() for c in df.columns}:
            hidden = self.session.hidden(self.used)
            if rule := hidden.get(first.lower()):
                raise policy_denied(rule, "The query uses a field that is not visible.")
            raise unknown("column", path, suggest(first, df.columns, hidden))
        return F.col(".".join(f"`{p}`" for p in path.split(".")))

    # $match
    def where(self, df: DataFrame, query: Mapping) -> DataFrame:
        return df.where(self.condition(df, query)) if query else df

    def condition(self, df: DataFrame, query: Mapping) -> Column:
        if not isinstance(query, Mapping):
            raise _refuse("a filter is an object")
        out = F.lit(True)
        for k, v in query.items():
            if k in ("$and", "$or", "$nor"):
                if not isinstance(v, (list, tuple)) or not v:
                    raise _refuse(f"{k} takes a list")
                parts = [self.condition(df, x) for x in v]
                c = parts[0]
                for p in parts[1:]:
                    c = c & p if k == "$and" else c | p
                out = out & (~F.coalesce(c, F.lit(False)) if k == "$nor" else c)
            elif k == "$expr":
                out = out & self.expr(df, v)
            elif k.startswith("$"):
                raise _refuse(f"{k} is not supported in a filter")
            else:
                c = self.field(df, k)
                out = out & self._test(c, df.select(c.alias("x")).schema["x"].dataType, v)
        return out

    def _element(self, x: Column, kind: T.DataType, v) -> Column:
        """Whether one element of an array fits an $elemMatch."""
        if not isinstance(v, Mapping) or not v:
            raise _refuse("$elemMatch takes an object")
        if all(k.startswith("$") for k in v):
            return F.coalesce(self._test(x, kind, v), F.lit(False))
        out = F.lit(True)
        for path, test in v.items():
            c, t = x, kind
            for part in path.split("."):
                if not isinstance(t, T.StructType) or part not in t.names:
                    raise unknown("column", path, [])
                c, t = c[part], t[part].dataType
            out = out & F.coalesce(self._test(c, t, test), F.lit(False))
        return out

    def _test(self, c: Column, kind: T.DataType, v) -> Column:
        many = isinstance(kind, T.ArrayType)
        each = lambda t: F.exists(c, lambda y: t(y)) if many else t(c)
        if not (isinstance(v, Mapping) and v and all(k.startswith("$") for k in v)):
            return c.isNull() if v is None else each(lambda x: x == F.lit(v))
        out = F.lit(True)
        for k, x in v.items():
            if k == "$options":
                continue
            if k == "$eq":
                t = c.isNull() if x is None else each(lambda y, x=x: y == F.lit(x))
            elif k == "$ne":
                t = c.isNotNull() if x is None else ~F.coalesce(each(lambda y, x=x: y == F.lit(x)), F.lit(False))
            elif k in ("$gt", "$gte", "$lt", "$lte"):
                t = each(lambda y, k=k, x=x: {"$gt": y > F.lit(x), "$gte": y >= F.lit(x), "$lt": y < F.lit(x), "$lte": y <= F.lit(x)}[k])
            elif k in ("$in", "$nin"):
                if not isinstance(x, (list, tuple)):
                    raise _refuse(f"{k} takes a list")
                t = each(lambda y, x=x: y.isin([z for z in x if z is not None])) if x else F.lit(False)
                t = F.coalesce(t, F.lit(False)) | (c.isNull() if None in x else F.lit(False))
                t = t if k == "$in" else ~t
            elif k == "$exists":
                t = c.isNotNull() if x else c.isNull()
            elif k == "$regex":
                t = each(lambda y, x=x: y.rlike(("(?i)" if "i" in v.get("$options", "") else "") + x))
            elif k == "$not":
                t = ~F.coalesce(self._test(c, kind, x), F.lit(False))
            elif k == "$size":
                t = F.size(c) == x
            elif k == "$all" and many and isinstance(x, (list, tuple)):
                t = F.lit(bool(x))
                for y in x:
                    t = t & F.array_contains(c, y)
            elif k == "$elemMatch" and many:
                one = partial(self._element, kind=kind.elementType, v=x)
                t = F.exists(c, lambda y: one(y))  # noqa: B023
            elif k == "$mod" and isinstance(x, (list, tuple)) and len(x) == 2:
                t = each(lambda y, x=x: y % x[0] == x[1])
            elif k == "$type":
                names = _KINDS.get(x)
                if names is None:
                    raise _refuse("$type takes the name of a type")
                t = F.lit(kind.typeName() in names) & c.isNotNull()
            else:
                raise _refuse(f"{k} is not supported in a filter")
            out = out & t
        return out

    # expressions of $group, $project and $addFields
    def expr(self, df: DataFrame, e) -> Column:
        if isinstance(e, str) and e.startswith("$$"):
            first, *rest = e[2:].split(".")
            if first not in self.names:
                raise _refuse(f"$${first} is not a variable here")
            c = self.names[first]
            for part in rest:
                c = c[part]
            return c
        if isinstance(e, str) and e.startswith("$"):
            return self.field(df, e[1:])
        if isinstance(e, Mapping) and len(e) == 1 and next(iter(e)).startswith("$"):
            k, v = next(iter(e.items()))
            if k == "$literal":
                return self._literal(v)
            if k == "$size" and isinstance(v, str) and f"__size_{v[1:]}" in df.columns:
                return F.col(f"`__size_{v[1:]}`")
            if isinstance(v, Mapping) and k in ("$cond", "$switch", "$dateToString", "$map", "$filter", "$trim"):
                return self._named(df, k, v)
            args = [self.expr(df, x) for x in (v if isinstance(v, (list, tuple)) else [v])]
            two = {
                "$subtract": lambda a, b: a - b, "$divide": lambda a, b: a / b, "$mod": lambda a, b: a % b, "$eq": lambda a, b: a == b, "$ne": lambda a, b: a != b, "$gt": lambda a, b: a > b,
                "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b, "$ifNull": lambda a, b: F.coalesce(a, b), "$pow": F.pow,
                "$in": lambda a, b: F.array_contains(b, a), "$arrayElemAt": lambda a, b: F.get(a, F.when(b < 0, F.size(a) + b).otherwise(b)), "$setUnion": F.array_union, "$setIntersection": F.array_intersect,
            }
            one = {
                "$toUpper": F.upper, "$toLower": F.lower, "$abs": F.abs, "$size": F.size, "$year": F.year, "$month": F.month, "$dayOfMonth": F.dayofmonth, "$hour": F.hour, "$strLenCP": F.length,
                "$not": lambda a: ~F.coalesce(a, F.lit(False)), "$floor": F.floor, "$ceil": F.ceil, "$sqrt": F.sqrt, "$toString": lambda a: a.cast("string"), "$toInt": lambda a: a.cast("int"),
                "$toLong": lambda a: a.cast("long"), "$toDouble": lambda a: a.cast("double"), "$reverseArray": F.reverse,
            }
            if k in two and len(args) == 2:
                return two[k](*args)
            if k in one and len(args) == 1:
                return one[k](args[0])
            if k in ("$add", "$multiply", "$and", "$or"):
                out = args[0]
                for a in args[1:]:
                    out = {"$add": out + a, "$multiply": out * a}[k] if k in ("$add", "$multiply") else out & a if k == "$and" else out | a
                return out
            if k in ("$min", "$max") and len(args) > 1:
                return (F.least if k == "$min" else F.greatest)(*args)
            if k == "$concat":
                return F.concat(*args)
            if k == "$concatArrays":
                return F.concat(*args)
            if k == "$substrCP" and len(args) == 3:
                return F.substr(args[0], args[1] + 1, args[2])
            if k == "$round" and len(args) in (1, 2):
                return F.round(args[0], v[1] if len(args) == 2 else 0)
            if k == "$cond" and len(args) == 3:
                return F.when(args[0], args[1]).otherwise(args[2])
            raise _refuse(f"{k} is not supported in an expression")
        if isinstance(e, Mapping):
            return F.struct(*[self.expr(df, v).alias(k) for k, v in e.items()])
        if isinstance(e, (list, tuple)):
            return F.array(*[self.expr(df, x) for x in e])
        return F.lit(e)

    def _literal(self, v) -> Column:
        """v as it is: a string with a dollar is a string."""
        if isinstance(v, Mapping):
            return F.struct(*[self._literal(x).alias(k) for k, x in v.items()])
        return F.array(*[self._literal(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)

    def _named(self, df: DataFrame, k: str, v: Mapping) -> Column:
        """Operators whose arguments have names."""
        want = {"$cond": {"if", "then", "else"}, "$switch": {"branches", "default"}, "$dateToString": {"format", "date"}, "$map": {"input", "as", "in"}, "$filter": {"input", "as", "cond"}, "$trim": {"input"}}[k]
        if not set(v) <= want or not want - {"as", "default"} <= set(v):
            raise _refuse(f"{k} has {', '.join(sorted(want))}")
        if k == "$cond":
            return F.when(self.expr(df, v["if"]), self.expr(df, v["then"])).otherwise(self.expr(df, v["else"]))
        if k == "$switch":
            out = None
            for b in v["branches"]:
                when = F.when if out is None else out.when
                out = when(self.expr(df, b["case"]), self.expr(df, b["then"]))
            if out is None:
                raise _refuse("$switch has branches")
            return out.otherwise(self.expr(df, v["default"])) if "default" in v else out
        if k == "$dateToString":
            marks = re.findall(r"%.|[^%]+", v["format"])
            if any(m[0] == "%" and m not in _DATE for m in marks):
                raise _refuse("the date's format has a mark that is not supported")
            return F.date_format(self.expr(df, v["date"]), "".join(_DATE.get(m) or "'" + m.replace("'", "''") + "'" for m in marks))
        if k == "$trim":
            return F.trim(self.expr(df, v["input"]))
        name, held = v.get("as", "this"), dict(self.names)

        def body(x: Column) -> Column:
            self.names = held | {name: x}
            try:
                return self.expr(df, v["in" if k == "$map" else "cond"])
            finally:
                self.names = held

        return (F.transform if k == "$map" else F.filter)(self.expr(df, v["input"]), body)

    def project(self, df: DataFrame, spec: Mapping) -> DataFrame:
        if not spec:
            raise _refuse("a projection has fields")
        off = [k for k, v in spec.items() if v in (0, False) and not isinstance(v, str)]
        if len(off) == len(spec):
            for k in off:
                self.field(df, k)
            return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in off])
        if any(k != "_id" for k in off):
            raise _refuse("a projection takes fields in or out, not both")
        keep = [] if "_id" in off or "_id" in spec or "_id" not in df.columns else [F.col("_id")]
        return df.select(*keep, *[(self.field(df, k) if v in (1, True) and not isinstance(v, str) else self.expr(df, v)).alias(k) for k, v in spec.items() if k not in off])

    def sort(self, df: DataFrame, spec: Mapping) -> DataFrame:
        if not isinstance(spec, Mapping) or not spec or any(v not in (1, -1) for v in spec.values()):
            raise _refuse("a sort is 1 or -1 a field")
        # A missing value is the least one.
        return df.orderBy(*[self.field(df, k).asc_nulls_first() if v == 1 else self.field(df, k).desc_nulls_last() for k, v in spec.items()])

    def group(self, df: DataFrame, spec: Mapping) -> DataFrame:
        if "_id" not in spec:
            raise _refuse("$group has an _id")
        aggs = []
        ops = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max, "$first": F.first, "$last": F.last, "$push": F.collect_list, "$addToSet": lambda c: F.sort_array(F.collect_set(c)), "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp}
        key = F.lit(None).cast("string") if spec["_id"] is None else self.expr(df, spec["_id"])
        by = None
        if self.order and any(isinstance(v, Mapping) and ("$first" in v or "$last" in v) for v in spec.values()):
            cols, ways = [self.field(df, n) for n in self.order], set(self.order.values())
            if len(ways) == 1:  # one direction: the extreme key says which row
                by, up = F.struct(*cols), ways == {1}
                ops["$first"], ops["$last"] = (lambda c: F.min_by(c, by) if up else F.max_by(c, by)), (lambda c: F.max_by(c, by) if up else F.min_by(c, by))
            else:
                w = Window.partitionBy(key).orderBy(*[c.asc_nulls_first() if d == 1 else c.desc_nulls_last() for c, d in zip(cols, self.order.values(), strict=True)])
                w = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
                for i, (n, v) in enumerate(list(spec.items())):
                    if isinstance(v, Mapping) and next(iter(v), "") in ("$first", "$last"):
                        op = next(iter(v))
                        df = df.withColumn(f"__{i}", (F.first if op == "$first" else F.last)(self.expr(df, v[op])).over(w))
                        spec = {**spec, n: {"$first": f"$__{i}"}}
        for k, v in spec.items():
            if k == "_id":
                continue
            if not isinstance(v, Mapping) or len(v) != 1 or ((op := next(iter(v))) not in ops and op != "$count"):
                raise _refuse(f"{k} is not an accumulator that is supported")
            aggs.append((F.count(F.lit(1)) if op == "$count" else F.coalesce(F.sum(self.expr(df, v[op])), F.lit(0)) if op == "$sum" else ops[op](self.expr(df, v[op]))).alias(k))
        if not aggs:
            return df.select(key.alias("_id")).distinct()
        return df.agg(*aggs).select(F.lit(None).cast("string").alias("_id"), "*") if spec["_id"] is None else df.groupBy(key.alias("_id")).agg(*aggs)

    def unwind(self, df: DataFrame, spec) -> DataFrame:
        path = spec if isinstance(spec, str) else spec.get("path", "")
        keep = isinstance(spec, Mapping) and spec.get("preserveNullAndEmptyArrays", False)
        index = spec.get("includeArrayIndex") if isinstance(spec, Mapping) else None
        if not path.startswith("$"):
            raise _refuse("$unwind takes a path")
        name, *inner = path[1:].split(".")
        c = self.field(df, path[1:])
        if not isinstance(df.select(c.alias("x")).schema["x"].dataType, T.ArrayType):
            df = df if keep else df.where(c.isNotNull())
            return df.withColumn(index, F.lit(None).cast("long")) if index else df
        out = df.select(*[F.col(f"`{x}`") for x in df.columns], (F.posexplode_outer if keep else F.posexplode)(c).alias("__at", "__one"))
        one = F.col("__one") if not inner else F.col(f"`{name}`").withField(".".join(f"`{p}`" for p in inner), F.col("__one"))
        tail = [F.col("__at").cast("long").alias(index)] if index else []
        return out.select(*[one.alias(x) if x == name else F.col(f"`{x}`") for x in df.columns if x != index], *tail)

    def lookup(self, df: DataFrame, spec: Mapping) -> DataFrame:
        if set(spec) - {"pipeline"} != {"from", "localField", "foreignField", "as"}:
            raise _refuse("$lookup has from, localField, foreignField, as, and a pipeline if wanted")
        inner = spec.get("pipeline", [])
        if any(next(iter(x), "") not in ("$match", "$addFields", "$set", "$unset") for x in inner):
            raise _refuse("the pipeline of $lookup has stages that work row by row")
        other = self.pipeline(self.table(spec["from"]), inner)
        key = self.field(other, spec["foreignField"])
        groups = other.where(key.isNotNull()).groupBy(key.alias("__key")).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in other.columns])).alias("__as"))
        out = df.join(groups, self.field(df, spec["localField"]) == F.col("__key"), "left")
        kept = [F.col(f"`{c}`") for c in df.columns if c != spec["as"]]
        return out.select(*kept, F.coalesce(F.col("__as"), F.array().cast(groups.schema["__as"].dataType)).alias(spec["as"]))

    def bucket(self, df: DataFrame, spec: Mapping) -> DataFrame:
        """$bucket: _id is the lower boundary of the bucket, or default."""
        edges = spec.get("boundaries")
        if not isinstance(edges, (list, tuple)) or len(edges) < 2 or list(edges) != sorted(edges) or set(spec) - {"groupBy", "boundaries", "default", "output"}:
            raise _refuse("$bucket has groupBy, rising boundaries, and default and output if wanted")
        x, found = self.expr(df, spec["groupBy"]), None
        for a, b in zip(edges, edges[1:], strict=False):
            when = F.when if found is None else found.when
            found = when((x >= F.lit(a)) & (x < F.lit(b)), F.lit(a))
        if "default" in spec:
            same = isinstance(spec["default"], str) == isinstance(edges[0], str)
            found = F.coalesce(found, F.lit(spec["default"])) if same else F.coalesce(found.cast("string"), F.lit(str(spec["default"])))
        else:
            found = F.coalesce(found, F.raise_error(F.lit("$bucket: a value lies outside the boundaries")).cast("double" if any(isinstance(e, float) for e in edges) else "string" if isinstance(edges[0], str) else "int"))
        return self.group(df.withColumn("__bucket", found), {"_id": "$__bucket", **(spec.get("output") or {"count": {"$sum": 1}})})

    def windows(self, df: DataFrame, spec: Mapping) -> DataFrame:
        """$setWindowFields: each output over the rows of its partition, in order."""
        if set(spec) - {"partitionBy", "sortBy", "output"} or not spec.get("output"):
            raise _refuse("$setWindowFields has partitionBy, sortBy and output")
        w = Window.partitionBy(self.expr(df, spec["partitionBy"])) if spec.get("partitionBy") is not None else Window.partitionBy()
        sort = [self.field(df, k).asc_nulls_first() if d == 1 else self.field(df, k).desc_nulls_last() for k, d in (spec.get("sortBy") or {}).items()]
        w = w.orderBy(*sort) if sort else w
        ops = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max, "$first": F.first, "$last": F.last}
        ranks = {"$rank": F.rank, "$denseRank": F.dense_rank, "$documentNumber": F.row_number}
        out = {}
        for name, o in spec["output"].items():
            op = next((k for k in o if k.startswith("$")), "")
            if op in ranks and sort:
                out[name] = ranks[op]().over(w)
                continue
            if op not in ops and op != "$count" or set(o) - {op, "window"}:
                raise _refuse(f"{op or name} is not supported in $setWindowFields")
            edges = [Window.unboundedPreceding, Window.unboundedFollowing]
            if given := (o.get("window") or {}).get("documents"):
                edges = [{"unbounded": edges[i], "current": 0}.get(x, x) for i, x in enumerate(given)]
            value = F.count(F.lit(1)) if op == "$count" else ops[op](self.expr(df, o[op]))
            out[name] = value.over(w.rowsBetween(*edges) if sort or edges[0] != Window.unboundedPreceding else w)
        return df.withColumns(out)

    def facet(self, df: DataFrame, arms: Mapping, after: Mapping | None) -> DataFrame:
        """One row. Beside each arm, under a name of its own, how many rows it has, for an $size in the next stage."""
        self.facets = True
        text = json.dumps(after, default=lambda x: dict(x) if isinstance(x, Mapping) else list(x)) if after else ""
        df_out = None
        for n, stages in arms.items():
            order, self.order = self.order, None
            arm = self.pipeline(df, stages)
            self.order = order
            parts = []
            if f'{{"$size": "${n}"}}' in text:
                parts.append(arm.agg(F.count(F.lit(1)).cast("int").alias(f"__size_{n}")))
            if not parts or text.count(f'"${n}') > text.count(f'{{"$size": "${n}"}}') or f'"{n}"' in text:
                # One row more than is allowed tells that an arm has too many, and bounds what is gathered until then.
                parts.append(arm.limit(MAX_ROWS + 1).agg(F.collect_list(F.struct("*")).alias("__arm")).select(self.bounded(F.col("__arm")).alias(n)))
            for p in parts:
                df_out = p if df_out is None else df_out.crossJoin(p)  # one row each
        if df_out is None:
            raise _refuse("$facet has arms")
        return df_out

    def distinct(self, df: DataFrame, path: str) -> DataFrame:
        c = self.field(df, path)
        flat = df.select(c.alias("value"))
        if isinstance(flat.schema["value"].dataType, T.ArrayType):
            flat = flat.select(F.explode("value").alias("value"))
        return flat.where("value is not null").distinct().orderBy("value")

    @staticmethod
    def bounded(arm: Column) -> Column:
        """arm, or an error that execute() turns into E_RESULT_TOO_LARGE."""
        return F.when(F.size(arm) > MAX_ROWS, F.raise_error(F.lit(FACET_TOO_LARGE))).otherwise(arm)

    def pipeline(self, df: DataFrame, stages) -> DataFrame:
        for at, s in enumerate(stages):
            k, v = next(iter(s.items()))
            if k == "$match":
                df = self.where(df, v)
            elif k == "$project":
                df = self.project(df, v)
            elif k in ("$addFields", "$set"):
                df = df.withColumns({n: self.expr(df, e) for n, e in v.items()})
            elif k == "$unset":
                df = self.project(df, {n: 0 for n in ([v] if isinstance(v, str) else v)})
            elif k in ("$replaceRoot", "$replaceWith"):
                root = self.expr(df, v["newRoot"] if k == "$replaceRoot" else v)
                one = df.select(root.alias("r"))
                if not isinstance(one.schema["r"].dataType, T.StructType):
                    raise _refuse(f"{k} takes an object")
                df = one.select("r.*")
            elif k == "$group":
                df = self.group(df, v)
            elif k == "$bucket":
                df = self.bucket(df, v)
            elif k == "$setWindowFields":
                df = self.windows(df, v)
            elif k == "$unionWith":
                name, inner = (v, []) if isinstance(v, str) else (v.get("coll", ""), v.get("pipeline", []))
                held, self.order = self.order, None
                df = df.unionByName(self.pipeline(self.table(name), inner), allowMissingColumns=True)
                self.order = held
            elif k == "$sort":
                df = self.sort(df, v)
            elif k == "$skip":
                df = df.offset(_count(v, "$skip", 0))
            elif k == "$limit":
                df = df.limit(_count(v, "$limit", 1))
            elif k == "$unwind":
                df = self.unwind(df, v)
            elif k == "$lookup":
                df = self.lookup(df, v)
            elif k == "$count":
                df = df.agg(F.count(F.lit(1)).alias(v))
            elif k == "$sortByCount":
                df = self.sort(self.group(df, {"_id": v, "count": {"$sum": 1}}), {"count": -1, "_id": 1})
            elif k == "$sample":
                df = df.orderBy(F.rand(7)).limit(_count(v.get("size"), "size", 1))
            elif k == "$facet":
                after = stages[at + 1] if at + 1 < len(stages) and next(iter(stages[at + 1])) == "$project" else None
                df = self.facet(df, v, after)
            else:
                raise _refuse(f"{k} is not supported")
            # An order holds until rows are made anew, or its fields are gone.
            if k == "$sort":
                self.order = v
            elif k not in ("$match", "$limit", "$skip", "$addFields", "$set", "$project", "$unset", "$lookup") or (self.order and not {n.split(".")[0] for n in self.order} <= set(df.columns)):
                self.order = None
        return df


def lookup_relations(views: Mapping[str, list]) -> list[dict]:
    """The $lookup stages of stored view pipelines, at any depth, as relations."""
    out = []

    def walk(view: str, v) -> None:
        if isinstance(v, Mapping):
            for k, x in v.items():
                if k == "$lookup" and {"from", "localField", "foreignField", "as"} <= set(x):
                    out.append({"childTable": view, "childColumn": x["localField"], "constraintName": f"lookup:{view}:{x['as']}", "parentTable": x["from"], "parentColumn": x["foreignField"]})
                walk(view, x)
        elif isinstance(v, (list, tuple)):
            for x in v:
                walk(view, x)

    for name, pipeline in views.items():
        walk(name, pipeline)
    return sorted(out, key=lambda r: r["constraintName"])
