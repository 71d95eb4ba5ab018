"""Sources: folders of Parquet or JSON and JDBC databases, described in one shape."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEYS = {
    "parquet": {"name", "type", "description", "path", "tables", "keys", "relations", "comments"}, "json": {"name", "type", "description", "path", "tables", "keys", "relations", "comments"},
    "jdbc": {"name", "type", "description", "url", "user", "password", "tables", "keys", "relations", "comments"},
}


@dataclass(frozen=True)
class Config:
    """keys: {table: {"primary": [...], "unique": [...]}}; relations: foreign keys as dicts; comments: {table or table.column: text}.
    Parquet has no catalogue of these, so the configuration carries them."""

    name: str
    type: str
    tables: tuple[str, ...]
    description: str = ""
    path: str = ""
    url: str = ""
    user: str = ""
    password: str = field(default="", repr=False)
    keys: Mapping = field(default_factory=dict)
    relations: tuple = ()
    comments: Mapping = field(default_factory=dict)


def load_config(text: str, env: Mapping[str, str] | None = None) -> list[Config]:
    """Strict JSON {"sources": [...]}; ${NAME} is taken from env, and a name that is not there is an error."""
    env = os.environ if env is None else env

    def fill(v):
        if isinstance(v, str):
            def one(m):
                if m[1] not in env:
                    raise ValueError(f"configuration: {m[1]} is not set")
                return env[m[1]]

            return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", one, v)
        if isinstance(v, dict):
            return {k: fill(x) for k, x in v.items()}
        return [fill(x) for x in v] if isinstance(v, list) else v

    raw = fill(json.loads(text))
    if set(raw) != {"sources"} or not raw["sources"]:
        raise ValueError("configuration: one list of sources is needed")
    out = []
    for s in raw["sources"]:
        if s.get("type") not in _KEYS or (extra := set(s) - _KEYS[s["type"]]):
            raise ValueError(f"configuration: source {s.get('name')}: {'unknown type' if s.get('type') not in _KEYS else 'unknown key ' + min(extra)}")
        out.append(Config(**s | {"tables": tuple(s["tables"]), "relations": tuple(s.get("relations", ()))}))
    return out


class Source:
    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.tables: dict[str, DataFrame] = {t: self._read(t) for t in sorted(config.tables)}

    def _read(self, t: str) -> DataFrame:
        c = self.config
        if c.type == "jdbc":
            return self.spark.read.jdbc(c.url, t, properties={"user": c.user, "password": c.password})
        return getattr(self.spark.read, c.type)(f"{c.path}/{t}.{c.type}")

    def list_tables(self) -> list[dict]:
        """name, kind, and where known comment and estimatedRowCount (from Parquet's statistics, without a scan)."""
        out = []
        for t, df in self.tables.items():
            rows = df._jdf.queryExecution().optimizedPlan().stats().rowCount()
            row = {"name": t, "kind": "table", "comment": self.config.comments.get(t), "estimatedRowCount": int(str(rows.get())) if rows.isDefined() else None}
            out.append({k: v for k, v in row.items() if v is not None})
        return out

    def get_schema(self, table: str | None = None) -> list[dict]:
        """Columns ordered by table and position (from 1); an unknown table has none."""
        out = []
        for t, df in self.tables.items():
            if table not in (None, t):
                continue
            keys = self.config.keys.get(t, {})
            primary = keys.get("primary", [])
            for i, f in enumerate(df.schema, 1):
                row = {
                    "table": t, "name": f.name, "dataType": f.dataType.simpleString(), "nullable": f.nullable and f.name not in primary, "isPrimaryKey": f.name in primary,
                    "isUnique": primary == [f.name] or f.name in keys.get("unique", []), "comment": self.config.comments.get(f"{t}.{f.name}"), "position": i,
                }
                out.append({k: v for k, v in row.items() if v is not None})
        return out

    def get_relations(self) -> list[dict]:
        """Declared foreign keys, one row for each key column."""
        return sorted((dict(r) for r in self.config.relations), key=lambda r: (r["childTable"], r["constraintName"], r["childColumn"]))

    def inspect(self) -> dict:
        return {"tables": [{**t, "columns": self.get_schema(t["name"])} for t in self.list_tables()], "relations": self.get_relations()}


class Sources:
    """All configured sources, read up front."""

    def __init__(self, spark: SparkSession, configs: list[Config]):
        self.by_name: dict[str, Source] = {}
        for c in configs:
            if c.name in self.by_name:
                raise ValueError(f"two sources are named {c.name}")
            self.by_name[c.name] = Source(spark, c)

    def list_sources(self) -> list[dict]:
        """Only these three fields, so that no credential can come along."""
        return [{"name": s.config.name, "type": s.config.type, "description": s.config.description} for _, s in sorted(self.by_name.items())]


def infer_documents(docs: DataFrame, json_col: str, sample: int | None = None) -> DataFrame:
    """(path, types, nullable, isPrimaryKey) of JSON documents in a text column: dotted paths, array<t> for repeated fields, types
    that differ as a sorted union, nullable where a document lacks the path or has null there. All documents, unless a sample
    is asked for. Types come from the JSON text itself, so every step is a built-in."""
    d = (docs.limit(sample) if sample else docs).select(F.col(json_col).alias("j")).where("j is not null")
    v = d.select(F.parse_json("j").alias("v"))
    total = v.agg(F.count(F.lit(1)).alias("total"))
    kinds = v.select(F.expr("schema_of_variant(v)").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    # Few distinct shapes: their paths are unfolded in the driver's language, one row a shape.
    rows = []
    for r in kinds.toLocalIterator():
        for path, kind in shape_paths(r["s"]):
            rows.append((path, kind, r["n"]))
    spark = docs.sparkSession
    paths = spark.createDataFrame(rows, "path string, kind string, n long")
    g = paths.groupBy("path").agg(F.sort_array(F.collect_set(F.when(F.col("kind") != "null", F.col("kind")))).alias("k"), F.sum(F.when(F.col("kind") != "null", F.col("n")).otherwise(0)).alias("there"))
    return g.crossJoin(F.broadcast(total)).select("path", F.when(F.size("k") == 0, "null").otherwise(F.array_join("k", " | ")).alias("types"), (F.col("there") < F.col("total")).alias("nullable"), (F.col("path") == "_id").alias("isPrimaryKey"))


_JSON_TYPES = {"BIGINT": "number", "DOUBLE": "number", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "DATE": "date", "TIMESTAMP": "date"}


def shape_paths(shape: str, prefix: str = "") -> list[tuple[str, str]]:
    """(path, type) of a variant's shape, such as OBJECT<a: BIGINT, b: ARRAY<OBJECT<c: STRING>>>."""
    kind = _json_type(shape)
    out = [(prefix, kind)] if prefix else []
    inner = shape
    repeated = inner.startswith("ARRAY<")
    while inner.startswith("ARRAY<"):
        inner = inner[6:-1]
    if repeated and prefix and not inner.startswith("OBJECT<"):
        return [(prefix, f"array<{_json_type(inner)}>")]
    if inner.startswith("OBJECT<"):
        for part in _parts(inner[7:-1]):
            name, _, t = part.partition(": ")
            for p, k in shape_paths(t, f"{prefix}.{name.strip('`')}" if prefix else name.strip("`")):
                out.append((p, f"array<{k}>" if repeated and prefix else k))
    return out


def _json_type(shape: str) -> str:
    if shape.startswith("ARRAY<"):
        return "array"
    if shape.startswith("OBJECT<"):
        return "object"
    return "number" if shape.startswith("DECIMAL") else _JSON_TYPES.get(shape, shape.lower())


def _parts(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()] if text[at:].strip() else out
