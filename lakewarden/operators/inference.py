"""Relationships that are not declared, from names, keys, types and a look at the values."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.registry import Source

SAMPLE, LEAST_RATIO = 1000, 0.5
# Types of one family join.
FAMILIES = {
    "integer": ("tinyint", "smallint", "int", "integer", "bigint"),
    "numeric": ("decimal", "float", "double"),
    "text": ("string", "varchar", "char"),
}


def family(data_type: str) -> str:
    base = re.sub(r"\(.*\)$", "", data_type.lower()).strip()
    return next((k for k, v in FAMILIES.items() if base in v), base)


def singular(name: str) -> str:
    if name.endswith("ies"):
        return name[:-3] + "y"
    return name[:-1] if name.endswith("s") and not name.endswith("ss") else name


@dataclass(frozen=True)
class Candidate:
    name: str
    child: str
    column: str
    parent: str
    ratio: float
    confidence: float


def overlap(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, sample: int = SAMPLE) -> DataFrame:
    """(sampled, matched): of the first `sample` distinct child values, in their order, how many the parent has."""
    c = child.select(F.col(child_col).alias("v")).where("v is not null").distinct().orderBy("v").limit(sample)
    p = parent.select(F.col(parent_col).alias("w")).where("w is not null").distinct()
    # The sample is bounded, so it is the side that is broadcast: the parent is only scanned.
    hit = p.join(F.broadcast(c), F.col("w") == F.col("v")).agg(F.count(F.lit(1)).alias("matched"))
    return c.agg(F.count(F.lit(1)).alias("sampled")).crossJoin(hit)


def confidence(ratio: float) -> float:
    return int((0.6 + 0.35 * ratio) * 10_000 + 0.5) / 10_000


def infer_relationships(source: Source, sample: int = SAMPLE, least: float = LEAST_RATIO) -> list[Candidate]:
    """A column named like the parent's key, <singular parent>_id, of the same type family, not declared already, whose values
    the parent mostly has."""
    if not 1 <= sample <= 10_000 or not 0 < least <= 1:
        raise ValueError("the sample is 1 to 10000, the ratio over 0 and up to 1")
    if source.config.type == "json":
        return []
    schema = source.get_schema()
    declared = {(r["childTable"], r["childColumn"], r["parentTable"], r["parentColumn"]) for r in source.get_relations()}
    out = []
    for p in schema:
        if p["name"] != f"{singular(p['table'])}_id" or not (p["isPrimaryKey"] or p["isUnique"]):
            continue
        for c in schema:
            if c["table"] == p["table"] or c["name"] != p["name"] or family(c["dataType"]) != family(p["dataType"]):
                continue
            if (c["table"], c["name"], p["table"], p["name"]) in declared:
                continue
            r = overlap(source.tables[c["table"]], c["name"], source.tables[p["table"]], p["name"], sample).first()
            ratio = r["matched"] / r["sampled"] if r["sampled"] else 0.0
            if ratio >= least:
                out.append(Candidate(f"{c['table']}_{c['name']}_{p['table']}", c["table"], c["name"], p["table"], ratio, confidence(ratio)))
    return sorted(out, key=lambda x: (-x.confidence, x.name))
