"""Exact deduplication by skew-safe combining.

Copies are first combined inside each input partition (map-side aggregation), then in salted digest groups, so that a group
holding a third of all rows is spread over `salts` tasks, and the few salt winners are combined globally. Every stage groups
by the digest and the full text, so texts are compared in full, never by digest alone. Rows then find their group by digest;
that this is the same as by content is checked too: the winners, which were told apart by their texts, must all differ in digest.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SALTS, Scratch, quoted, small, table, unwrap, wrap


def _text(text_col: str, normalise=None) -> Column:
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    return normalise(text) if normalise else text


def winners(base: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, h, keep, group_size) of every distinct text t of base (id, tie, t): keep is the (id, tie) that stays, of the
    largest id and of equal ids the largest tie."""
    salted = (
        base.withColumn("digest", F.sha2("t", 256))
        .groupBy("digest", "t", F.pmod(F.xxhash64("id", "tie"), F.lit(salts)).alias("salt"))
        .agg(F.max(F.struct("id", "tie")).alias("keep"), F.count(F.lit(1)).alias("n"))
    )
    # Dealt by digest, so that the groups by text and those by digest need one exchange between them.
    texts = salted.repartition("digest").groupBy("digest", "t").agg(F.max("keep").alias("keep"), F.sum("n").alias("group_size"), F.xxhash64("t").alias("h"))
    one = texts.groupBy("digest").agg(F.max(F.struct("h", "keep", "group_size")).alias("g"), F.count(F.lit(1)).alias("texts"))
    same = F.when(F.col("texts") > 1, F.raise_error(F.lit("different texts have one SHA-256")).cast("long")).otherwise(F.col("g.h"))
    return one.select("digest", same.alias("h"), "g.keep", "g.group_size")


def _salted(groups: DataFrame, salts: int) -> DataFrame:
    """Groups with copies, once for each salt of their rows."""
    return groups.where("group_size > 1").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, salts: int = SALTS) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A null text counts as empty; a null id is smaller than any other (a
    group of nulls only keeps one of them, keep_id null). Rows that repeat id and text are equal texts too: one of them is
    kept, the others are not. Very long texts are compared whole. Other columns of docs are ignored, whatever their names. An
    empty table gives no rows. normalise maps the text column to the form that is compared and hashed.
    """
    base = docs.select(F.col(quoted(id_col)).alias("id"), F.lit(0).alias("tie"), _text(text_col, normalise).alias("t"))
    rows = base.groupBy("id", F.sha2("t", 256).alias("digest"), F.xxhash64("t").alias("h")).agg(F.count(F.lit(1)).alias("c"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    # Groups of one need no partner: the left join leaves them as they are.
    out = rows.join(_salted(winners(base, salts), salts), ["digest", "h", "salt"], "left")
    single = F.col("group_size").isNull()
    out = out.select("id", F.when(single, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "digest", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("i"))
    return out.select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs without copies, all columns as they came, whatever their names: of equal texts the row with the largest id stays.

    Nulls, long texts and empty tables as in exact_dedup. Of rows that repeat id and text too, the one whose other columns have
    the largest 64-bit hash stays; of rows that are equal in all columns, one.
    """
    scratch = Scratch(docs.sparkSession)
    plain = [F.col(quoted(f.name)).cast("string") if re.search("map<|variant", f.dataType.simpleString()) else F.col(quoted(f.name)) for f in docs.schema]
    own = {"id": F.col(quoted(id_col)), "tie": F.xxhash64(*plain)}
    base = docs.select(*[v.alias(k) for k, v in own.items()], _text(text_col).alias("t"))
    rows = base.groupBy("id", "tie", F.sha2("t", 256).alias("digest"), F.xxhash64("t").alias("h")).agg(F.count(F.lit(1)).alias("c"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "tie"), F.lit(salts)))
    # Only rows of groups with copies matter: those that go, and those that stay but are repeated.
    stays = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("tie") == F.col("keep.tie"))
    marked = rows.join(_salted(winners(base, salts), salts), ["digest", "h", "salt"]).select(F.col("id").alias("m_id"), F.col("tie").alias("m_tie"), F.col("h").alias("m_h"), (~stays).alias("gone"), "c").where("gone or c > 1")
    marked = scratch.table(marked, "copies")
    side = F.broadcast(marked) if small(marked, broadcast_rows) else marked
    d = wrap(docs, **own, h=F.xxhash64(_text(text_col)))
    d = d.join(side, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("tie") == F.col("m_tie")) & (F.col("h") == F.col("m_h")), "left")
    kept = unwrap(d.where("gone is null"))
    if marked.where("not gone").limit(1).count():  # rows that are equal in all columns
        kept = kept.union(unwrap(d.where("not gone").dropDuplicates(["id", "tie", "h"])))
    return kept


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: every row with the id of the copy that stays. Null texts count as empty; see exact_dedup."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM t d JOIN g ON d.t = g.t
"""
