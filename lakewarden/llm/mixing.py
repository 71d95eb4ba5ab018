"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 48-bit hash. Tokens are summed by source and leading hash bucket; a cumulative sum over the buckets (a
few thousand rows a source) finds the bucket where the source's budget runs out, only that boundary bucket is split by the
next bits, and so on. What is left is one threshold a source, and a plain filter: no document is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, join_small, n_words_of, quoted, table, unwrap, wrap

#: Hex digits of the hash that each level refines; 12 digits are 48 bits.
LEVELS = (3, 3, 3, 3)


def doc_hash(id_col: str, text_col: str) -> Column:
    """48 bits of the md5 of id and text: the same at every run and in every engine."""
    text = F.concat(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, sum(LEVELS)), 16, 10).cast("long")


def ranked(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """sizes with k, each source's place in code point order, nulls last. Sources are dealt by range and counted within their
    range, so no task sees more than its share of them."""
    dealt = scratch.table(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix")
    before = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a range
    before = before.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("place", place).join(F.broadcast(before), F.col("part") == F.col("p")).select("source", "source_size", (F.col("before") + F.col("place")).cast("long").alias("k"))


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeats: int, scratch: Scratch) -> DataFrame:
    """sizes (source, source_size) with each source's target: sources in code point order, nulls last, take the weights in turn
    and share the total; no target exceeds max_repeats times its size, and what it leaves goes to the others by weight, until
    none is above. Each round is one sum over the sources; a source that is full stays full, so rounds end."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    s = scratch.table(ranked(sizes, scratch).withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeats), "mix")
    level, full = None, -1
    while True:
        above = F.lit(False) if level is None else F.lit(level) * F.col("w") > F.col("cap")
        r = s.agg(F.sum("source_size").alias("total"), F.sum(F.when(above, F.col("cap")).otherwise(0)).alias("capped"), F.sum(F.when(above, 0.0).otherwise(F.col("w"))).alias("w"), F.sum(above.cast("long")).alias("full")).first()
        if r["full"] == full or not r["w"]:
            break
        full = r["full"]
        level = float((r["total"] or 0) - (r["capped"] or 0)) / r["w"]
    hold = F.lit(level if r["w"] else None).cast("double")
    over = hold.isNull() | (hold * F.col("w") > F.col("cap"))
    return s.select("source", "source_size", F.when(over, F.col("cap").cast("double")).otherwise(hold * F.col("w")).alias("target"))


def thresholds(base: DataFrame, weights: Sequence[float], max_repeats: int, scratch: Scratch) -> DataFrame:
    """(source, source_size, target, whole, theta): each document is taken whole times, and once more if its hash is below theta."""
    bits = [4 * d for d in LEVELS]
    shift = sum(bits) - bits[0]
    hist = scratch.table(base.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n")), "mix")
    t = source_targets(hist.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_repeats, scratch)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = t.withColumn("whole", F.least(whole, F.lit(max_repeats).cast("long")))
    t = t.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("lo", F.lit(0).cast("long"))
    t = scratch.table(t, "mix")
    for level in range(len(bits)):
        # hist: tokens of the buckets inside the boundary bucket of the level before, at most 4096 a source.
        run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = join_small(hist.withColumn("upto", F.sum("n").over(run)), t, ["source"], "inner", F.col("b"))
        fits = F.col("upto") <= F.col("budget")
        step = cum.groupBy("source").agg(F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("used"), F.min(F.when(~fits, F.col("b"))).alias("edge"), F.min(F.when(~fits, F.col("upto"))).alias("over"))
        s = t.withColumnRenamed("source", "s").join(step, F.col("s").eqNullSafe(F.col("source")), "left").drop("source").withColumnRenamed("s", "source")
        if level == len(bits) - 1:
            # The last bucket holds documents of one hash: take it if that comes nearer.
            edge = F.when(F.col("over") - F.col("budget") < F.col("budget") - F.col("used"), F.col("edge") + 1).otherwise(F.col("edge"))
        else:
            edge = F.shiftleft("edge", shift)
        end = F.lit(1 << sum(bits)).cast("long")
        done = F.col("edge").isNull()
        cols = ["source", "source_size", "target", "whole"]
        t = scratch.table(s.select(*cols, (F.col("budget") - F.coalesce("used", F.lit(0))).alias("budget"), F.when(done, F.greatest("lo", end)).otherwise(edge).alias("lo")), "mix")
        if level < len(bits) - 1:
            size, shift = shift, shift - bits[level + 1]
            inside = join_small(base, t.select("source", "lo"), ["source"], "inner", F.col("h")).where((F.col("h") >= F.col("lo")) & (F.col("h") < F.col("lo") + F.lit(1 << size)))
            hist = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"))
    return t.select("source", "source_size", "target", "whole", F.col("lo").alias("theta"))


def mix_base(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(quoted(text_col)).cast("string")
    return docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).cast("string").alias("source"), n_words_of(text).alias("size"), doc_hash(id_col, text_col).alias("h"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: id_col, size, source_size, target, taken.

    size counts words (null text: none; whole texts, however long). Sources in code point order (null last, a source of its
    own) take the weights in turn. taken is a whole multiple of size, at most max_repeats times; each source's sum comes within
    one document of its target, but for rows that repeat id and text, which share a hash and are taken together. A null id is
    hashed as none. Sources without words have target 0. The hash makes reruns agree. An empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    base = scratch.table(mix_base(docs, id_col, text_col, source_col), "mix")
    t = scratch.table(thresholds(base, weights, max_repeats, scratch), "mix")
    scratch.drop(base, t)
    out = join_small(base, t, ["source"], "inner", F.col("h"))
    copies = F.col("whole") + (F.col("h") < F.col("theta")).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.least(copies, F.lit(max_repeats).cast("long"))).alias("taken"))


def take_mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: docs' rows, all columns as they came, whatever their names, each as often as the mix takes it, as in
    mix_sources. Documents without words (null, empty) count nothing and are taken as their hash says; rows that repeat id and
    text are taken together; an empty table gives no rows."""
    scratch = Scratch(docs.sparkSession)
    base = scratch.table(mix_base(docs, id_col, text_col, source_col), "mix")
    t = scratch.table(thresholds(base, weights, max_repeats, scratch).select("source", "whole", "theta"), "mix")
    scratch.drop(t)
    d = wrap(docs, source=F.col(quoted(source_col)).cast("string"), h=doc_hash(id_col, text_col))
    d = join_small(d, t, ["source"], "inner", F.col("h"))
    copies = F.least(F.col("whole") + (F.col("h") < F.col("theta")).cast("long"), F.lit(max_repeats).cast("long"))
    d = d.withColumn("n", copies).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return unwrap(d)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents mixed at weights 1, 2, 3; nulls, ties and empty texts as in mix_sources."""
    return mix_sources(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 12))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM base GROUP BY source),
w AS (SELECT *, CAST(k % 3 + 1 AS DOUBLE) AS w, source_size * 3 AS cap FROM s),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
hold AS (SELECT arg_min(level, cap / w) AS hold FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, CASE WHEN hold IS NULL OR hold * w > cap THEN CAST(cap AS DOUBLE) ELSE hold * w END AS target FROM l, hold),
b AS (SELECT base.doc_id, base.size, base.h, t.source, t.source_size, t.target, least(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END, 3)::BIGINT AS whole
  FROM base JOIN t ON base.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, target - whole * source_size AS budget, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY source, h) AS same FROM b),
e AS (SELECT *, upto <= budget OR (upto - same <= budget AND upto - budget < budget - (upto - same)) AS more FROM c)
SELECT doc_id, size, source_size, target, (size * least(whole + more::INT, 3))::BIGINT AS taken FROM e
"""
