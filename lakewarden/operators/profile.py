"""Column profiles: one aggregate scan, and one more pass for the most frequent values of low-cardinality columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUTOFF, TOP = 50, 20
ORDERED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def profile(df: DataFrame, columns: Sequence[str] | None = None, cutoff: int = CUTOFF, top: int = TOP) -> DataFrame:
    """(column, total, distinctCount, nullRate, min, max, topValues) a column; unknown names are left out. Counts are exact.

    Values become text in a long frame (column, value) that is grouped once for all columns: distinct counts, null counts and top
    values come from the same grouped rows, so a wide table needs no expansion for each distinct count.
    """
    wanted = [f for f in df.schema if columns is None or f.name in columns]
    schema = "column string, total long, distinctCount long, nullRate double, min string, max string, topValues array<struct<value:string,count:bigint>>"
    if not wanted:
        return df.sparkSession.createDataFrame([], schema)
    text = lambda f: (F.to_json(F.struct(F.col(f"`{f.name}`"))) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`").cast("string"))
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), F.when(F.col(f"`{f.name}`").isNotNull(), text(f)).alias("value")) for f in wanted])
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
    stats = counts.groupBy("column").agg(F.sum("n").alias("total"), F.count("value").alias("distinctCount"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"))
    low = stats.where((F.col("distinctCount") > 0) & (F.col("distinctCount") <= cutoff)).select("column")
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    # At most `cutoff` rows a column reach the window.
    tops = counts.where("value is not null").join(F.broadcast(low), "column", "left_semi").withColumn("r", rank).where(F.col("r") <= top)
    tops = tops.groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count"))).alias("topValues"))
    ranged = [f for f in wanted if isinstance(f.dataType, ORDERED)]
    ends = df.agg(*[F.struct(F.min(f"`{f.name}`").cast("string").alias("min"), F.max(f"`{f.name}`").cast("string").alias("max")).alias(f"c{i}") for i, f in enumerate(ranged)], F.count(F.lit(1)).alias("rows"))
    ends = ends.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"c{i}.min").alias("min"), F.col(f"c{i}.max").alias("max")) for i, f in enumerate(ranged)])).alias("e")).select("e.*") if ranged else None
    # Columns of an empty table have no rows to group: the names lead.
    names = df.sparkSession.createDataFrame([(f.name,) for f in wanted], "column string")
    out = names.join(stats, "column", "left").join(tops, "column", "left")
    out = out.join(ends, "column", "left") if ends is not None else out.withColumns({"min": F.lit(None).cast("string"), "max": F.lit(None).cast("string")})
    rate = F.when(F.col("total") > 0, F.col("nulls") / F.col("total")).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("column", zero("total"), zero("distinctCount"), F.coalesce(rate, F.lit(0.0)).alias("nullRate"), "min", "max", "topValues")


def top_values(df: DataFrame, column: str, top: int = TOP) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(top)
