"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Largest side, in rows and in bytes, that is ever broadcast; larger sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 128_000_000
#: In a shuffled join, a key of so many rows is hot and dealt to SALTS tasks.
HOT_ROWS, SALTS = 100_000, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local run (tests) has a folder of
    its own, and a cluster is refused."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = getattr(shared_dir, "own", None)
        if conf is None:
            conf = shared_dir.own = tempfile.mkdtemp(prefix="lakewarden-")
            atexit.register(shutil.rmtree, conf, True)
    return conf.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme that Spark resolves it to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration() if spark.sparkContext._jsc is None else spark._jsc.hadoopConfiguration()).delete(p, True)


_LEFT: dict[str, SparkSession] = {}


@atexit.register
def _sweep() -> None:
    """Folders that results may read until the program ends."""
    for path, spark in _LEFT.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, S112 - the JVM may be gone; nothing is left to do then
            continue


class Scratch:
    """An operator's intermediate tables, in the shared folder: each cuts the lineage and survives lost executors. drop() deletes
    those that nothing reads any more; what a result still reads goes when the program ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def folder(self, tag: str) -> str:
        path = f"{shared_dir(self.spark)}/lakewarden/{tag}-{uuid.uuid4().hex}"
        _LEFT[path] = self.spark
        return path

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.folder(tag)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *keep: DataFrame) -> None:
        """Delete all tables but keep."""
        for path in [p for p, df in self.paths.items() if not any(df is k for k in keep)]:
            _delete(self.spark, path)
            _LEFT.pop(path, None)
            del self.paths[path]


def wrap(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs as one struct column `row`, beside columns of the operator's own: no name can clash. unwrap() undoes it."""
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns]) if docs.columns else F.struct()
    return docs.select(row.alias("row"), *[c.alias(k) for k, c in columns.items()])


def unwrap(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select("row.*", *columns)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however the optimiser merges projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows and BROADCAST_BYTES, both counted; reads no more rows than that."""
    width = F.lit(32 + 8 * len(df.columns))
    for f in df.schema:
        if f.dataType.typeName() in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(quoted(f.name)), F.lit(0))
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return n <= rows and size <= BROADCAST_BYTES


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str, key: Column, salts: int = SALTS, rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """left join right (inner or left) on null-safe keys, in which right does not repeat. right is broadcast if it is small by
    count. Otherwise both are shuffled: right's hot keys are copied once for each salt, and left's rows of a hot key are spread
    over the salts by `key`; all other keys are dealt once."""
    names = {c: n for c, n in zip([*on, "salt", "hot"], fresh(left.select(*left.columns, *[F.lit(None).alias(c) for c in right.columns if c not in left.columns]), *[f"r_{c}" for c in on], "r_salt", "r_hot"), strict=True)}
    cols = [F.col(c) for c in right.columns if c not in on]

    def same(a: list[str], b: list[str]) -> Column:
        cond = F.lit(True)
        for x, y in zip(a, b, strict=True):
            cond = cond & F.col(x).eqNullSafe(F.col(y))
        return cond

    r_on = [names[c] for c in on]
    r = right.select(*[F.col(c).alias(names[c]) for c in on], *cols)
    if small(right, rows):
        return left.join(F.broadcast(r), same(on, r_on), how).drop(*r_on)
    hot = left.groupBy(*on).agg(F.count(F.lit(1)).alias(names["hot"])).where(F.col(names["hot"]) >= hot_rows)
    hot = hot.select(*[F.col(c).alias(f"{names[c]}_h") for c in on], names["hot"])
    h_on = [f"{names[c]}_h" for c in on]
    mark = F.broadcast(hot) if small(hot, rows) else hot
    salt, is_hot = names["salt"], F.col(names["hot"]).isNotNull()
    le = left.join(mark, same(on, h_on), "left").drop(*h_on).withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(key), F.lit(salts))).otherwise(0).cast("int")).drop(names["hot"])
    r = r.join(mark, same(r_on, h_on), "left").drop(*h_on)
    r = r.withColumn(f"{salt}_r", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop(names["hot"])
    return le.join(r, same([*on, salt], [*r_on, f"{salt}_r"]), how).drop(salt, f"{salt}_r", *r_on)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores in front until it clashes with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session, for it may not be installed there."""
    sc = spark.sparkContext
    if getattr(ship, "sent", None) == sc.applicationId:
        return
    top = Path(__file__).resolve().parents[1]
    fd, path = tempfile.mkstemp(suffix=".zip", prefix=f"{top.name}-")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(path)
    atexit.register(os.unlink, path)
    ship.sent = sc.applicationId


#: Rows in an Arrow batch where the session has no value of its own: texts are long, and a batch exists in the JVM and in Python.
ARROW_ROWS = 500


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    # Columns go in by position: a name may hold dots, or be there twice.
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)
