"""Past queries: a Parquet memory with upsert, and hybrid retrieval over it (BM25, hashed embeddings, reciprocal rank fusion)."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import re
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, question_id, token_sign, token_slot, tokens

K1, B, RRF_K, DIMS, LIMIT = 1.2, 0.75, 60, 128, 5


def term_frequencies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf)."""
    return docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _once(df: DataFrame) -> DataFrame:
    """df computed once for several uses: checkpointed where the cluster has a folder for that, else kept by Spark."""
    return df.checkpoint() if df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir") else df.persist()


def _same(word: str):
    return lambda x: x == F.lit(word)


def bm25(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, score) of the documents with a score above 0. Documents are tokenised once, into their length and their counts of the
    query's own terms; one row of sums over that comes to the driver, and the scores need no shuffle."""
    terms = sorted(set(re.findall(TOKEN, query.lower())))
    # Tokens are bound by a lambda, for an expression that is named often would be computed as often.
    counts = lambda t: F.struct(F.size(t).alias("len"), F.array(*[F.size(F.filter(t, _same(w))) for w in terms]).cast("array<int>").alias("tf"))
    d = docs.select(F.col(id_col).alias("id"), F.get(F.transform(F.array(tokens(F.col(text_col))), counts), F.lit(0)).alias("c"))
    d = _once(d.select("id", "c.len", "c.tf"))
    total = d.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("a"), *[F.sum((F.get("tf", F.lit(i)) > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]).first()
    n, score = total["n"], F.lit(0.0)
    for i in range(len(terms)):
        df, tf = total[f"df{i}"] or 0, F.get("tf", F.lit(i))
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(total["a"] or 1.0)))).otherwise(0.0)
    return d.select("id", score.alias("score")).where("score > 0")


def embed(docs: DataFrame, id_col: str, text_col: str, dims: int = DIMS) -> DataFrame:
    """(id, slot, value): the hashed vectors, without their zeros."""
    if dims < 8:
        raise ValueError("an embedding has 8 dimensions or more")
    t = docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term"))
    return t.groupBy("id", token_slot(F.col("term"), dims).alias("slot")).agg(F.sum(token_sign(F.col("term"))).alias("value")).where("value <> 0")


def hash_vector(text: str, dims: int = DIMS) -> list[float]:
    out = [0.0] * dims
    for t in re.findall(TOKEN, text.lower()):
        h = hashlib.sha256(t.encode()).digest()
        out[int.from_bytes(h[:4], "big") % dims] += 1.0 if h[4] % 2 == 0 else -1.0
    return out


def cosine(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text", dims: int = DIMS) -> DataFrame:
    """(id, score) of every document; 0 where either vector is 0. Each document's vector is summed inside its own row, over its
    tokens' slots in order, so nothing is shuffled."""
    q = hash_vector(query, dims)
    size = sum(x * x for x in q) ** 0.5
    weights = F.array(*[F.lit(x) for x in q])
    # slot * 2 + sign, sorted: a run of equal slots is one dimension.
    byte = lambda h, at, n: F.conv(F.substring(h, at, n), 16, 10).cast("long")
    codes = F.sort_array(F.transform(F.transform(tokens(F.col(text_col)), lambda t: F.sha2(t, 256)), lambda h: byte(h, 1, 8) % dims * 2 + byte(h, 9, 2) % 2))
    start = F.struct(F.lit(-1).cast("long").alias("slot"), F.lit(0.0).alias("run"), F.lit(0.0).alias("norm"), F.lit(0.0).alias("dot"))

    def step(a, x):
        slot = F.shiftright(x, 1)
        sign = F.when(x % 2 == 0, 1.0).otherwise(-1.0)
        same = a["slot"] == slot
        dot = a["dot"] + sign * F.get(weights, slot.cast("int"))
        return F.struct(slot.alias("slot"), F.when(same, a["run"] + sign).otherwise(sign).alias("run"), F.when(same, a["norm"]).otherwise(a["norm"] + a["run"] * a["run"]).alias("norm"), dot.alias("dot"))

    score = F.aggregate(codes, start, step, lambda a: F.struct(a["dot"].alias("dot"), F.sqrt(a["norm"] + a["run"] * a["run"]).alias("norm")))
    s = docs.select(F.col(id_col).alias("id"), score.alias("s"))
    return s.select("id", F.when((F.col("s.norm") > 0) & F.lit(size > 0), F.col("s.dot") / (F.col("s.norm") * F.lit(size or 1.0))).otherwise(0.0).alias("score"))


def top(scores: DataFrame, limit: int) -> DataFrame:
    """The rows of the greatest scores, ties by id: each task keeps so many at most."""
    return scores.orderBy(F.desc("score"), "id").limit(limit)


def fuse(lexical: DataFrame, vector: DataFrame, limit: int = LIMIT, k: int = RRF_K) -> DataFrame:
    """(id, score, bm25, cosine): reciprocal rank fusion; documents with neither score above 0 are out.

    What is in the first `limit` of one list scores 1 / (k + limit) at least, and what is beyond rank m in both 2 / (k + m + 1) at
    most: with m = k + 2 * limit nothing outside both lists' first m can win. So only those rows come to the driver, and their ranks
    in the other list are counted by one pass over it; no list is sorted as a whole."""
    spark, most = lexical.sparkSession, k + 2 * limit
    lists = {"bm25": _once(lexical.select("id", "score")), "cosine": _once(vector.select("id", "score"))}
    found = {n: {r["id"]: r["score"] for r in top(d, most).collect()} for n, d in lists.items()}
    ids = spark.createDataFrame([(i,) for i in {*found["bm25"], *found["cosine"]}], lexical.select("id").schema)
    ranks: dict[str, dict] = {}
    for n, d in lists.items():
        found[n] = {r["id"]: r["score"] for r in d.join(F.broadcast(ids), "id").collect()}
        order = sorted(found[n], key=lambda i, n=n: (-found[n][i], i))
        if not order:
            ranks[n] = {}
            continue
        marks = F.array(*[F.struct(F.lit(-float(found[n][i])).alias("s"), F.lit(i).alias("i")) for i in order])
        # How many of the candidates come before a row: it raises the rank of those after.
        before = F.size(F.filter(marks, lambda x: x < F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"))))
        counts = {r["b"]: r["n"] for r in d.groupBy(before.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        ranks[n], above = {}, 0
        for place, i in enumerate(order):
            above += counts.get(place, 0)  # rows up to and with candidate i
            ranks[n][i] = above
    out = []
    for i in {*found["bm25"], *found["cosine"]}:
        scores = [float(found[n].get(i, 0.0)) for n in ("bm25", "cosine")]
        if max(scores) > 0:
            out.append((i, sum(1.0 / (k + ranks[n][i]) for n in ("bm25", "cosine") if i in ranks[n]), *scores))
    out = sorted(out, key=lambda r: (-r[1], r[0]))[:limit]
    kind = lexical.schema["id"].dataType.simpleString()
    return spark.createDataFrame(out, f"id {kind}, score double, bm25 double, cosine double").orderBy(F.desc("score"), "id")


SCHEMA = "id string, question string, sql string, result_shape string, duration_ms double, recorded_at string, unverified_models array<string>"


class Memory:
    """Successful executions in a Parquet folder: appended as they come, the last one of each question counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, question: str, sql: str, shape: dict, duration_ms: float, unverified: list[str]) -> None:
        row = [("", question, sql, json.dumps(shape, sort_keys=True), float(duration_ms), dt.datetime.now(dt.UTC).isoformat(), sorted(unverified))]
        d = self.spark.createDataFrame(row, SCHEMA).withColumn("id", question_id(F.col("question")))
        d.coalesce(1).write.mode("append").parquet(self.path)

    def records(self) -> DataFrame:
        if not Path(self.path).exists():
            return self.spark.createDataFrame([], SCHEMA)
        d = self.spark.read.schema(SCHEMA).parquet(self.path)
        return d.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("recorded_at")))).where("n = 1").drop("n")

    def compact(self) -> None:
        """Rewrite the folder with one row a question. Between the two renames the folder is absent; do this while nobody reads."""
        tmp = f"{self.path}-{uuid.uuid4().hex}"
        self.records().coalesce(1).write.parquet(tmp)
        old = f"{tmp}-old"
        Path(self.path).rename(old)
        Path(tmp).rename(self.path)
        shutil.rmtree(old)

    def search(self, question: str, limit: int = LIMIT) -> list[dict]:
        if not 1 <= limit <= 20:
            raise ValueError("the limit is 1 to 20")
        docs = self.records().withColumn("text", F.concat_ws("\n", "question", "sql")).cache()
        try:
            found = fuse(bm25(docs, question), cosine(docs, question), limit)
            rows = found.join(F.broadcast(docs.drop("text")), "id").orderBy(F.desc("score"), "id").collect()
            return [r.asDict() for r in rows]
        finally:
            docs.unpersist()


def result_shape(schema) -> dict[str, str]:
    """Column types from the declared schema, by name; no scan."""
    kinds = {"string": "string", "boolean": "boolean", "date": "date", "timestamp": "date", "timestamp_ntz": "date", "binary": "binary", "bigint": "bigint"}
    of = lambda t: "array" if t.startswith("array") else "object" if t.startswith(("struct", "map")) else kinds.get(t, "number")
    return {f.name: of(f.dataType.simpleString()) for f in sorted(schema, key=lambda f: f.name)}
