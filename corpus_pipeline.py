"""The corpus pipeline: quality rules, exact copies, near copies, mix, tokens. Each stage works on all that its predecessor kept."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import Scratch, quoted, table
from lakewarden.llm.exact_dedup import drop_copies
from lakewarden.llm.mixing import take_mix
from lakewarden.llm.ngram_jaccard import drop_near_copies
from lakewarden.llm.quality_rules import quality_rules
from lakewarden.llm.sentencepieces import encode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts go; null languages and sources are groups; repeated rows alike; long texts
    are counted whole; an empty table gives no rows; other columns come back as they were."""
    judged = quality_rules(docs)
    return judged.where(F.col(judged.columns[-1])["kept"]).select(*[F.col(quoted(c)) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each distinct text, that of the largest id. Null texts count as empty; ties and repeated rows as in drop_copies."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least id. Null and empty texts stay; see drop_near_copies."""
    return drop_near_copies(docs, 5, Fraction(4, 5))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them. Null texts have no words, null sources are one; see take_mix."""
    return take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_ids and piece_ids of each row. Null and empty texts have no ids; see encode."""
    coded = encode(docs)
    ids = coded.columns[-1]
    return coded.select("doc_id", "source", F.size(ids).cast("long").alias("n_ids"), F.col(ids).alias("piece_ids"))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_jaccard", near), ("mixing", mix), ("sentencepiece", tokens)]

#: The last stages have no SQL form; tests/llm/test_brute_force.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's rows are written to the shared folder and read again by the next, then deleted."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.drop(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
