"""Tokens, hashed embeddings and question ids as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a token.
TOKEN = "[a-z_][a-z0-9_]*|[0-9]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def question_id(question: Column) -> Column:
    """SHA-256 of the question in lower case with single spaces."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(question), r"\s+", " ")), 256)


def token_slot(token: Column, dims: int) -> Column:
    """The dimension that a token adds to: the first four bytes of its SHA-256, modulo dims."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dims).cast("int")


def token_sign(token: Column) -> Column:
    """+1 if the fifth byte of the SHA-256 is even, else -1."""
    return F.when(F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
