"""Bounded samples of labelled documents for the classifiers; what is held out is never in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id's text has this rest; a null id is held out, so nothing is learned from it."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, rows: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label, half) of at most `rows` labelled documents that aren't held out, in the order of a hash of their ids.

    The chosen ids are at most `rows`, so they may be broadcast. half is a second hash's parity.
    """
    key = F.col(f"`{doc_id}`")
    chosen = labels.where(key.isNotNull() & F.col(f"`{label}`").isNotNull() & ~held_out(doc_id, modulus, rest)).select(key.alias("__key"), F.col(f"`{label}`").cast("int").alias("label"))
    chosen = chosen.groupBy("__key").agg(F.max("label").alias("label")).orderBy(F.xxhash64("__key"), "__key").limit(rows)
    texts = docs.select(key.alias("__doc"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__key")).select("text", "label", F.pmod(F.xxhash64(F.lit("half"), "__key"), F.lit(2)).cast("int").alias("half"))
