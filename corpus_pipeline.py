"""A corpus pipeline of five operators: quality, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of docs. Rows are told apart by id and text, so null and repeated ids are documents like any others; rows with
both the same are one document to the near-duplicate stage. Columns besides doc_id and text are carried along whatever
their names and values are; an empty table gives no rows in any stage.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, packing, quality, similar, suffixes
from rasterloom.llm.common import remove, shared_dir, table

#: No SQL: four of the five stages can't be put into it. tests/llm/test_pipeline.py has them by brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labels of those of them that aren't held out.

    Whole texts are scored, a null one as an empty one, which is scored like any other. Equal texts get equal scores, so
    repeated rows stay or go together; a score right at the threshold stays. Without labels nothing is known and the
    model's constant decides.
    """
    sent = spark.sparkContext.broadcast(quality.train(docs, table(spark, sf_dir, "labels")))

    @F.pandas_udf("boolean")
    def accepted(text: pd.Series) -> pd.Series:
        import numpy as np

        x = np.array([quality.features(bytes(t) if t is not None else b"") for t in text], float).reshape(len(text), len(quality.FEATURES))
        return pd.Series(sent.value.score(x) >= quality.THRESHOLD)

    return docs.where(accepted(F.col("text").cast("binary")))


def _row() -> Column:
    """What tells a row from others, never null; in the order of ids, rows without one last."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(text).alias("h1"), F.crc32(text.cast("binary")).alias("h2"))


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of a stage's own that docs doesn't have in any case of letters."""
    taken, mark = {c.lower() for c in docs.columns}, "__"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id: texts whose five-word shingles have a
    Jaccard similarity of 0.8 or more. SimHash offers pairs, a prefix join those that it misses, and each is verified; see similar.py.

    Texts without words, null ones too, are alike and leave one document. Of rows with an equal id the text's hash
    decides; rows without an id stay only if no row of their group has one. Very long texts are compared whole.
    """
    row, hit = _free(docs, "row", "hit")
    keyed = docs.withColumn(row, _row())
    found = similar.near_duplicates(keyed.select(row, "text"), doc_id=row)
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias(hit)).distinct()
    return keyed.join(first, F.col(row) == F.col(hit), "left_semi").dropDuplicates([row]).drop(row)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 400 bytes, or of over 50 words, that stand elsewhere too; a document of which nothing but blanks is left goes.

    Documents without text but blanks stay, null and empty ones as they are. All copies of a passage go, also from rows that
    are repeated; very long texts are cleaned whole. n_chars, if docs has it, is that of the text left.
    """
    (had,) = _free(docs, "had")
    cleaned = suffixes.clean_texts(docs.withColumn(had, F.col("text").rlike(r"\S")), by_words=True)
    left = cleaned.where(~F.coalesce(F.col(had), F.lit(False)) | F.col("text").rlike(r"\S")).drop(had)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item.

    Null and empty texts share none and stay; items without words have none. Repeated rows stay or go together; very
    long texts are searched whole.
    """
    row, hit = _free(docs, "row", "hit")
    keyed = docs.withColumn(row, _row())
    found = decontaminate.contamination(keyed.select(row, "text"), table(spark, sf_dir, "benchmark"), doc_id=row)
    hits = found.where("contaminated").select(F.col("doc_id").alias(hit)).distinct()
    return keyed.join(hits, F.col(row) == F.col(hit), "left_anti").drop(row)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences that hold all documents, null and empty texts as one token each and repeated rows as
    often as they stand; see packing.pack_documents. The columns are those of the pieces."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup", simhash_stage),
    ("suffix-array dedup", suffix_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each keeps is written to the shared folder and read again, and deleted after the
    next, or if one fails. The last such table stays, as the result is read from it."""
    docs, at = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for i, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i + 1 < len(STAGES):
                docs.write.parquet(f"{at}/{i}")
                docs = spark.read.parquet(f"{at}/{i}")
                remove(spark, f"{at}/{i - 1}")
    except BaseException:
        remove(spark, at)
        raise
    return docs
