"""Raster views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import samples


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str, scale: float, most: int) -> DataFrame:
    """(vec_id, label, v array): one row of an image for each vector, quantised to 0..most."""
    q = F.transform("embedding", lambda e: F.least(F.lit(most), F.greatest(F.lit(0), F.floor((e.cast("double") + 1) * scale).cast("int"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", q.alias("v"))


def emb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb(spark, sf_dir, 127.5, 255)


def emb12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb(spark, sf_dir, 2047.5, 4095)


def samples8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, y, x, v): an image for each label, in rows of 64; y counts a label's vectors by vec_id."""
    rows = emb8(spark, sf_dir).select("label", F.col("vec_id").alias("y"), "v")
    return samples.explode_samples(rows, ["label", "y"], F.col("v"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, n, r, g, b) of lineitem; (k, n) is not a key."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").bitwiseAND(255).cast("int").alias("r"),
        F.col("l_suppkey").bitwiseAND(255).cast("int").alias("g"), F.col("l_quantity").cast("int").alias("b"),
    )


def strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, v)"""
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").cast("int").bitwiseAND(255).alias("v"))


def docbytes(spark: SparkSession, sf_dir: str, width: int = 64) -> DataFrame:
    """(doc_id, width, height, n, data): a text's bytes as rows of `width`, the last filled up with zeros; dealt out by id,
    as coding is heavy next to reading."""
    d = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", d.alias("d"), F.octet_length(d).alias("n"))
    height = F.greatest(F.lit(1), F.ceil(F.col("n") / width)).cast("int")
    parts = docs.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "doc_id")
    return parts.select("doc_id", F.lit(width).alias("width"), height.alias("height"), "n", F.concat("d", F.unhex(F.repeat(F.lit("00"), height * width - F.col("n").cast("int")))).alias("data"))


RGB_SQL = "SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_partkey & 255 AS INTEGER) AS r, CAST(l_suppkey & 255 AS INTEGER) AS g, CAST(l_quantity AS INTEGER) AS b FROM lineitem"
STRIP_SQL = "SELECT user_id, event_id, CAST(floor(value) AS INTEGER) & 255 AS v FROM events"


def emb_sql(scale: float, most: int) -> str:
    return f"SELECT vec_id, label, list_transform(embedding, lambda e: least({most}, greatest(0, CAST(floor((CAST(e AS DOUBLE) + 1) * {scale}) AS INTEGER)))) AS v FROM embeddings"


SAMPLES8_SQL = f"SELECT label, vec_id AS y, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS x, unnest(v) AS v FROM ({emb_sql(127.5, 255)})"
