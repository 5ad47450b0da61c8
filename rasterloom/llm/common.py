"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only in local mode, where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, once nothing is read from it any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def complete(spark: SparkSession, path: str) -> list[int]:
    """Numbers that name the tables in a folder of the shared store whose writing was finished."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return [int(n) for n in found if n.isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver collects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@functools.cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return lambda _: 0


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow; at a task's end its worker, which Spark keeps, gives freed memory back to the machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return df.mapInArrow(run, schema)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: the rows go to the shared checkpoint folder and survive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Bits for each key, and the most bits, of a filter; an exact join follows each use of one.
FILTER_BITS, MOST_FILTER_BITS = 12, 1 << 28
_SHIFTS = (0, 18, 36)


def bloom(keys: DataFrame, n: int, most: int = MOST_FILTER_BITS) -> np.ndarray:
    """Bloom filter of the n longs in column h as 64-bit words; no more than `most` bits however many keys there are."""
    bits = 1 << 10
    while bits < min(n * FILTER_BITS, most):
        bits *= 2
    one, h = F.lit(1).cast("bigint"), F.col("h")
    spots = F.array(*(F.pmod(F.shiftrightunsigned(h, s), F.lit(bits)) for s in _SHIFTS))
    words = keys.select(F.explode(spots).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", one, F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    if got.num_rows:
        out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def passes(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the unsigned h may be in the filter."""
    out = np.ones(len(h), bool)
    for s in _SHIFTS:
        at = (h >> np.uint64(s)) & np.uint64(len(words) * 64 - 1)
        out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def slices(b: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """[first, end) of consecutive rows whose binary column holds about so many bytes together, one row at least."""
    sizes = np.fromiter((x.as_buffer().size if x.is_valid else 0 for x in b.column(column)), np.int64, b.num_rows)
    ends, first = np.cumsum(sizes), 0
    while first < b.num_rows:
        end = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield first, end
        first = end


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable over the links a-b.

    Alternating large-star and small-star steps; each is one aggregation (with map-side combine) and one
    join that adaptive execution can split, so a hub with very many links stays spread out. Rows with a
    null end and self-links are ignored, so nodes without a link don't appear. Each round is checkpointed.
    """
    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("v < u").distinct()
    e = cut(e)
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        small = cut(small)
        # done when all links are from a node to the one root it has, and no root hangs below another
        parents = small.groupBy("u").agg(F.count("*").alias("n"))
        roots = small.select(F.col("v").alias("u")).distinct()
        if parents.where("n > 1").isEmpty() and parents.join(roots, "u", "left_semi").isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("component")).union(small.select("v", "v").distinct())
        e = small
