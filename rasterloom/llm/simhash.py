"""SimHash near-dedup: fingerprints of word shingles, linked at a small Hamming distance through pigeonhole blocks.

A fingerprint is cut into BLOCKS blocks. Two fingerprints that differ in at most `distance` bits agree on at
least BLOCKS - distance blocks, so they meet under one of the keys made of so many blocks each; there the
distance is verified. Equal fingerprints are one class before any of this. A key that more than CROWDED
fingerprints have is not joined with itself: its fingerprints are linked exactly through common neighbours
(two values differ in at most two bits if and only if some value is within one bit of both), which costs 65
rows a fingerprint and no pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, mapped

SHINGLE, SEED, DISTANCE = 3, 42, 2
BLOCKS, CROWDED = 4, 256
#: Of candidates: blocks, bits within which all pairs meet, the most bits that two which meet may differ in, and the most
#: values of a key that meet each other.
NEAR_BLOCKS, NEAR, REACH, MEETING = 6, 4, 12, 4


def shingle_hashes(words: list[bytes], shingle: int, seed: int) -> list[int]:
    """Of each run of so many words, in order; of the whole where there are fewer."""
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)]


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, unsigned; zero where there are no words."""
    words = data.lower().split()  # of bytes: A-Z only, and 0x20, 0x09 to 0x0D only
    if not words:
        return 0
    hashes = shingle_hashes(words, shingle, seed)
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(values), 1 << 15):
        counts += np.unpackbits(values[at : at + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. A null text has no words."""
    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(t.as_py() or b"", shingle, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return chosen.transform(mapped, run, f"doc_id {dict(docs.dtypes)[doc_id]}, fp long")


def _keys(fp: Column, distance: int) -> Column:
    """The values of each choice of blocks, with the number of the choice."""
    width = 64 // BLOCKS
    blocks = [F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(BLOCKS)]
    return F.array(*(F.struct(F.lit(n).alias("choice"), F.xxhash64(*[blocks[i] for i in c]).alias("value")) for n, c in enumerate(combinations(range(BLOCKS), BLOCKS - distance))))


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): enough of the links between the distinct values of column fp to connect what is linked."""
    if not 0 < distance <= 2:
        raise ValueError("distance must be 1 or 2")
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"), distance)).alias("key"))
    held = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(held, "key")
    few = keyed.where(F.col("n") <= CROWDED)
    left, right = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    verified = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    many = keyed.where(F.col("n") > CROWDED).select("fp").distinct()
    # One bit apart from a common value: at most two apart from each other. For a distance of 1: the value itself or a neighbour.
    one = F.lit(1).cast("bigint")
    near = many.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", one, i))))).alias("hub"))
    if distance == 1:
        near = near.join(many.select(F.col("fp").alias("hub")), "hub", "left_semi")
    hubs = near.groupBy("hub").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("hub", "b")
    return verified.union(near.join(hubs, "hub").where("fp > b").select(F.col("fp").alias("a"), "b"))


def candidates(distinct: DataFrame, distance: int = NEAR, blocks: int = NEAR_BLOCKS, reach: int = REACH) -> DataFrame:
    """(a, b): pairs of the distinct values of column fp that agree on blocks - distance of the blocks, and so all that differ
    in at most `distance` bits; those over `reach` bits apart are left out. Of keys with over MEETING values a value is
    paired only with the least one of the most frequent, so that pairs grow with the values and not with their square:
    they are offered to a verification that doesn't rest on them alone.
    """
    if not 0 < distance < blocks or reach < distance:
        raise ValueError("distance must be at least 1, below the blocks and not above reach")
    ends = [64 * i // blocks for i in range(blocks + 1)]
    bits = [(1 << b) - (1 << a) for a, b in itertools.pairwise(ends)]
    masks = np.array([sum(c) for c in combinations(bits, blocks - distance)], np.uint64).view(np.int64).tolist()
    keyed = distinct.select("fp", F.explode(F.array(*(F.lit(m).cast("bigint") for m in masks))).alias("mask"))
    keyed = keyed.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    held = keyed.groupBy("mask", "value").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1")
    keyed = cut(keyed.join(held, ["mask", "value"]))
    few = keyed.where(F.col("n") <= MEETING)
    left, right = few.select("mask", "value", F.col("fp").alias("a")), few.select("mask", "value", F.col("fp").alias("b"))
    pairs = left.join(right, ["mask", "value"]).select("a", "b")
    many = keyed.where(F.col("n") > MEETING).groupBy("fp").agg(F.max(F.struct("n", "mask", "least")).getField("least").alias("least"))
    pairs = pairs.union(many.select("least", "fp"))
    return pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= reach)).distinct()


def components(found: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of (doc_id, fp): hexadecimal, and the smallest doc_id reachable over links.

    Null ids are kept and never are a component's id; it is null only where all its ids are. Repeated rows
    and ties are linked like others: equal fingerprints are one class.
    """
    found = cut(found)
    classes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(classes.select("fp"), distance)
    parts = connected_components(edges)
    least = classes.join(parts, classes["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    by_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.select("fp", "root").join(by_root, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """A row for each row of docs: doc_id, fingerprint, component_id.

    Null, empty and blank texts have the fingerprint zero, which links like any other. An empty table gives
    no rows. Further columns are not read, so their names don't matter.
    """
    return components(fingerprints(docs, doc_id=doc_id, text=text), distance)
