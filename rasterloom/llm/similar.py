"""Near-duplicates by the Jaccard similarity of word shingles, exactly: SimHash and a prefix join, then verification of each pair.

SimHash fingerprints, those of op2, offer the texts that meet in two of six blocks of their bits. No distance of
fingerprints is a bound on the similarity, so the join offers what they miss; neither links a pair without verification.

Of two sets with a similarity of 0.8 or more, each has at least four fifths of its shingles in the other. So in any
order of all shingles they share one of their first n - ceil(0.8 n) + 1, and only these become keys. The order is that
of the hashes, with what many texts have at its end; which shingles go there changes the work, not the result. A key's
texts are first held against one of them, the one whose prefix others share most. After that only pairs that aren't
connected yet are verified: one by one for most keys, where sums of the lesser counts by hash bound what two sets share,
so that few pairs need to be met whole; in blocks of texts, without rows for pairs, for keys that many texts have.
Shingles, and texts of the same words, are known by hashes of 64 bits.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bloom, connected_components, cut, forget, mapped, passes, slices
from .words import mixed, word_hashes

#: Words of a shingle; the least similarity as a fraction.
SHINGLE, ABOVE, BELOW = 5, 4, 5
#: Keys that more texts than this have go to the end of the order, the most frequent first, at most so many.
USUAL, LISTED = 50, 1 << 20
#: Counts that sum up a set: of the shingles with each remainder of their hash, a power of two of them and no fewer than
#: COUNTS; one for each so many shingles or fewer.
COUNTS, PER_COUNT = 64, 8
#: A key of more texts is compared in blocks; shingles of a block.
CROWDED, BLOCK = 64, 1 << 19
_rng = np.random.Generator(np.random.PCG64(5))
#: Odd multipliers, one for each place in a shingle.
_PLACES = _rng.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def nodes(texts: list[bytes]) -> np.ndarray:
    """By which texts of the same words are one."""
    hashes, starts = word_hashes([x.lower() for x in texts])  # of bytes: A-Z only
    within = np.arange(len(hashes)) - np.repeat(starts[:-1], np.diff(starts))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed(hashes + within.astype(np.uint64) * _BASE))))
    return mixed(sums[starts[1:]] - sums[starts[:-1]])


def shingles(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """For each text the hashes of its shingles, ascending, each once; those of a shorter text are the text."""
    hashes, starts = word_hashes([x.lower() for x in texts])  # of bytes: A-Z only
    total = np.full(max(0, len(hashes) - shingle + 1), shingle, np.uint64)
    for i in range(shingle):
        total += hashes[i : i + len(total)] * _PLACES[i]
    total, out = mixed(total), []
    for a, b in itertools.pairwise(starts.tolist()):
        if b - a >= shingle:
            own = np.sort(total[a : b - shingle + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            out.append(mixed(np.array([(hashes[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)])) if a < b else hashes[a:b])
    return out


def prefix(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order that has `common` (ascending) last."""
    if len(common) and len(own):
        last = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
        own = np.concatenate((own[~last], own[last]))
    return own[: len(own) + 1 + (-ABOVE * len(own) // BELOW)] if len(own) else own


def mark(own: np.ndarray) -> bytes:
    """A set's counts, as little-endian unsigned 32-bit."""
    counts = COUNTS
    while counts * PER_COUNT < len(own):
        counts *= 2
    return np.bincount((own % np.uint64(counts)).astype(np.int64), minlength=counts).astype("<u4").tobytes()


def shared_at_most(xs: list[bytes], ys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of sets with these counts: the most that they may share, and both sizes together."""
    most, both = np.zeros(len(xs), np.int64), np.zeros(len(xs), np.int64)
    sizes = np.stack([np.fromiter(map(len, side), np.int64, len(side)) // 4 for side in (xs, ys)], axis=1)
    for m, n in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes[:, 0] == m) & (sizes[:, 1] == n))
        counts = []
        for side, k in ((xs, m), (ys, n)):  # the longer one is folded to the other's length
            raw = np.frombuffer(b"".join(side[i] for i in at.tolist()), "<u4").astype(np.int64)
            counts.append(raw.reshape(len(at), k // min(m, n), min(m, n)).sum(axis=1))
        most[at] = np.minimum(*counts).sum(axis=1)
        both[at] = counts[0].sum(axis=1) + counts[1].sum(axis=1)
    return most, both


def _mapped(docs: DataFrame, f: Callable[[list[bytes]], list[pa.Array]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end in slices(b, 0):
                yield pa.RecordBatch.from_arrays(f([x or b"" for x in b.column(0).slice(first, end - first).to_pylist()]), names)

    return docs.transform(mapped, run, schema)


def _close(na: Column, nb: Column, both: Column) -> Column:
    """Whether sets of these sizes that share so much are similar enough."""
    return both * (ABOVE + BELOW) >= (na + nb) * ABOVE


def _may(x: str, y: str) -> Column:
    """Whether sizes and places of a shared shingle allow enough in common."""
    na, nb, i, j = (F.col(f"{c}.{k}") for k in ("n", "at") for c in (x, y))
    return _close(na, nb, F.least(i, j) + F.least(na - i, nb - j))


def _with_both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """(a, b, x, y): the column's values of both ends of each pair."""
    joined = pairs.join(of.select(F.col("node").alias("a"), F.col(column).alias("x")), "a")
    return joined.join(of.select(F.col("node").alias("b"), F.col(column).alias("y")), "b").select("a", "b", "x", "y")


def _kept(joined: DataFrame, f: Callable[[list[bytes], list[bytes]], list[bool] | np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end in slices(b, 2):
                part = b.slice(first, end - first)
                keep = pa.array(np.asarray(f(part.column(2).to_pylist(), part.column(3).to_pylist()), bool))
                yield part.select(["a", "b"]).filter(keep)

    return joined.transform(mapped, run, "a long, b long")


def _bound(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    most, both = shared_at_most(xs, ys)
    return most * (ABOVE + BELOW) >= both * ABOVE


def _alike(xs: list[bytes], ys: list[bytes]) -> list[bool]:
    out = []
    for x, y in zip(shingles(xs), shingles(ys), strict=True):
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both * (ABOVE + BELOW) >= (len(x) + len(y)) * ABOVE)
    return out


def _told(texts: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """(node, text) of the nodes in column h of ends, n at most. texts: all of them, in a binary column."""
    sent = texts.sparkSession.sparkContext.broadcast(bloom(ends, n))

    def run(texts_: list[bytes]) -> list[pa.Array]:
        own = nodes(texts_)
        some = np.flatnonzero(passes(sent.value, own))
        return [pa.array(own[some].view(np.int64)), pa.array([texts_[i] for i in some.tolist()], pa.binary())]

    found = _mapped(texts, run, "node long, text binary").groupBy("node").agg(F.min("text").alias("text"))
    return cut(found.join(ends.withColumnRenamed("h", "node"), "node", "left_semi"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("h")).union(pairs.select("b"))


def _compare(block: pa.Table) -> pa.Table:
    """Of two blocks (or one, if no row is of the right side): links enough to connect what is linked and of different parts."""
    node_, part, side = (block.column(c).to_numpy() for c in ("node", "part", "side"))
    sets = shingles(block.column("text").to_pylist())
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    right = right if len(right) else left
    every = np.concatenate([sets[i] for i in right.tolist()])
    owner = np.repeat(right, [len(sets[i]) for i in right.tolist()])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    sizes = np.array([len(x) for x in sets])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    out: list[tuple[int, int]] = []
    for i in left.tolist():
        lo, hi = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero((both > 0) & (both * (ABOVE + BELOW) >= (sizes[i] + sizes) * ABOVE)).tolist():
            x, y = find(int(part[i])), find(int(part[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(node_[i]), int(node_[j])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _in_blocks(crowded: DataFrame, told: DataFrame) -> DataFrame:
    """(a, b): links between texts that share a key and aren't of the same part. crowded: (key, size, node, n, part)

    A block holds texts by their most frequent key; a part of many texts has blocks of its own, which aren't compared with
    each other. Blocks are compared where they share a key.
    """
    own = crowded.groupBy("node").agg(F.max(F.struct("size", "key")).getField("key").alias("first"), F.min("part").alias("part"), F.min("n").alias("n"))
    parts = own.groupBy("first", "part").agg(F.sum("n").alias("held")).withColumn("own_blocks", F.when(F.col("held") > BLOCK // 2, F.ceil(F.col("held") / BLOCK)))
    rest = parts.where("own_blocks IS NULL").groupBy("first").agg(F.ceil(F.sum("held") / BLOCK).alias("blocks"))
    dealt = own.join(parts, ["first", "part"]).join(rest, "first", "left")
    alone = F.when(F.col("own_blocks").isNotNull(), F.col("part"))
    number = F.when(alone.isNotNull(), F.pmod(F.xxhash64("node"), "own_blocks")).otherwise(F.pmod(F.xxhash64("part"), "blocks"))
    dealt = cut(dealt.select("node", "part", alone.alias("alone"), F.xxhash64("first", F.coalesce(alone, F.lit(0)), number, alone.isNull()).alias("block")))
    held = crowded.select("key", "node").join(dealt, "node").select("key", "block", "alone").distinct()
    x, y = held.select("key", F.col("block").alias("x"), F.col("alone").alias("ax")), held.select("key", F.col("block").alias("y"), F.col("alone").alias("ay"))
    met = x.join(y, "key").where("x <= y AND coalesce(ax != ay, true)").select("x", "y").distinct()
    member = dealt.select("block", "node", "part")
    sides = [met.join(member.withColumnRenamed("block", c), c).select("x", "y", "node", "part", F.lit(k).alias("side")) for k, c in enumerate("xy")]
    rows = sides[0].union(sides[1].where("x != y")).join(told, "node")
    return cut(rows.groupBy("x", "y").applyInArrow(_compare, "a long, b long"))


def _offered(ids: DataFrame) -> DataFrame:
    """(a, b): nodes that SimHash offers as alike, a < b. ids: (node, fp); of equal fingerprints one stands for all."""
    values = cut(ids.groupBy("node").agg(F.min("fp").alias("fp")))
    hubs = cut(values.groupBy("fp").agg(F.min("node").alias("hub")))
    same = values.join(hubs, "fp").where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    near = simhash.candidates(hubs.select("fp"))
    near = near.join(hubs.select(F.col("fp").alias("a"), F.col("hub").alias("x")), "a").join(hubs.select(F.col("fp").alias("b"), F.col("hub").alias("y")), "b")
    return cut(same.union(near.select(F.least("x", "y"), F.greatest("x", "y"))))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id), a row for each row of docs: the least id reachable over pairs of texts whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more.

    Null, empty and blank texts are one text without shingles, similar to no other; null ids never are a component's id.
    """
    spark = docs.sparkSession
    kind = dict(docs.select(F.col(f"`{doc_id}`").alias("doc_id")).dtypes)["doc_id"]
    chosen = docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias("text"), F.col(f"`{doc_id}`").alias("doc_id"))
    texts = chosen.select("text")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end in slices(b, 0):
                own = [x or b"" for x in b.column(0).slice(first, end - first).to_pylist()]
                prints = np.fromiter(map(simhash.fingerprint, own), np.uint64, len(own))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(first, end - first), *(pa.array(x.view(np.int64)) for x in (nodes(own), prints))], ["doc_id", "node", "fp"])

    ids = cut(chosen.transform(mapped, named, f"doc_id {kind}, node long, fp long"))
    offered = _offered(ids)
    forget(spark)

    def keys(common: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast(common)

        def run(own: list[bytes]) -> list[pa.Array]:
            first = [prefix(x, sent.value) for x in shingles(own)]
            return [pa.array(np.concatenate(first).view(np.int64)), pa.array(np.repeat(nodes(own).view(np.int64), [len(x) for x in first]))]

        return _mapped(texts, run, "key long, node long")

    usual = keys(np.empty(0, np.uint64)).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > USUAL).orderBy(F.desc("n"), "key").limit(LISTED).select("key").toArrow()
    common = np.sort(usual["key"].to_numpy().view(np.uint64)) if usual.num_rows else np.empty(0, np.uint64)
    forget(spark)
    held = cut(keys(common).groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select(F.col("key").alias("h")))
    forget(spark)
    # Only keys that other texts have too are sent on, and each text's counts once with them.
    sent = spark.sparkContext.broadcast((common, bloom(held, held.count())))
    del held

    def chosen_keys(own: list[bytes]) -> list[pa.Array]:
        sets = shingles(own)
        first = [prefix(x, sent.value[0]) for x in sets]
        sizes = np.array([len(x) for x in first])
        every = np.concatenate(first)
        some = passes(sent.value[1], every)
        at = (np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)[some]
        starts = np.concatenate(([0], np.cumsum(some)))[np.concatenate(([0], np.cumsum(sizes)))].astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array(x)) for x in (every[some].view(np.int64), at)]
        return [pa.array(nodes(own).view(np.int64)), pa.array([len(x) for x in sets], pa.int32()), pa.array(list(map(mark, sets)), pa.binary()), *lists]

    met = _mapped(texts, chosen_keys, "node long, n int, mark binary, keys array<long>, places array<int>").where(F.size("keys") > 0)
    met = cut(met.dropDuplicates(["node"]))
    sent.unpersist()
    forget(spark)
    marks = met.select("node", "mark")
    # The share of a text's prefix that others have, in thousandths.
    known = F.floor(1000 * F.size("keys") / (F.col("n") + 1 - F.ceil(F.col("n") * ABOVE / BELOW))).cast("int")
    near = met.select("node", "n", known.alias("known"), F.explode(F.arrays_zip("keys", "places")).alias("k")).select(F.col("k.keys").alias("key"), "node", "n", "known", F.col("k.places").alias("at"))
    central = near.groupBy("key").agg(F.max(F.struct("known", "node")).getField("node").alias("hub"), F.count("*").alias("size")).where("size > 1")
    near = cut(near.join(central, "key").drop("known"))
    hubs = near.where("node = hub").drop("hub", "size").alias("y")
    tried = near.where("node != hub").alias("x").join(hubs, "key").where(_may("x", "y")).select(F.least("y.node", "x.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).union(offered).distinct()
    tried = cut(_kept(_with_both(tried, marks, "mark"), _bound))
    forget(spark)
    links = cut(_kept(_with_both(tried, _told(texts, _ends(tried).distinct(), 2 * tried.count()), "text"), _alike))
    forget(spark)
    parts = connected_components(links)
    rest = near.drop("hub").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    several = rest.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
    rest = cut(rest.join(several, "key", "left_semi"))
    forget(spark)
    few, crowded = rest.where(F.col("size") <= CROWDED), rest.where(F.col("size") > CROWDED)
    x, y = few.alias("x"), few.alias("y")
    open_ = x.join(y, "key").where("x.part < y.part").where(_may("x", "y")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    open_ = cut(_kept(_with_both(open_.join(tried, ["a", "b"], "left_anti"), marks, "mark"), _bound))
    forget(spark)
    ends = cut(_ends(open_).union(crowded.select("node")).distinct())
    told = _told(texts, ends, ends.count())
    links = links.union(cut(_kept(_with_both(open_, told, "text"), _alike))).union(_in_blocks(crowded, told))
    del rest, few, crowded, x, y, near
    forget(spark)
    named_ = ids.join(connected_components(links), "node", "left").select("doc_id", F.coalesce("component", "node").alias("root"))
    least = named_.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named_.join(least, "root").select("doc_id", "component_id")
