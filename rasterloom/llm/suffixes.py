"""Repeated byte strings by a logarithmic family of sparse suffix arrays.

Suffixes are sampled by content: of the KEY-byte strings that start in a stretch of length - KEY + 1 bytes, the one
with the least hash (the first of equals) is the anchor of the string of `length` bytes that holds them, so equal
strings have their anchor at the same place. An entry of a suffix array is the hash of an anchor's first KEY
bytes, then the hash of all bytes of the strings that have this anchor, then a count; entries are in
ascending order of the two. A new batch gets its array and is merged with the existing levels in one scan
that finds the keys that meet others; two levels of equal size are then merged into one of the next size.

Where the second hash of an entry has come before, all its strings are repeated. Of a passage of such entries only as many
are looked up as cover all its bytes; those in between are looked up only where one of these isn't repeated after all
(the filter let it through). Where only the first hash of an entry has come before, the
bytes around the anchor go to the other ends of the match, once for each entry, and the strings in them are
compared one by one, by a hash of their own. Two different strings are taken for equal only if both hashes of
64 bits agree.

The units are bytes, or words, each by a hash of 64 bits; what is said of bytes here then holds for these.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_FILTER_BITS, bloom, complete, cut, forget, mapped, passes, remove, shared_dir
from .words import word_hashes

LENGTH, KEY, BATCHES = 400, 200, 4
#: Of passages by words: over 50 words are 51 or more.
WORDS, WORDS_KEY = 51, 20
#: Bytes that are hashed at a time; a longer text is read in stretches that overlap by length - 1.
CHUNK = 1 << 18
#: Entries of one key that are compared in one task; the strings of what has more are dealt out by their hashes.
CROWDED = 1 << 14

_rng = np.random.Generator(np.random.PCG64(20))
_VALUE = _rng.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = np.uint64((1 << 20) - 1)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(n, base, np.uint64)
        known[0] = 1
        known = _powers[int(base)] = np.multiply.accumulate(known)
    return known[:n]


_SPACED = re.compile(rb"\S+")


def _units(column: pa.Array, words: bool) -> Iterator[bytes | np.ndarray | None]:
    """Texts as they are, or their words' hashes."""
    for at in range(0, len(column), 256):
        texts = column.slice(at, 256).to_pylist()
        if words:
            hashes, starts = word_hashes([x or b"" for x in texts])
            texts = [hashes[a:b] for a, b in itertools.pairwise(starts.tolist())]
        yield from texts


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of which a difference, times the second array's entry of its first place, is the hash of what lies between."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_VALUE[data] if data.dtype == np.uint8 else data) * _power(_BASE, len(data)), out=sums[1:])
    return sums, _power(_INVERSE, len(data))


class Stretch:
    """Anchors of the strings of a few texts laid end to end."""

    def __init__(self, parts: list[tuple[int, int, bytes | np.ndarray]], length: int, key: int) -> None:
        """parts: (text's number, place of the first byte in it, at least `length` bytes)"""
        self.parts, self.length = parts, length
        sizes = np.fromiter((len(p[2]) for p in parts), np.int64, len(parts))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8 if isinstance(parts[0][2], bytes) else np.uint64)
        n = len(data)
        self.data = data
        self.sums, self.back = _sums(data)
        keys = _mix((self.sums[key:] - self.sums[:-key]) * self.back[: n - key + 1])
        low = (keys & ~_PLACE) | np.arange(len(keys), dtype=np.uint64)
        left, width = length - key + 1, 1
        while width * 2 <= left:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < left:
            low = np.minimum(low[: len(low) - (left - width)], low[left - width :])
        anchor = (low & _PLACE).astype(np.int64)
        valid = np.zeros(n + 1, np.int8)
        valid[ends - sizes] = 1
        np.add.at(valid, ends - length + 1, -1)
        valid = np.cumsum(valid)[: len(anchor)] > 0
        fresh = np.flatnonzero(valid & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~valid[:-1])))
        stop = np.flatnonzero(valid & np.concatenate(((anchor[1:] != anchor[:-1]) | ~valid[1:], [True])))
        self.first, self.last, self.anchor = fresh, stop, anchor[fresh]
        self.key = keys[self.anchor]
        shape = ((self.anchor - fresh) << 32 | (stop - fresh)).astype(np.uint64)
        self.whole = _mix(self._hash(fresh, stop + length) + _mix(shape))
        which = np.searchsorted(ends, fresh, "right")
        self.text = np.fromiter((p[0] for p in parts), np.int64, len(parts))[which]
        self.shift = (np.fromiter((p[1] for p in parts), np.int64, len(parts)) - (ends - sizes))[which]

    def _hash(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[first]) * self.back[first]

    def around(self, i: int) -> bytes:
        """All bytes of the strings of anchor i."""
        return self.data[self.first[i] : self.last[i] + self.length].tobytes()


_BETWEEN = np.dtype([("key", "<i8"), ("whole", "<i8"), ("first", "<i4"), ("last", "<i4")])


def _covering(s: Stretch, found: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """Of anchors in order, those that cover all that neighbouring ones cover; and for each of them the others on both
    sides up to the next of these, as _BETWEEN records with places relative to its own first string."""
    if not len(found):
        return found, []
    first, last, text = s.first[found], s.last[found], s.text[found]
    record = np.empty(len(found), _BETWEEN)
    record["key"], record["whole"], record["first"], record["last"] = s.key[found].view(np.int64), s.whole[found].view(np.int64), first, last
    breaks = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (first[1:] != last[:-1] + 1), [True]))).tolist()
    starts, reach = first.tolist(), (last + s.length).tolist()
    chosen, between = [], []
    for begin, end in itertools.pairwise(breaks):
        own = [begin]
        while own[-1] < end - 1:
            own.append(bisect.bisect_right(starts, reach[own[-1]], own[-1] + 1, end) - 1)
        for before, at, after in zip([begin, *own], own, [*own[1:], end], strict=False):
            if before + 1 < at or at + 1 < after:
                near = np.concatenate((record[before + 1 : at], record[at + 1 : after]))
                near["first"] -= starts[at]
                near["last"] -= starts[at]
                between.append(near.tobytes())
            else:
                between.append(None)
        chosen += own
    return found[chosen], between


def _strings(contexts: list[bytes], length: int, words: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string of each context: the context's number, the string's place in it, its hash."""
    kind = np.dtype(np.uint64 if words else np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts)) // kind.itemsize
    begin, count = np.cumsum(sizes) - sizes, sizes - length + 1
    sums, back = _sums(np.frombuffer(b"".join(contexts), kind))
    owner = np.repeat(np.arange(len(contexts)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[owner] + place
    return owner, place, _mix((sums[at + length] - sums[at]) * back[at])


def _stretches(texts: Iterator[bytes | np.ndarray | None], length: int, key: int) -> Iterator[Stretch]:
    held: list[tuple[int, int, bytes | np.ndarray]] = []
    size = 0
    for number, data in enumerate(texts):
        n = len(data) if data is not None else 0
        for at in range(0, max(0, n - length + 1), CHUNK):
            part = data[at : at + CHUNK + length - 1]
            if held and size + len(part) > CHUNK + length - 1:
                yield Stretch(held, length, key)
                held, size = [], 0
            held.append((number, at, part))
            size += len(part)
    if held:
        yield Stretch(held, length, key)


def _bytes_of(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias("data"))


def entries(docs: DataFrame, *, text: str = "text", length: int = LENGTH, key: int = KEY, words: bool = False) -> DataFrame:
    """(key, whole, n): the sparse suffix array's entries, a few times over where a text repeats them; n is 1 or 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in _stretches(_units(b.column(0), words), length, key):
                order = np.lexsort((s.whole, s.key))
                k, w = s.key[order], s.whole[order]
                fresh = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (w[1:] != w[:-1]))))
                n = np.minimum(np.diff(np.append(fresh, len(k))), 2).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(k[fresh].view(np.int64)), pa.array(w[fresh].view(np.int64)), pa.array(n)], ["key", "whole", "n"])

    return _bytes_of(docs, text).transform(mapped, run, "key long, whole long, n int")


@dataclass(frozen=True)
class Lasting:
    """A folder in which a family's levels stay, for batches that later runs add.

    new: the rows to add, all rows of docs if None. batch: their name; a batch of a name that the levels
    have already is not added again, so a run that broke off can be repeated. docs must hold every text that was
    ever added, as the bytes around partial matches are read from it.
    """

    folder: str
    batch: str
    new: DataFrame | None = None


class SuffixFamily:
    """Levels of sparse suffix arrays, each a table in the shared folder; level i has about 2**i batches' entries.

    With a folder of its own the family goes on from what was added there before. Its state is written anew after
    each batch, and the tables that it no longer names are deleted only then, so a broken run leaves the last state.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, options: tuple = ()) -> None:
        self.spark, self.levels, self.found, self.names = spark, {}, [], []
        self.at = folder or f"{shared_dir(spark)}/suffixes-{uuid.uuid4().hex}"
        self.written, self.states, self.lasts = 0, 0, folder is not None
        self.options = list(options)
        done = complete(spark, f"{self.at}/state") if self.lasts else []
        if done:
            self.states = max(done)
            state = json.loads(spark.read.schema("state string").parquet(f"{self.at}/state/{self.states}").first()[0])
            if state["options"] != self.options:
                raise ValueError(f"the levels in {folder} are of {state['options']}, not of {self.options}")
            self.levels = {int(level): path for level, path in state["levels"].items()}
            self.found, self.names, self.written = state["found"], state["names"], state["written"]

    def _save(self) -> None:
        state = {"options": self.options, "levels": self.levels, "found": self.found, "names": self.names, "written": self.written}
        self.states += 1
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{self.at}/state/{self.states}")
        remove(self.spark, f"{self.at}/state/{self.states - 1}")

    def _write(self, array: DataFrame) -> str:
        self.written += 1
        path = f"{self.at}/{self.written}"
        array.write.mode("overwrite").parquet(path)
        return path

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("key long, whole long, n int").parquet(path)

    @staticmethod
    def _merged(arrays: list[DataFrame]) -> DataFrame:
        """One array in order of its entries; an entry's count stops at 2."""
        every = arrays[0]
        for a in arrays[1:]:
            every = every.unionByName(a)
        return every.groupBy("key", "whole").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"))

    def add(self, batch: DataFrame, name: str | None = None) -> None:
        """Add (key, whole, n) rows: merge-scan them against all levels for matches, then merge levels of equal size.
        A name that was added before adds nothing."""
        if name is not None and name in self.names:
            return
        own = self._write(self._merged([batch]).sortWithinPartitions("key", "whole"))
        new = self._read(own)
        scanned = new.withColumn("new", F.lit(True))
        for path in self.levels.values():
            scanned = scanned.unionByName(self._read(path).withColumn("new", F.lit(False)))
        runs = scanned.groupBy("key", "whole").agg(F.sum("n").alias("n"), F.max("new").alias("new"))
        # of a key: occurrences, entries that stand alone, and whether the batch has it
        keys = runs.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("alone"), F.max("new").alias("new"))
        matched = keys.where("new AND n > 1").select("key", (F.col("alone") > 0).alias("partly"))
        self.found.append(self._write(matched))
        self.names += [name] * (name is not None)
        level, dead = 0, []
        while level in self.levels:
            older = self.levels.pop(level)
            merged = self._write(self._merged([self._read(older), self._read(own)]).sortWithinPartitions("key", "whole"))
            dead += [older, own]
            own, level = merged, level + 1
            if not self.lasts:
                while dead:
                    remove(self.spark, dead.pop())
        self.levels[level] = own
        if self.lasts:
            self._save()
        for path in dead:
            remove(self.spark, path)

    def matches(self) -> tuple[DataFrame, DataFrame]:
        """(key, whole) of entries that occur twice or more, and (key) of those where others stand alone beside others."""
        keys = self.spark.read.schema("key long, partly boolean").parquet(*self.found).groupBy("key").agg(F.lit(1).alias("one"))
        every = self._merged([self._read(p) for p in self.levels.values()])
        twice = every.where("n > 1").select("key", "whole")
        alone = every.where("n = 1").join(keys.select("key"), "key", "left_semi").select("key").distinct()
        return twice, alone

    def close(self) -> None:
        """Delete all tables; what `matches` gave must have been written before."""
        remove(self.spark, self.at)


def identity(data: Column) -> list[Column]:
    """Two longs by which equal texts are known: XXH64, and CRC32 with the length."""
    return [F.xxhash64(data), F.shiftleft(F.crc32(data), 31) + F.octet_length(data)]


def repeats(docs: DataFrame, *, text: str = "text", length: int = LENGTH, key: int = KEY, batches: int = BATCHES, words: bool = False, lasting: Lasting | None = None) -> DataFrame:
    """(id1, id2, spans): for each text with repeated strings of `length` bytes, what they cover.

    spans: binary, little-endian 64-bit [first, end) pairs, disjoint and ascending; in words, if `length` and `key` are.
    """
    spark = docs.sparkSession
    family = SuffixFamily(spark, f"{lasting.folder}/{'words' if words else 'bytes'}" if lasting else None, (length, key))
    long_ones = lambda df: df.select(F.col(f"`{text}`").cast("string").alias("__text")).where(F.octet_length("__text") >= (2 * length - 1 if words else length))
    data = long_ones(docs)
    new = data if lasting is None or lasting.new is None else long_ones(lasting.new)
    try:
        for i in range(batches):
            part = new.where(F.pmod(F.xxhash64("__text"), F.lit(batches)) == i) if batches > 1 else new
            family.add(entries(part, text="__text", length=length, key=key, words=words), f"{lasting.batch} {i} of {batches}" if lasting else None)
        twice, alone = family.matches()
        twice, alone = cut(twice), cut(alone)
    finally:
        if not lasting:
            family.close()
    n_twice, n_alone = twice.count(), alone.count()
    filters = spark.sparkContext.broadcast((bloom(twice.select(F.col("whole").alias("h")), n_twice, MOST_FILTER_BITS), bloom(alone.select(F.col("key").alias("h")), n_alone, MOST_FILTER_BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole_filter, key_filter = filters.value
        for b in batches:
            texts = [x.as_py() for x in b.column(0)]
            id1 = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in texts), np.uint64, len(texts)).view(np.int64)
            id2 = np.fromiter(((zlib.crc32(x) << 31) + len(x) for x in texts), np.int64, len(texts))
            sent: set[tuple[int, int]] = set()
            for s in _stretches(_units(b.column(0), words), length, key):
                full, between = _covering(s, np.flatnonzero(passes(whole_filter, s.whole)))
                part = []
                for i in np.flatnonzero(passes(key_filter, s.key)).tolist():
                    if (entry := (int(s.key[i]), int(s.whole[i]))) not in sent:  # equal entries have equal bytes
                        sent.add(entry)
                        part.append(i)
                every = np.concatenate((full, np.array(part, np.int64)))
                between += [None] * len(part)
                around = [None] * len(full) + [s.around(i) for i in part]
                columns = [s.key[every].view(np.int64), s.whole[every].view(np.int64), id1[s.text[every]], id2[s.text[every]], s.first[every] + s.shift[every], s.last[every] + s.shift[every]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(around, pa.binary()), pa.array(between, pa.binary())], ["key", "whole", "id1", "id2", "first", "last", "around", "between"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of their own for what stands around an entry that isn't repeated."""
        for b in batches:
            parts = [np.frombuffer(x.as_py(), _BETWEEN) for x in b.column(3)]
            every = np.concatenate([*parts, np.empty(0, _BETWEEN)])
            owner = np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))
            id1, id2, base = (b.column(i).to_numpy()[owner] for i in range(3))
            columns = [every["key"], every["whole"], id1, id2, base + every["first"], base + every["last"]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["key", "whole", "id1", "id2", "first", "last"])

    rows = cut(_bytes_of(data, "__text").transform(mapped, run, "key long, whole long, id1 long, id2 long, first long, last long, around binary, between binary"))
    looked_up = rows.where("around IS NULL").drop("around").join(twice.withColumn("repeated", F.lit(True)), ["key", "whole"], "left")
    doubtful = looked_up.where("repeated IS NULL AND between IS NOT NULL").select("id1", "id2", "first", "between")
    doubtful = doubtful.transform(mapped, unpack, "key long, whole long, id1 long, id2 long, first long, last long").join(twice, ["key", "whole"], "left_semi")
    full = looked_up.where("repeated").select("id1", "id2", "first", "last").union(doubtful.select("id1", "id2", "first", "last"))
    near = rows.where("around IS NOT NULL").drop("between")
    sizes = near.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    near = near.join(sizes, "key")
    few = near.where(F.col("size") <= CROWDED).repartition("key").sortWithinPartitions("key").drop("size")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of keys: the strings that entries of one key share. A key's rows are held together, no more than CROWDED."""
        rest: pa.RecordBatch | None = None
        for b in itertools.chain(batches, (None,)):
            if b is not None and not b.num_rows:
                continue
            if b is not None and rest is not None:
                b = pa.concat_batches([rest, b])
            held = rest if b is None else b
            if held is None:
                continue
            keys = held.column(0).to_numpy()
            end = len(keys) if b is None else int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            rest = held.slice(end)
            yield from _shared(held.slice(0, end), length, words)

    found = few.transform(mapped, compare, "id1 long, id2 long, first long, last long")
    crowded = near.where(F.col("size") > CROWDED).drop("size")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                owner, place, hashed = _strings(part.column(6).to_pylist(), length, words)
                first = part.column(4).to_numpy()[owner] + place
                names = ["key", "whole", "id1", "id2", "first", "hash"]
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(owner)) for i in range(4)), pa.array(first), pa.array(hashed.view(np.int64))], names)

    single = crowded.transform(mapped, split, "key long, whole long, id1 long, id2 long, first long, hash long")
    again = single.groupBy("key", "hash").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a < b").select("key", "hash")
    found = found.union(single.join(again, ["key", "hash"], "left_semi").select("id1", "id2", "first", F.col("first").alias("last")))
    full = full.union(found)
    # Equal texts give equal rows; what is left of one text is no more than its length.
    listed = full.distinct().groupBy("id1", "id2").agg(F.collect_list(F.struct("first", "last")).alias("found"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for x in b.column(2):
                v = x.values
                spans.append(_cover(v.field(0).to_numpy(), v.field(1).to_numpy() + length).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.binary())], ["id1", "id2", "spans"])

    return listed.transform(mapped, join, "id1 long, id2 long, spans binary")


def _shared(b: pa.RecordBatch, length: int, words: bool) -> Iterator[pa.RecordBatch]:
    """(id1, id2, first, last) of the strings that are in two or more different entries of a key."""
    at, n = 0, b.num_rows
    keys = b.column(0).to_numpy()
    while at < n:
        end = min(n, at + 1024)
        while end < n and keys[end] == keys[end - 1]:
            end += 1
        part = b.slice(at, end - at)
        at = end
        entry = np.stack((part.column(0).to_numpy(), part.column(1).to_numpy()), axis=1)
        _, once = np.unique(entry, axis=0, return_index=True)
        part = part.take(pa.array(np.sort(once)))
        owner, place, hashed = _strings(part.column(6).to_pylist(), length, words)
        pairs = np.empty(len(owner), [("key", "<i8"), ("hash", "<u8")])
        pairs["key"], pairs["hash"] = part.column(0).to_numpy()[owner], hashed
        order = np.lexsort((pairs["hash"], pairs["key"]))
        same = pairs[order][1:] == pairs[order][:-1]
        twice = np.zeros(len(owner), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.flatnonzero(twice)
        if not len(hit):
            continue
        run = np.concatenate(([True], (owner[hit][1:] != owner[hit][:-1]) | (place[hit][1:] != place[hit][:-1] + 1)))
        first, last = hit[run], hit[np.append(np.flatnonzero(run)[1:] - 1, len(hit) - 1)]
        who, base = owner[first], part.column(4).to_numpy()
        columns = [part.column(2).to_numpy()[who], part.column(3).to_numpy()[who], base[who] + place[first], base[who] + place[last]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["id1", "id2", "first", "last"])


def _cover(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Disjoint [first, end) pairs that cover the same; touching ones are one."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.concatenate(([True], first[1:] > reach[:-1])))
    return np.stack((first[fresh], reach[np.append(fresh[1:] - 1, len(reach) - 1)]), axis=1)


def _in_bytes(data: bytes, spans: bytes) -> np.ndarray:
    """Spans of words as spans of bytes, from the first word's first to the last one's last."""
    at = np.array([m.span() for m in _SPACED.finditer(data)], "<i8").reshape(-1, 2)
    pairs = np.frombuffer(spans, "<i8").reshape(-1, 2)
    return np.stack((at[pairs[:, 0], 0], at[pairs[:, 1] - 1, 1]), axis=1)


def _together(docs: DataFrame, text: str, **options) -> DataFrame:
    """As `repeats`, also with what repeated strings of WORDS words cover."""
    by_bytes = cut(repeats(docs, text=text, **options))
    forget(docs.sparkSession)
    by_words = cut(_passages(docs, text, **options))
    forget(docs.sparkSession)
    data = F.col(f"`{text}`").cast("string")
    rows = docs.select(data.cast("binary").alias("data"), *(c.alias(n) for c, n in zip(identity(data), ("id1", "id2"), strict=True)))
    rows = rows.join(by_words, ["id1", "id2"]).dropDuplicates(["id1", "id2"])

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [_in_bytes(d.as_py(), s.as_py()).tobytes() for d, s in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.binary())], ["id1", "id2", "spans"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for x in b.column(2).to_pylist():
                pairs = np.frombuffer(b"".join(x), "<i8").reshape(-1, 2)
                spans.append(_cover(pairs[:, 0], pairs[:, 1]).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.binary())], ["id1", "id2", "spans"])

    kind = "id1 long, id2 long, spans binary"
    every = by_bytes.union(rows.select("id1", "id2", "data", "spans").transform(mapped, turned, kind))
    return every.groupBy("id1", "id2").agg(F.collect_list("spans").alias("spans")).transform(mapped, joined, kind)


def _kept(data: bytes, spans: bytes | None) -> tuple[bytes, int]:
    """What is left of a text, and the number of removed runs."""
    if not spans:
        return data, 0
    pairs = np.frombuffer(spans, "<i8").reshape(-1, 2).tolist()
    out, at = [], 0
    for first, end in pairs:
        out.append(data[at:first])
        at = end
    out.append(data[at:])
    return b"".join(out), len(pairs)


def _passages(docs: DataFrame, text: str, **options) -> DataFrame:
    """`repeats` by strings of WORDS words."""
    return repeats(docs, text=text, **options | {"length": WORDS, "key": WORDS_KEY, "words": True})


def _with_spans(docs: DataFrame, text: str, carried: list[Column], by_words: bool = False, passages: bool = False, **options) -> DataFrame:
    """The carried columns, then text as data, and spans; one row for each row of docs. passages: after them also spans of words."""
    found = (_together if by_words else repeats)(docs, text=text, **options)
    if passages:
        found = cut(found)
        forget(docs.sparkSession)
        if not options.get("lasting"):  # levels that go at once needn't be merged
            options["batches"] = 1
        found = found.join(_passages(docs, text, **options).withColumnRenamed("spans", "passages"), ["id1", "id2"], "full")
    found = found.select(F.col("id1").alias("__id1"), F.col("id2").alias("__id2"), F.col("spans").alias("__spans"), *[F.col("passages").alias("__passages")] * passages)
    data = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    id1, id2 = identity(data)
    rows = docs.select(*carried, data.cast("binary").alias("__data"), id1.alias("__k1"), id2.alias("__k2"))
    return rows.join(found, (F.col("__k1") == F.col("__id1")) & (F.col("__k2") == F.col("__id2")), "left").drop("__k1", "__k2", "__id1", "__id2")


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", texts: bool = False, passages: bool = False, length: int = LENGTH, key: int = KEY, batches: int = BATCHES, lasting: Lasting | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept][, n_passage_words]), a row for each row of docs.

    Each byte is removed that some string of `length` bytes covers which also starts elsewhere, in the same
    text or another; texts are judged as they come in. A null text is empty; texts under `length` bytes
    are left alone; equal texts of `length` bytes or more go altogether. Null and repeated ids are
    rows like others; an empty table gives no rows. Further columns are not read.
    passages: n_passage_words counts the words (parted by blanks) in passages of WORDS words or more that start elsewhere
    too; many of them have fewer than `length` bytes. They are told, not removed; `clean_texts` can remove them.
    lasting: keep the levels in its folder, and add only its new rows to those that are there; the result is of all docs.
    """
    kind = dict(docs.dtypes)[doc_id]
    rows = _with_spans(docs, text, [F.col(f"`{doc_id}`").alias("doc_id")], passages=passages, length=length, key=key, batches=batches, lasting=lasting)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for data, found in zip(b.column(1), b.column(2), strict=True):
                data = data.as_py()
                left, n = _kept(data, found.as_py())
                sizes.append(len(data))
                removed.append(len(data) - len(left))
                spans.append(n)
                digests.append(hashlib.sha256(left).hexdigest())
                if texts:
                    kept.append(left)
            columns = [b.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, spans)), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            if passages:
                pairs = (np.frombuffer(x.as_py() or b"", "<i8").reshape(-1, 2) for x in b.column(3))
                columns.append(pa.array([int((p[:, 1] - p[:, 0]).sum()) for p in pairs], pa.int64()))
                names.append("n_passage_words")
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.transform(mapped, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "") + (", n_passage_words long" if passages else ""))


def clean_texts(docs: DataFrame, *, text: str = "text", length: int = LENGTH, key: int = KEY, batches: int = BATCHES, by_words: bool = False) -> DataFrame:
    """docs with what `remove_repeats` leaves of each text, all other columns as they are; a null text stays null.

    A character that is cut through goes whole. by_words: passages of WORDS words or more that start elsewhere too go as well,
    however few bytes they have and whatever blanks stand between the words.
    """
    names = [c for c in docs.columns if c != text]
    own = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)]
    rows = _with_spans(docs, text, [*own, F.col(f"`{text}`").isNull().alias("__null")], by_words=by_words, length=length, key=key, batches=batches)

    @F.pandas_udf("string")
    def left(data, spans):
        return data.combine(spans, lambda d, s: _kept(bytes(d), bytes(s) if s is not None else None)[0].decode("utf-8", "ignore"))

    # Nondeterministic in name only: else a filter on the text is pushed below it and has it run a second time, in a second
    # worker beside each task's own, and Spark keeps idle workers as long as others are in use.
    left = left.asNondeterministic()
    done = rows.withColumn("__left", F.when(F.col("__spans").isNull(), F.col("__data").cast("string")).otherwise(left("__data", "__spans")))
    out = []
    for c in docs.columns:
        out.append(F.when(F.col("__null"), None).otherwise(F.col("__left")).alias(c) if c == text else F.col(f"__c{names.index(c)}").alias(c))
    return done.select(*out)
