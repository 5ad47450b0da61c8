"""Benchmark decontamination over a distributed positional inverted index.

The training documents are indexed in segments, as many as their size asks for: for each term, a segment stores the
term's positions in ascending order. The index knows nothing of the test set, so any number of them can be looked up in
it. A window of consecutive test words is found by starting from the positions of its rarest term (by the counts of the
whole index), shifted by the term's offset, and intersecting them with the shifted positions of the next rarest terms.
Terms are known by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, slices
from .words import OTHERS, word_hashes

WINDOW = 10
#: Words of a segment (a longer document is a segment by itself), and test words that are held and sent to
#: the executors at a time. A larger test set is looked up in several rounds; the result is the same.
SEGMENT_WORDS, ROUND_WORDS = 1 << 18, 1 << 20


def terms_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 texts, A-Z lower-cased: runs of digits, letters a-z and characters beyond ASCII; and
    where each text's begin."""
    return word_hashes([(x or b"").lower() for x in texts], OTHERS)


@dataclass
class Tests:
    """Windows of test items, a row for each: places in `terms` (ascending hashes), -1 after the last of a short item;
    and the place of its item in `names`."""

    terms: np.ndarray
    windows: np.ndarray
    items: np.ndarray
    names: list[str]


def _windows(names: list[str], own: list[np.ndarray], window: int) -> Tests:
    terms, rows, items = np.unique(np.concatenate(own)), [], []
    for i, hashes in enumerate(own):
        ids = np.searchsorted(terms, hashes).astype(np.int32)
        if len(ids) < window:
            ids = np.pad(ids, (0, window - len(ids)), constant_values=-1)
        rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
        items.append(np.full(len(rows[-1]), i, np.int32))
    return Tests(terms, np.concatenate(rows), np.concatenate(items), names)


def rounds(items: Iterable[tuple[str, bytes | None]], window: int = WINDOW, most: int = ROUND_WORDS) -> Iterator[Tests]:
    """Windows of (item id, text) pairs, in rounds of bounded size; a longer item is a round by itself."""
    names: list[str] = []
    own: list[np.ndarray] = []
    size = 0
    for name, text in items:
        hashes, _ = terms_of([text])
        if not len(hashes):
            continue
        if size and size + len(hashes) > most:
            yield _windows(names, own, window)
            names, own, size = [], [], 0
        names.append(name)
        own.append(hashes)
        size += len(hashes)
    if size:
        yield _windows(names, own, window)


_INDEX = "segment long, doc_ids array<{}>, n_words array<int>, terms binary, counts binary, positions binary"


def build_index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows are segments: ids and word counts of their documents, and postings of all terms.

    One position is left out between documents, so no match reaches across.
    """
    kind = dict(docs.dtypes)[doc_id]
    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))

    def segment(number: int, keys: list, parts: list[np.ndarray], key_type: pa.DataType) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        hashes = np.concatenate(parts)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        fresh = np.flatnonzero(np.concatenate((np.ones(min(1, len(hashes)), bool), hashes[1:] != hashes[:-1])))
        places = np.arange(len(hashes)) + np.repeat(np.arange(len(sizes)), sizes)
        columns = [
            pa.array([number], pa.int64()), pa.array([keys], pa.list_(key_type)), pa.array([sizes.tolist()], pa.list_(pa.int32())),
            *(pa.array([x.tobytes()], pa.binary()) for x in (hashes[fresh].astype("<u8"), np.diff(np.append(fresh, len(hashes))).astype("<u4"), places[order].astype("<u4"))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["segment", "doc_ids", "n_words", "terms", "counts", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, parts, size, key_type = TaskContext.get().partitionId() << 40, [], [], 0, None
        for b in batches:
            key_type = b.schema.field(0).type
            for begin, end in slices(b, 1):
                hashes, starts = terms_of(b.column(1).slice(begin, end - begin).to_pylist())
                for i, key in enumerate(b.column(0).slice(begin, end - begin).to_pylist()):
                    own = hashes[starts[i] : starts[i + 1]]
                    if parts and size + len(own) > SEGMENT_WORDS:
                        yield segment(at, keys, parts, key_type)
                        at, keys, parts, size = at + 1, [], [], 0
                    keys.append(key)
                    parts.append(own)
                    size += len(own) + 1
        if parts:
            yield segment(at, keys, parts, key_type)

    return chosen.transform(mapped, run, _INDEX.format(kind))


def term_counts(index: DataFrame, terms: np.ndarray) -> DataFrame:
    """(term, n): how often each of these terms (by its place) stands in the whole index."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for b in batches:
            for own, counts in zip(b.column(0), b.column(1), strict=True):
                own, counts = np.frombuffer(own.as_py(), "<u8"), np.frombuffer(counts.as_py(), "<u4")
                if len(own):
                    at = np.minimum(np.searchsorted(own, sent.value), len(own) - 1)
                    total += np.where(own[at] == sent.value, counts[at], 0)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["term", "n"])

    return index.select("terms", "counts").transform(mapped, run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Segment:
    """Postings of one segment in memory."""

    def __init__(self, n_words: list[int], terms: bytes, counts: bytes, positions: bytes) -> None:
        self.n_words = np.array(n_words, np.int64)
        self.starts = np.cumsum(self.n_words + 1) - self.n_words - 1
        self.terms, self.counts = np.frombuffer(terms, "<u8"), np.frombuffer(counts, "<u4").astype(np.int64)
        self.positions = np.frombuffer(positions, "<u4")
        self.first = np.cumsum(self.counts) - self.counts
        self.size = int((self.n_words + 1).sum())

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Of terms by hash, the places of their lists; -1 where there is none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, place: int) -> np.ndarray:
        return self.positions[self.first[place] : self.first[place] + self.counts[place]].astype(np.int64) if place >= 0 else np.empty(0, np.int64)

    def phrases(self, hashes: np.ndarray, terms: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window numbers, first positions) of exact matches.

        hashes: of all test terms; terms (places in it) and offsets: a row for each window, rarest term first, -1 after
        sizes[i] terms.
        """
        lists = np.append(self.places(hashes), -2)  # -2: no term
        live = np.flatnonzero((lists[terms] != -1).all(axis=1))
        if not len(live):
            return
        # All postings in order of list and position: a look for (list, position) intersects with that list.
        keyed = np.repeat(np.arange(len(self.terms)), self.counts) << 32 | self.positions
        first = lists[terms[live, 0]]
        listed = self.counts[first]
        ends = np.cumsum(listed)
        begin = 0
        while begin < len(live):  # lists of about `most` positions at a time
            base = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + most, "right")))
            w, n = live[begin:end], listed[begin:end]
            window = np.repeat(w, n)
            within = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
            at = self.positions[np.repeat(self.first[first[begin:end]], n) + within] - offsets[window, 0].astype(np.int64)
            keep = (at >= 0) & (at + sizes[window] <= self.size)
            window, at = window[keep], at[keep]
            for rank in range(1, terms.shape[1]):
                if not len(window):
                    break
                wanted = lists[terms[window, rank]] << 32 | (at + offsets[window, rank])
                keep = (keyed[np.minimum(np.searchsorted(keyed, wanted), len(keyed) - 1)] == wanted) | (rank >= sizes[window])
                window, at = window[keep], at[keep]
            if len(window):
                yield window, at
            begin = end

    def near(self, terms: np.ndarray, within: int) -> list[tuple[int, int, int]]:
        """(document, first, last): narrowest stretches of at most `within` words with all the terms, in any order."""
        lists = sorted((self.postings(p) for p in self.places(np.unique(terms)).tolist()), key=len)
        if not lists or not len(lists[0]):
            return []
        rare = lists[0]
        for k, p in enumerate(lists[1:], 1):  # from the rarest: drop what has no next term close by
            i = np.searchsorted(p, rare - within + 1)
            ok = (i < len(p)) & (p[np.minimum(i, len(p) - 1)] < rare + within) if len(p) else np.zeros(len(rare), bool)
            rare = rare[ok]
            lists[k] = p
        out: list[tuple[int, int, int]] = []
        if not len(rare):
            return out
        merged = sorted((int(x), k) for k, p in enumerate([rare, *lists[1:]]) for x in p)
        count, have, low = [0] * len(lists), 0, 0
        for x, k in merged:
            count[k] += 1
            have += count[k] == 1
            while have == len(lists):
                y, j = merged[low]
                if count[j] == 1:
                    d = int(np.searchsorted(self.starts, y, "right")) - 1
                    if x - y < within and x < self.starts[d] + self.n_words[d]:
                        out.append((d, y - int(self.starts[d]), x - int(self.starts[d])))
                    have -= 1
                count[j] -= 1
                low += 1
        return out


def _ranked(tests: Tests, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, offsets and sizes of the windows, the rarest term of each first."""
    n = np.zeros(len(tests.terms) + 1, np.int64)
    n[list(counts)] = list(counts.values())
    n[-1] = np.iinfo(np.int64).max
    order = np.argsort(n[tests.windows], axis=1, kind="stable").astype(np.int32)
    return np.take_along_axis(tests.windows, order, axis=1), order, (tests.windows >= 0).sum(axis=1)


def search_phrases(index: DataFrame, tests: Tests) -> DataFrame:
    """(segment, place, doc_id, n_words, spans, items): a row for each document of the index.

    spans: disjoint [first, end) word ranges inside exact matches of windows; items: ids of their items.
    """
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    counts = {r.term: r.n for r in term_counts(index, tests.terms).collect()}  # no more rows than the round has terms
    sent = index.sparkSession.sparkContext.broadcast((tests.terms, *_ranked(tests, counts), tests.items, tests.names))
    span = pa.struct([("first", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, terms, offsets, sizes, items, names = sent.value
        for b in batches:
            for i in range(b.num_rows):
                number, keys, n_words, *lists = (b.column(k)[i].as_py() for k in range(6))
                s = Segment(n_words, *lists)
                edge = np.zeros(s.size + 2, np.int32)
                found: list[np.ndarray] = [np.empty((0, 2), np.int64)]
                for window, at in s.phrases(hashes, terms, offsets, sizes):
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + sizes[window], -1)
                    doc = np.searchsorted(s.starts, at, "right") - 1
                    found.append(np.unique(np.stack((doc, items[window]), axis=1), axis=0))
                hit = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
                first, end = np.flatnonzero(hit > 0), np.flatnonzero(hit < 0)
                spans: list[list] = [[] for _ in keys]
                own: list[list] = [[] for _ in keys]
                for d, x, y in zip((np.searchsorted(s.starts, first, "right") - 1).tolist(), first.tolist(), end.tolist(), strict=True):
                    spans[d].append({"first": x - int(s.starts[d]), "end": y - int(s.starts[d])})
                for d, item in np.unique(np.concatenate(found), axis=0).tolist():
                    own[d].append(names[item])
                n = len(keys)
                columns = [pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(keys, b.schema.field(1).type.value_type), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(own, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "place", "doc_id", "n_words", "spans", "items"])

    return index.transform(mapped, run, f"segment long, place int, doc_id {kind}, n_words long, spans array<struct<first:int,end:int>>, items array<string>")


def search_near(index: DataFrame, queries: dict[str, list[str]], within: int) -> DataFrame:
    """(query, doc_id, first, last): proximity matches of each query's words, in any order."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    asked = {q: terms_of([" ".join(words).encode()])[0] for q, words in queries.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                _, keys, n_words, *lists = (b.column(k)[i].as_py() for k in range(6))
                s = Segment(n_words, *lists)
                rows = [(q, keys[d], x, y) for q, t in asked.items() for d, x, y in s.near(t, within)]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), b.schema.field(1).type.value_type, pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "first", "last"])

    return index.transform(mapped, run, f"query string, doc_id {kind}, first long, last long")


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of docs.

    Null and empty texts have no words; items without words have no window; a null item id counts as the
    text 'null'. Repeated documents are judged one by one, repeated items and ids count once. Without any
    window all documents are clean; an empty docs gives no rows. Further columns are not read. The test set is
    read to the driver row by row and looked up in rounds of ROUND_WORDS words.
    """
    index = cut(build_index(docs, doc_id=doc_id, text=text))
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")), F.col(f"`{item_text}`").cast("string").cast("binary"))
    found = None
    for tests in rounds(((r[0], bytes(r[1]) if r[1] is not None else None) for r in items.toLocalIterator()), window):
        one = search_phrases(index, tests)
        found = one if found is None else cut(_both(found, one))
    if found is None:
        found = search_phrases(index, Tests(np.empty(0, np.uint64), np.empty((0, window), np.int32), np.empty(0, np.int32), []))
    step = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["first"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")),
    )
    ids = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", "n_words", step["n"].alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """What two rounds found in the same documents, which have the same segment and place in both."""
    b = b.select("segment", "place", F.col("spans").alias("spans_b"), F.col("items").alias("items_b"))
    return a.join(b, ["segment", "place"]).select("segment", "place", "doc_id", "n_words", F.concat("spans", "spans_b").alias("spans"), F.concat("items", "items_b").alias("items"))


ORACLE_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM bw WHERE len(w) > 0)
), starts AS (
  SELECT rid, w, unnest(range(1, len(w) + 1)) AS s FROM dw
), hits AS (
  SELECT rid, s, x.size, item_id FROM (
    SELECT rid, s, z.size AS size, array_to_string(w[s:s + z.size - 1], ' ') AS gram
    FROM starts, (SELECT DISTINCT size FROM windows) z WHERE s + z.size - 1 <= len(w)) x
  JOIN windows v ON v.gram = x.gram AND v.size = x.size
), covered AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + size)) AS p FROM hits) GROUP BY rid
), items AS (
  SELECT rid, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""
