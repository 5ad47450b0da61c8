"""Packing of token ids into fixed windows by best-fit decreasing.

A document of at least a window's tokens is first cut into full windows. What remains of the documents of one
input partition is packed in batches of bounded size: longest first, each goes into the tightest open window,
found in a segment tree over remaining capacities. Then the emptiest windows are dissolved to fill the gaps of
the others, and the one window that is left over is cut into sequences whose lengths are powers of two, which
need no padding. There is no shuffle; a lost task is done again from its own rows with the same result.
"""

from __future__ import annotations

import contextlib
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

WINDOW, END_ID, TOKENIZER = 2048, 1, "byte_bpe_50k"
#: What one batch of remainders may hold: documents and bytes of ids. Bounds memory, not the result's completeness.
BATCH_DOCS, BATCH_BYTES = 20_000, 48 << 20


class CapacityTree:
    """Segment tree over the capacities 1 to size: which of them some open window has left."""

    def __init__(self, size: int) -> None:
        self.width = 1
        while self.width <= size:
            self.width *= 2
        self.some = bytearray(2 * self.width)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        if len(self.windows[capacity]) == 1:
            at = self.width + capacity
            while at and not self.some[at]:
                self.some[at] = 1
                at //= 2

    def tightest(self, least: int) -> int:
        """The least capacity from `least` on that a window has, or 0."""
        at, some = self.width + least, self.some
        if some[at]:
            return least
        while at > 1:
            if not at & 1 and some[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if some[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return 0

    def take(self, capacity: int) -> int:
        window = self.windows[capacity].pop()
        if not self.windows[capacity]:
            at, some = self.width + capacity, self.some
            some[at] = 0
            while at > 1 and not (some[at] or some[at ^ 1]):
                at //= 2
                some[at] = 0
        return window


def pack(lengths: Sequence[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (index, start, length); each length is from 1 to window - 1, all are placed whole or cut.

    Each sequence is full or has a power of two as its length.
    """
    tree, windows, left = CapacityTree(window), [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        capacity = tree.tightest(n)
        if capacity:
            w = tree.take(capacity)
        else:
            w, capacity = len(windows), window
            windows.append([])
            left.append(window)
        windows[w].append((i, 0, n))
        left[w] = capacity - n
        if left[w]:
            tree.add(left[w], w)
    gaps = sorted((w for w in range(len(windows)) if left[w]), key=lambda w: (left[w], w))
    low, high = 0, len(gaps) - 1
    while low < high:
        w, donor = gaps[low], windows[gaps[high]]
        while left[w] and donor:
            i, start, n = donor.pop()
            part = min(n, left[w])
            windows[w].append((i, start + n - part, part))
            left[w] -= part
            if n > part:
                donor.append((i, start, n - part))
        if not left[w]:
            low += 1
        if not donor:
            high -= 1
    if low == high and gaps:
        rest, windows[gaps[low]] = windows[gaps[low]], []
        total = sum(n for _, _, n in rest)
        rest.reverse()
        for bit in reversed(range(total.bit_length())):
            if total >> bit & 1:
                room, out = 1 << bit, []
                while room:
                    i, start, n = rest.pop()
                    part = min(n, room)
                    out.append((i, start, part))
                    room -= part
                    if n > part:
                        rest.append((i, start + part, n - part))
                windows.append(out)
    return [w for w in windows if w]


#: Characters of which both libraries below have the same classes: scripts that have long been in Unicode.
_SETTLED = "\x00-\u024f\u0370-\u03ff\u0400-\u052f\u2000-\u206f\u3040-\u30ff\u4e00-\u9fa5\uac00-\ud7a3"
_UNSETTLED = re.compile(f"[^{_SETTLED}]")


class Encoder:
    """Ids of texts by a file of public tokenizers, as little-endian unsigned 32-bit."""

    def __init__(self, name: str = TOKENIZER) -> None:
        import public_tokenizers

        self.path = public_tokenizers.path(f"{name}.json")
        self.quick, self.added = None, None
        if name == "byte_bpe_50k":  # the same vocabulary and merges as ranks, for a quicker library
            import base64
            import json

            import tiktoken

            with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            with open(self.path, encoding="utf-8") as f:
                self.added = re.compile("|".join(re.escape(t["content"]) for t in json.load(f)["added_tokens"]) or "(?!)")

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> bytes:
        if self.quick and (text.isascii() or not _UNSETTLED.search(text)) and not self.added.search(text):
            with contextlib.suppress(ValueError):  # its split gives up on very long runs of white space
                return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}
_SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, tokenizer: str = TOKENIZER, ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), a row for each piece.

    A null or empty text is one document of the end id alone; null and repeated ids are packed like any
    others; an empty table gives no rows. Very long texts are cut into full windows. Further columns are not
    read. `ids` adds the piece's ids as little-endian unsigned 32-bit.
    sequence_id is the task's partition times 2**40 plus a count, so it is unique over the result.
    """
    kind = dict(docs.dtypes)[doc_id]
    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    out_type = _SCHEMA.format(kind) + (", ids binary" if ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        size = 0
        key_type = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(8)]
            arrays = [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if ids:
                arrays.append(pa.array(columns[7], pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, size
            rows = []
            for pieces in pack([len(x[2]) // 4 for x in held], window):
                offset = 0
                for i, start, n in pieces:
                    key, begin, data, total = held[i]
                    part = data[4 * start : 4 * (start + n)]
                    rows.append((key, begin + start, n, zlib.crc32(part), total, sequence, offset, part if ids else None))
                    offset += n
                sequence += 1
                if len(rows) >= 20_000:
                    yield batch(rows)
                    rows = []
            held.clear()
            size = 0
            if rows:
                yield batch(rows)

        for b in batches:
            key_type = b.schema.field(0).type
            rows = []
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = encode(t.as_py() or "") + end
                total = len(data) // 4
                whole = total - total % window
                for start in range(0, whole, window):
                    part = data[4 * start : 4 * (start + window)]
                    rows.append((key, start, window, zlib.crc32(part), total, sequence, 0, part if ids else None))
                    sequence += 1
                if whole < total:
                    held.append((key, whole, data[4 * whole :], total))
                    size += 4 * (total - whole)
                if len(held) >= BATCH_DOCS or size >= BATCH_BYTES:
                    yield from flush()
                if len(rows) >= 10_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)
        if held:
            yield from flush()

    return chosen.transform(mapped, run, out_type)
