"""Hashes of the words of many texts at once, by 64 bits."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

#: Bytes whose words are hashed at a time, more only for a longer word; any size gives the same hashes. Numbers of eight bytes for
#: each byte are held a few times over, and the powers stay in the worker.
PIECE = 1 << 16

_VALUE = np.random.Generator(np.random.PCG64(6)).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
#: Which bytes part words: blanks; or all but digits, letters and what is beyond ASCII.
BLANKS, OTHERS = np.zeros(256, bool), np.ones(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
OTHERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _pieces(data: bytes, parts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(place, piece): cut before what parts words."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not parts[data[end]]:
            end += 1
        yield at, data[at:end]
        at = end


def word_hashes(texts: list[bytes], parts: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin; one entry more at the end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for at, piece in _pieces(b" ".join(texts), parts):
        raw = np.frombuffer(piece, np.uint8)
        apart = np.concatenate(([True], parts[raw], [True]))
        edges = np.flatnonzero(apart[1:] != apart[:-1])
        first, end = edges[::2], edges[1::2]
        room = 1 << max(PIECE.bit_length() - 1, (len(raw) - 1).bit_length())
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUE[raw] * _powers(_BASE, room)[: len(raw)], out=sums[1:])
        hashes.append(mixed((sums[end] - sums[first]) * _powers(_INVERSE, room)[first] + (end - first).astype(np.uint64)))
        places.append(first + at)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), np.concatenate(([0], np.cumsum(sizes + 1))))
