"""The coder for many intervals at once against the one for a single interval."""

import tracemalloc

import numpy as np
import pytest

from rasterloom.operators import batch, scan
from rasterloom.operators import container as c
from rasterloom.operators.errors import StreamError
from rasterloom.operators.scan import Preset

from .test_codec import picture


def samples(rng, kind, shape, bits):
    if kind == 0:
        return picture(rng, shape, bits)
    if kind == 1:
        return rng.integers(0, 1 << bits, shape).astype(np.int32)
    if kind == 2:
        return np.full(shape, int(rng.integers(0, 1 << bits)), np.int32)
    return np.minimum(rng.integers(0, 3, shape), (1 << bits) - 1).astype(np.int32)


@pytest.mark.parametrize("bits", [2, 8, 12, 16])
@pytest.mark.parametrize("components,mode", [(1, 0), (3, 1), (3, 2), (2, 1), (2, 2), (4, 1), (4, 2)])
def test_same_bits_and_samples(monkeypatch, bits, components, mode):
    rng = np.random.default_rng(bits + components)
    for near in (0, 1):
        for given in (Preset(), Preset(reset=3)):
            preset = scan.explicit_preset(given, bits, near)
            kind = batch.Kind(bits, components, mode, near, preset)
            units = [samples(rng, i % 4, (components, int(rng.integers(1, 20)), int(rng.choice([1, 2, 7, 23]))), bits) for i in range(60)]
            coded = [scan.encode(list(v), bits, mode, near, preset) for v in units]
            if not near:
                assert batch.encode_intervals([(v, kind) for v in units]) == coded
            parts = [batch.Part(b, *v.shape[1:], kind) for b, v in zip(coded, units, strict=True)]
            alone = [scan.decode_interval(scan.bits_of(b), v.shape[1:], bits, components, mode, near, preset) for b, v in zip(coded, units, strict=True)]
            for least in (1, 30, 72):  # all together to the end; the last ones, and all but some lines, one by one
                monkeypatch.setattr(batch, "LEAST_INTERVALS", least)
                for v, a, b in zip(units, batch._decode(parts, kind), alone, strict=True):
                    assert np.abs(a - v).max() <= near and (a == b).all()


def test_large_contexts_are_bounded():
    """Few contexts with many samples, of which the rest goes one by one."""
    rng = np.random.default_rng(1)
    v = np.clip(np.cumsum(rng.integers(-2, 3, (1, 90, 200)), axis=2) + 128, 0, 255).astype(np.int32)
    preset = scan.explicit_preset(Preset(), 8, 0)
    assert batch.encode_intervals([(v, batch.Kind(8, 1, 0, 0, preset))]) == [scan.encode(list(v), 8, 0, 0, preset)]


def test_stuffing_over_many_bytes():
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 9, 64, 333):
        bits = (rng.random(n) < 0.97).astype(np.uint8)
        w = scan.Writer()
        for b in bits.tolist():
            w.put(b, 1)
        assert batch._stuffed(np.packbits(bits).tobytes(), n) == w.end()


def test_damaged_files_give_the_same_errors(monkeypatch):
    monkeypatch.setattr(batch, "LEAST_INTERVALS", 2)
    rng = np.random.default_rng(9)
    good = [c.encode(picture(rng, (1, 16, 30), 8).astype(np.uint8).tobytes(), 30, 16, 8, 1, c.Options(restart_interval=4 * (i % 2), near=i % 3)) for i in range(30)]
    files = []
    for i in range(300):
        raw = bytearray(good[i % 30])
        for at in rng.integers(0, len(raw), i % 4).tolist():
            raw[at] = int(rng.integers(0, 256))
        files.append(bytes(raw[: len(raw) - (i % 7 == 6)]))

    def alone(data):
        try:
            return c.decode(data)[1]
        except StreamError as e:
            return e.code

    want = [alone(x) for x in files]
    got = [x.code if isinstance(x, StreamError) else x[1] for x in c.decode_many(files)]
    assert got == want and len({x for x in want if not isinstance(x, bytes)}) > 3
    assert c.decode_many([]) == []


def _peak(f):
    """What f gives, and the MB that were taken at most meanwhile."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_coding_does_not_grow_with_the_batch():
    rng = np.random.default_rng(5)
    data = [rng.integers(32, 127, 64 * 60, np.uint8).tobytes() for _ in range(500)]
    _, peak = _peak(lambda: c.encode_many([(x, 64, 60, 8, 1, c.Options(), 0) for x in data]))
    assert peak < 120


def test_bits_of_many_intervals_are_held_once():
    rng = np.random.default_rng(6)
    parts = [batch.Part(rng.integers(0, 128 if i % 2 else 256, 4000, np.uint8).tobytes(), 1, 1, batch.Kind(8, 1, 0, 0, Preset())) for i in range(500)]
    (window, first, end), peak = _peak(lambda: batch._windows(parts))
    for p, a, b in zip(parts, first.tolist(), end.tolist(), strict=True):
        bits = scan.bits_of(p.data)
        assert b - a == len(bits) and f"{int(window[a // 8]):064b}" == bits[:64]
    assert peak < 12 * 2  # MB, of 2 MB of data: eight bytes a byte, and the data twice


def test_many_runs_decode_like_one():
    """Runs of all lengths, to the end of their line or broken, in many intervals at once."""
    rng = np.random.default_rng(7)
    for near in (0, 2):
        preset = scan.explicit_preset(Preset(), 8, near)
        kind = batch.Kind(8, 1, 0, near, preset)
        units = [np.repeat(rng.integers(0, 256, (1, 5, 200)), rng.integers(1, 90), axis=2)[:, :, :200].astype(np.int32) for _ in range(100)]
        parts = [batch.Part(scan.encode(list(v), 8, 0, near, preset), 5, 200, kind) for v in units]
        for v, got in zip(units, batch._decode(parts, kind), strict=True):
            assert np.abs(got - v).max() <= near
        cut = [batch.Part(p.data[: len(p.data) // 2], 5, 200, kind) for p in parts]
        assert all(v is None for v in batch._decode(cut, kind))
