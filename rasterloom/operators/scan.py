"""The adaptive entropy coder of one scan. Sequential within a restart interval, so it runs in Python workers, one
image, scan or interval each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .errors import Code, StreamError

# Fixed values of the format: interleave modes, and the sizes of run blocks by run index
NONE, LINE, SAMPLE = 0, 1, 2
RUN_BITS = (0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 9, 10, 11, 12, 13, 14, 15)


@dataclass(frozen=True)
class Preset:
    """MAXVAL, thresholds and RESET; zero stands for the default."""

    maxval: int = 0
    t1: int = 0
    t2: int = 0
    t3: int = 0
    reset: int = 0


def default_preset(maxval: int, near: int) -> Preset:
    def inside(v: int, low: int) -> int:
        return low if v > maxval or v < low else v

    if maxval >= 128:
        f = (min(maxval, 4095) + 128) // 256
        raw = f + 2 + 3 * near, 4 * f + 3 + 5 * near, 17 * f + 4 + 7 * near
    else:
        f = 256 // (maxval + 1)
        raw = max(2, 3 // f + 3 * near), max(3, 7 // f + 5 * near), max(4, 21 // f + 7 * near)
    t1 = inside(raw[0], near + 1)
    t2 = inside(raw[1], t1)
    return Preset(maxval, t1, t2, inside(raw[2], t2), 64)


def explicit_preset(p: Preset, bits: int, near: int) -> Preset | None:
    """With defaults for zeros; None if it isn't valid."""
    most = (1 << bits) - 1
    if p.maxval and not 1 <= p.maxval <= most:
        return None
    maxval = p.maxval or most
    if near > min(255, maxval // 2):
        return None
    d = default_preset(maxval, near)
    out = Preset(maxval, p.t1 or d.t1, p.t2 or d.t2, p.t3 or d.t3, p.reset or d.reset)
    fine = near + 1 <= out.t1 <= maxval and out.t1 <= out.t2 <= maxval and out.t2 <= out.t3 <= maxval and 3 <= out.reset <= max(255, maxval)
    return out if fine else None


def is_default(p: Preset, bits: int, near: int) -> bool:
    if p == Preset():
        return True
    return p == default_preset(p.maxval or (1 << bits) - 1, near) and p.maxval == (1 << bits) - 1


@lru_cache(64)
def _gradients(bits: int, near: int, t1: int, t2: int, t3: int) -> list[int]:
    """The quantised gradient at index d; negative d count from the end."""
    most = (1 << bits) - 1
    d = np.concatenate((np.arange(0, most + 1), np.arange(-most - 1, 0)))
    a = np.abs(d)
    q = np.where(a <= near, 0, np.where(a < t1, 1, np.where(a < t2, 2, np.where(a < t3, 3, 4))))
    return (np.sign(d) * q).tolist()


class Writer:
    """Bits, most significant first; after a byte of ones the next one carries seven."""

    def __init__(self) -> None:
        self.out, self.held, self.count, self.room = bytearray(), 0, 0, 8

    def put(self, value: int, size: int) -> None:
        held, count, room, out = self.held << size | value, self.count + size, self.room, self.out
        while count >= room:
            count -= room
            byte = held >> count
            held &= (1 << count) - 1
            out.append(byte)
            room = 7 if byte == 255 else 8
        self.held, self.count, self.room = held, count, room

    def end(self) -> bytes:
        if self.count or self.room == 7:
            self.put(0, self.room - self.count)
        return bytes(self.out)


def marker_at(data: bytes, start: int) -> int:
    """Where the next marker stands: 0xFF and a byte from 0x80 on; -1 if there is none."""
    at = data.find(b"\xff", start)
    while 0 <= at < len(data) - 1:
        if data[at + 1] >= 0x80:
            return at
        at = data.find(b"\xff", at + 1)
    return -1


def bits_of(data: bytes) -> str:
    """The bits of an entropy-coded stretch as a text of 0 and 1, without stuffed ones."""
    raw = np.frombuffer(data, np.uint8)
    bits = np.unpackbits(raw)
    stuffed = np.flatnonzero(raw[:-1] == 255) + 1
    if len(stuffed):
        bits = np.delete(bits, stuffed * 8)
    return (bits + 48).tobytes().decode("ascii")


class _Coder:
    """Contexts, parameters and line buffers of a scan."""

    def __init__(self, width: int, bits: int, components: int, mode: int, near: int, preset: Preset) -> None:
        self.width, self.components, self.mode, self.near, self.reset = width, components, mode, near, preset.reset
        self.most = (1 << bits) - 1
        self.step = 2 * near + 1
        self.range = (self.most + 2 * near) // self.step + 1
        self.wide = max(0, (self.range - 1).bit_length())
        self.limit = 2 * (bits + max(8, bits))
        self.lut = _gradients(bits, near, preset.t1, preset.t2, preset.t3)
        self.start()

    def start(self) -> None:
        a = max(2, (self.range + 32) // 64)
        self.A, self.B, self.C, self.N = [a] * 365, [0] * 365, [0] * 365, [1] * 365
        self.restart_runs()
        self.prev = [[0] * (self.width + 2) for _ in range(self.components)]

    def restart_runs(self) -> None:
        a = max(2, (self.range + 32) // 64)
        self.RA, self.RN, self.RNn = [a, a], [1, 1], [0, 0]
        self.index = [0] * (self.components if self.mode == LINE else 1)

    def fold(self, e: int) -> int:
        """Error to a residual: divided by the step, then taken into the range."""
        if self.near:
            e = (e + self.near) // self.step if e > 0 else -((self.near - e) // self.step)
        if e < -(self.range // 2):
            e += self.range
        elif e > (self.range + 1) // 2 - 1:
            e -= self.range
        return e

    def rebuild(self, p: int, e: int) -> int:
        """The sample of a prediction and a residual."""
        if not self.near:
            return (p + e) & self.most
        v = p + e * self.step
        if v < -self.near:
            v += self.range * self.step
        elif v > self.most + self.near:
            v -= self.range * self.step
        return 0 if v < 0 else self.most if v > self.most else v

    def learn(self, q: int, e: int) -> None:
        A, B, C, N = self.A, self.B, self.C, self.N
        a, b, n = A[q] + (e if e >= 0 else -e), B[q] + e * self.step, N[q]
        if a >= 1 << 24 or b >= 1 << 24 or b <= -(1 << 24):
            raise StreamError(Code.INVALID_DATA, "context out of bounds")
        if n == self.reset:
            a, b, n = a >> 1, b >> 1, n >> 1
        n += 1
        if b + n <= 0:
            b += n
            if b <= -n:
                b = 1 - n
            if C[q] > -128:
                C[q] -= 1
        elif b > 0:
            b -= n
            if b > 0:
                b = 0
            if C[q] < 127:
                C[q] += 1
        A[q], B[q], N[q] = a, b, n

    def learn_run(self, kind: int, e: int, mapped: int) -> None:
        if e < 0:
            self.RNn[kind] += 1
        self.RA[kind] += (mapped + 1 - kind) >> 1
        if self.RN[kind] == self.reset & 255:
            self.RA[kind] >>= 1
            self.RN[kind] >>= 1
            self.RNn[kind] >>= 1
        self.RN[kind] += 1

    def golomb(self, kind: int) -> int:
        a, n = self.RA[kind] + (self.RN[kind] >> 1) * kind, self.RN[kind]
        k = 0
        while n << k < a:
            k += 1
        return k

    def map_run(self, kind: int, e: int) -> tuple[int, int]:
        """Code parameter and mapped value of the residual that breaks a run."""
        k, nn, n = self.golomb(kind), self.RNn[kind], self.RN[kind]
        bit = (k == 0 and e > 0 and 2 * nn < n) or (e < 0 and (2 * nn >= n or k != 0))
        return k, 2 * abs(e) - kind - bit

    def unmap_run(self, kind: int, k: int, mapped: int) -> int:
        t = mapped + kind
        bit = t & 1
        e = (t + bit) >> 1
        return -e if (k != 0 or 2 * self.RNn[kind] >= self.RN[kind]) == bool(bit) else e

    def context(self, prev: list[int], cur: list[int], i: int) -> int:
        b, c = prev[i], prev[i - 1]
        lut = self.lut
        return (lut[prev[i + 1] - b] * 9 + lut[b - c]) * 9 + lut[c - cur[i - 1]]

    def lines(self, code) -> None:
        """One line of each component: `code` gets the components that go together, their previous and current lines."""
        cur = [[p[1], *[0] * (self.width + 1)] for p in self.prev]
        for p in self.prev:
            p[self.width + 1] = p[self.width]
        if self.mode == SAMPLE:
            code(list(range(self.components)), self.prev, cur, 0)
        else:
            for c in range(self.components):
                code([c], self.prev, cur, c if self.mode == LINE else 0)
        self.prev = cur


def _predict(a: int, b: int, c: int) -> int:
    if a > b:
        return b if c >= a else a if c <= b else a + b - c
    return a if c >= b else b if c <= a else a + b - c


def encode(planes: Sequence[np.ndarray], bits: int, mode: int, near: int, preset: Preset) -> bytes:
    """Entropy-coded bytes of a scan; planes: a height x width array for each component, already transformed."""
    height, width = planes[0].shape
    s = _Coder(width, bits, len(planes), mode, near, preset)
    w = Writer()
    put, lut, most, limit, wide = w.put, s.lut, s.most, s.limit, s.wide
    lossless, half, upper, span = not near, s.range // 2, (s.range + 1) // 2 - 1, s.range

    def golomb(k: int, m: int, most_bits: int) -> None:
        h = m >> k
        if h < most_bits - wide - 1:
            put(1 << k | (m & ((1 << k) - 1)), h + 1 + k)
        else:
            put(1 << wide | (m - 1), most_bits)

    def regular(q: int, p: int, x: int) -> int:
        A, B, N = s.A, s.B, s.N
        if q < 0:
            q, sign = -q, -1
        else:
            sign = 1
        p += s.C[q] if sign > 0 else -s.C[q]
        p = 0 if p < 0 else most if p > most else p
        a, n, k = A[q], N[q], 0
        while n << k < a:
            k += 1
        e = x - p if sign > 0 else p - x
        if lossless:
            if e < -half:
                e += span
            elif e > upper:
                e -= span
        else:
            e = s.fold(e)
        f = e if k or near or 2 * B[q] + n - 1 >= 0 else ~e
        golomb(k, 2 * f if f >= 0 else -2 * f - 1, limit)
        s.learn(q, e)
        return s.rebuild(p, e if sign > 0 else -e)

    def interruption(kind: int, e: int, taken: int) -> None:
        k, m = s.map_run(kind, e)
        golomb(k, m, limit - taken - 1)
        s.learn_run(kind, e, m)

    rows = [p.tolist() for p in planes]
    for y in range(height):
        def line(group: list[int], prev: list[list[int]], cur: list[list[int]], ri: int, y: int = y) -> None:
            i = 1
            one = len(group) == 1
            source = [rows[c][y] for c in group]
            ps, cs = [prev[c] for c in group], [cur[c] for c in group]
            first_p, first_c, first_s = ps[0], cs[0], source[0]
            while i <= width:
                b, c, a = first_p[i], first_p[i - 1], first_c[i - 1]
                q = (lut[first_p[i + 1] - b] * 9 + lut[b - c]) * 9 + lut[c - a]
                if one:
                    if q:
                        first_c[i] = regular(q, _predict(a, b, c), first_s[i - 1])
                        i += 1
                        continue
                else:
                    qs = [q, *(s.context(ps[j], cs[j], i) for j in range(1, len(group)))]
                    if len(group) == 4:
                        used = [*qs[:3], qs[2]]
                    else:
                        used = qs
                    if any(qs[:3]) or (len(group) == 4 and qs[3]):
                        for j in range(len(group)):
                            cs[j][i] = regular(used[j], _predict(cs[j][i - 1], ps[j][i], ps[j][i - 1]), source[j][i - 1])
                        i += 1
                        continue
                ra = [x[i - 1] for x in cs]
                start = i
                while i <= width and all(abs(source[j][i - 1] - ra[j]) <= near for j in range(len(group))):
                    for j, x in enumerate(cs):
                        x[i] = ra[j]
                    i += 1
                n = i - start
                index = s.index[ri]
                while n >= 1 << RUN_BITS[index]:
                    put(1, 1)
                    n -= 1 << RUN_BITS[index]
                    index = min(31, index + 1)
                s.index[ri] = index
                if i > width:
                    if n:
                        put(1, 1)
                    break
                taken = RUN_BITS[index]
                put(n, taken + 1)
                for j in range(len(group)):
                    x, a, b = source[j][i - 1], ra[j], ps[j][i]
                    if one and abs(a - b) <= near:
                        e = s.fold(x - a)
                        interruption(1, e, taken)
                        cs[j][i] = s.rebuild(a, e)
                    else:
                        sign = -1 if b < a else 1
                        e = s.fold((x - b) * sign)
                        interruption(0, e, taken)
                        cs[j][i] = s.rebuild(b, e * sign)
                s.index[ri] = max(0, index - 1)
                i += 1

        s.lines(line)
    return w.end()


def decode_interval(bits: str, shape: tuple[int, int], depth: int, components: int, mode: int, near: int, preset: Preset, going: tuple | None = None) -> np.ndarray:
    """components x height x width samples of one restart interval, or of a scan without any.

    going: where another coder stopped: (line, bit, samples of the lines before, contexts, what runs know)
    """
    height, width = shape
    s = _Coder(width, depth, components, mode, near, preset)
    lut, most, limit, wide, find = s.lut, s.most, s.limit, s.wide, bits.find
    at = begin = 0
    out = np.empty((components, height, width), np.int32)
    if going:
        begin, at, before, (s.A, s.B, s.C, s.N), (s.RA, s.RN, s.RNn, s.index) = going
        out[:, :begin] = before[:, :begin]
        s.prev = [[int(p[begin - 2, 0]) if begin > 1 else 0, *p[begin - 1].tolist(), 0] for p in before]

    def golomb(k: int, most_bits: int) -> int:
        nonlocal at
        one = find("1", at)
        if one < 0:
            raise StreamError(Code.INVALID_DATA, "bits end within a code")
        h, at = one - at, one + 1
        if h < most_bits - wide - 1:
            if not k:
                return h
            begin, at = at, at + k
            if at > len(bits):
                raise StreamError(Code.INVALID_DATA, "bits end within a code")
            return h << k | int(bits[begin:at], 2)
        if h > most_bits - wide - 1 or at + wide > len(bits):
            raise StreamError(Code.INVALID_DATA, "code beyond its limit")
        begin, at = at, at + wide
        return int(bits[begin:at], 2) + 1

    def regular(q: int, p: int) -> int:
        if q < 0:
            q, sign = -q, -1
        else:
            sign = 1
        p += s.C[q] if sign > 0 else -s.C[q]
        p = 0 if p < 0 else most if p > most else p
        a, n, k = s.A[q], s.N[q], 0
        while n << k < a:
            k += 1
        if k > 16:
            raise StreamError(Code.INVALID_DATA, "code parameter out of bounds")
        m = golomb(k, limit)
        e = m >> 1 if not m & 1 else -((m + 1) >> 1)
        if e > 65535 or e < -65535:
            raise StreamError(Code.INVALID_DATA, "residual out of bounds")
        if not k and not near and 2 * s.B[q] + n - 1 < 0:
            e = ~e
        s.learn(q, e)
        return s.rebuild(p, e if sign > 0 else -e)

    def interruption(kind: int, taken: int) -> int:
        k = s.golomb(kind)
        m = golomb(k, limit - taken - 1)
        e = s.unmap_run(kind, k, m)
        s.learn_run(kind, e, m)
        return e

    def run(i: int, group: list[int], ps: list[list[int]], cs: list[list[int]], ri: int) -> int:
        """A run from place i on, and what breaks it; the place after."""
        nonlocal at
        one = len(group) == 1
        ra = [x[i - 1] for x in cs]
        index, n, left = s.index[ri], 0, width - i + 1
        while True:
            if at >= len(bits):
                raise StreamError(Code.INVALID_DATA, "bits end within a run")
            bit, at = bits[at], at + 1
            if bit == "0":
                break
            block = 1 << RUN_BITS[index]
            if block <= left - n:
                n += block
                index = min(31, index + 1)
            else:
                n = left
            if n == left:
                break
        if n < left:
            taken = RUN_BITS[index]
            if taken:
                n += int(bits[at : at + taken] or "0", 2)
                at += taken
            if n > left or at > len(bits):
                raise StreamError(Code.INVALID_DATA, "run beyond its line")
        s.index[ri] = index
        for j, x in enumerate(cs):
            x[i : i + n] = [ra[j]] * n
        i += n
        if i > width:
            if bit == "0":
                raise StreamError(Code.INVALID_DATA, "run beyond its line")
            return i
        taken = RUN_BITS[index]
        for j in range(len(group)):
            a, b = ra[j], ps[j][i]
            if one and abs(a - b) <= near:
                cs[j][i] = s.rebuild(a, interruption(1, taken))
            else:
                e = interruption(0, taken)
                cs[j][i] = s.rebuild(b, -e if b < a else e)
        s.index[ri] = max(0, index - 1)
        return i + 1

    A, B, C, N, reset, step, plain, size = s.A, s.B, s.C, s.N, s.reset, s.step, limit - wide - 1, len(bits)

    def single(group: list[int], prev: list[int], cur: list[int], ri: int) -> None:
        """A line of one component: what `regular` does, without a call for each sample."""
        nonlocal at
        i, here = 1, at
        a, b, c = cur[0], prev[1], prev[0]
        while i <= width:
            d = prev[i + 1]
            q = (lut[d - b] * 9 + lut[b - c]) * 9 + lut[c - a]
            if not q:
                at = here
                i = run(i, group, [prev], [cur], ri)
                if i <= width:
                    a, b, c = cur[i - 1], prev[i], prev[i - 1]
                here = at
                continue
            if a > b:
                p = b if c >= a else a if c <= b else a + b - c
            else:
                p = a if c >= b else b if c <= a else a + b - c
            back = q < 0
            if back:
                q = -q
                p -= C[q]
            else:
                p += C[q]
            p = 0 if p < 0 else most if p > most else p
            sum_a, n, k = A[q], N[q], 0
            reach = n
            while reach < sum_a:
                reach += reach
                k += 1
            first = find("1", here)
            if first - here < plain and 0 <= first and k <= 16:
                if k:
                    m, here = first - here, first + 1 + k
                    if here > size:
                        raise StreamError(Code.INVALID_DATA, "bits end within a code")
                    m = m << k | int(bits[first + 1 : here], 2)
                else:
                    m, here = first - here, first + 1
            elif k > 16:
                raise StreamError(Code.INVALID_DATA, "code parameter out of bounds")
            else:
                at = here
                m = golomb(k, limit)
                here = at
            e = -((m + 1) >> 1) if m & 1 else m >> 1
            if m > 131_070:
                raise StreamError(Code.INVALID_DATA, "residual out of bounds")
            sum_b = B[q]
            if not k and not near and 2 * sum_b + n - 1 < 0:
                e = ~e
            sum_a += e if e >= 0 else -e
            sum_b += e * step
            if sum_a >= 1 << 24 or sum_b >= 1 << 24 or sum_b <= -(1 << 24):
                raise StreamError(Code.INVALID_DATA, "context out of bounds")
            if n == reset:
                sum_a, sum_b, n = sum_a >> 1, sum_b >> 1, n >> 1
            n += 1
            if sum_b + n <= 0:
                sum_b += n
                if sum_b <= -n:
                    sum_b = 1 - n
                if C[q] > -128:
                    C[q] -= 1
            elif sum_b > 0:
                sum_b -= n
                if sum_b > 0:
                    sum_b = 0
                if C[q] < 127:
                    C[q] += 1
            A[q], B[q], N[q] = sum_a, sum_b, n
            if near:
                cur[i] = x = s.rebuild(p, -e if back else e)
            else:
                cur[i] = x = (p - e if back else p + e) & most
            a, c, b = x, b, d
            i += 1
        at = here

    def line(group: list[int], prev: list[list[int]], cur: list[list[int]], ri: int) -> None:
        if len(group) == 1:
            single(group, prev[group[0]], cur[group[0]], ri)
            return
        i = 1
        while i <= width:
            qs = [s.context(prev[j], cur[j], i) for j in group]
            if not any(qs):
                i = run(i, group, prev, cur, ri)
                continue
            if len(group) == 4:
                qs[3] = qs[2]  # the fourth component is coded in the third's context
            for q, p, x in zip(qs, prev, cur, strict=True):
                x[i] = regular(q, _predict(x[i - 1], p[i], p[i - 1]))
            i += 1

    for y in range(begin, height):
        s.lines(line)
        for c in range(components):
            out[c, y] = s.prev[c][1:-1]
    rest = bits[at:]
    if "1" in rest or len(rest) > 15:
        raise StreamError(Code.INVALID_DATA, "data after the last sample")
    return out


def decode(data: bytes, start: int, shape: tuple[int, int], depth: int, components: int, mode: int, near: int, preset: Preset, interval: int = 0) -> tuple[np.ndarray, int]:
    """(components x height x width samples, where the marker after the scan stands)"""
    height, width = shape
    step = min(interval or height, height)
    parts, at = [], start
    for number, y in enumerate(range(0, height, step)):
        if number:
            while at < len(data) and data[at] == 0xFF and at + 1 < len(data) and data[at + 1] == 0xFF:
                at += 1
            if data[at : at + 2] != bytes((0xFF, 0xD0 + (number - 1) % 8)):
                raise StreamError(Code.RESTART_NOT_FOUND)
            at += 2
        end = marker_at(data, at)
        if end < 0:
            raise StreamError(Code.NEED_MORE_DATA if not data[at:] else Code.INVALID_DATA, "no marker after the scan")
        parts.append(decode_interval(bits_of(data[at:end]), (min(step, height - y), width), depth, components, mode, near, preset))
        at = end
    return np.concatenate(parts, axis=1), at
