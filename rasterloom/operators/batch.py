"""The entropy coder over many restart intervals at once, with the bits and samples of `scan`, which takes one at a time.

Coding without loss, all that depends on source samples alone (contexts, predictions, runs) is computed for whole images;
a context's counters depend on its own samples only, so those of all contexts go forward together. Decoding, all
intervals go forward together by one sample a step. What a few long intervals or contexts have left is done one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import scan
from .errors import Code, StreamError
from .scan import LINE, RUN_BITS, SAMPLE, Preset

#: Fewer contexts, or intervals, than these are quicker one by one.
LEAST_CONTEXTS, LEAST_INTERVALS = 48, 72
#: Samples that are coded, and decoded, at a time: some 200 and 20 bytes of memory each. Workers keep what they once took.
MOST_CODED, MOST_DECODED = 1 << 18, 1 << 23
_CONTEXTS = 365
_BOUND = 1 << 24
#: Fewer runs than these are quicker one by one.
_LEAST_RUNS = 16
_PAD = bytes(16)
_RUN_BITS = np.array(RUN_BITS, np.int64)


@dataclass(frozen=True)
class Kind:
    """What intervals that are coded together have in common."""

    bits: int
    components: int
    mode: int
    near: int
    preset: Preset


def _lut(kind: Kind) -> np.ndarray:
    return np.array(scan._gradients(kind.bits, kind.near, kind.preset.t1, kind.preset.t2, kind.preset.t3), np.int32)


# Encoding


def encode_intervals(units: list[tuple[np.ndarray, Kind]]) -> list[bytes]:
    """Entropy-coded bytes of each unit: components x height x width samples, coded without loss."""
    out: list[bytes] = [b""] * len(units)
    groups: dict[tuple[Kind, int], list[int]] = {}
    for i, (planes, kind) in enumerate(units):
        if kind.near:
            raise ValueError("only coding without loss is done for many at once")
        groups.setdefault((kind, planes.shape[2]), []).append(i)
    for (kind, _), members in groups.items():
        held: list[int] = []
        size = 0
        for i in members:
            held.append(i)
            size += units[i][0].size
            if size >= MOST_CODED or i == members[-1]:
                for j, data in zip(held, _encode([units[j][0] for j in held], kind), strict=True):
                    out[j] = data
                held, size = [], 0
    return out


def _encode(planes: list[np.ndarray], kind: Kind) -> list[bytes]:
    n, width = planes[0].shape[0], planes[0].shape[2]
    most = (1 << kind.bits) - 1
    x = np.concatenate(planes, axis=1).astype(np.int32)
    heights = np.fromiter((p.shape[1] for p in planes), np.int64, len(planes))
    first = np.cumsum(heights) - heights
    b = np.zeros_like(x)
    b[:, 1:] = x[:, :-1]
    b[:, first] = 0
    edge = np.zeros(x.shape[:2], np.int32)
    edge[:, 1:] = b[:, :-1, 0]
    edge[:, first] = 0
    a = np.concatenate((b[:, :, :1], x[:, :, :-1]), axis=2)
    c = np.concatenate((edge[:, :, None], b[:, :, :-1]), axis=2)
    d = np.concatenate((b[:, :, 1:], b[:, :, -1:]), axis=2)
    lut = _lut(kind)
    q = (lut[d - b] * 9 + lut[b - c]) * 9 + lut[c - a]
    med = np.clip(a + b - c, np.minimum(a, b), np.maximum(a, b))
    unit = np.repeat(np.arange(len(planes)), heights)
    if kind.mode == SAMPLE:
        x, a, b, q, med = (v.reshape(n, -1) for v in (x, a, b, q, med))
    else:  # lines of the components in turn
        x, a, b, q, med = (v.transpose(1, 0, 2).reshape(1, -1) for v in (x, a, b, q, med))
        unit = np.repeat(unit, n)
    start, end = _runs((q == 0).all(axis=0), (x == a).all(axis=0), width)
    open_end = end % width != 0  # else the run goes to the end of its line; an open run's last pixel is an interruption
    open_end |= end == start  # a run of nothing is broken at once
    size = x.shape[1]
    taken = np.cumsum(np.bincount(start, minlength=size + 1) - np.bincount(end + open_end, minlength=size + 1))[:size] > 0
    pixel = np.flatnonzero(~taken)
    if len(x) == 4:
        q[3] = q[2]  # the fourth component is coded in the third's context
    own_q, own_med, own_x = (v[:, pixel].T.ravel() for v in (q, med, x))
    back = own_q < 0
    own_med, own_x = np.where(back, most - own_med, own_med), np.where(back, most - own_x, own_x)
    owner = np.repeat(unit[pixel // width], len(x))
    coder = scan._Coder(1, kind.bits, n, kind.mode, 0, kind.preset)
    e, k, fix = _contexts(np.abs(own_q), owner, own_med, own_x, coder)
    mapped = np.where(fix, ~e, e)
    mapped = (mapped << 1) ^ (mapped >> 31)
    high = mapped >> k
    plain = high < coder.limit - coder.wide - 1
    value = np.where(plain, (1 << k) | (mapped & ((1 << k) - 1)), (1 << coder.wide) | (mapped - 1)).astype(np.int64)
    length = np.where(plain, high + 1 + k, coder.limit).astype(np.int64)
    if len(start):
        at = (np.repeat(pixel * 8, len(x)).reshape(-1, len(x)) + np.arange(1, len(x) + 1)).ravel()
        more = _run_codes(start, end, open_end, x, a, b, unit[start // width], width, coder)
        at, value, length = (np.concatenate(p) for p in zip((at, value, length), more, strict=True))
        order = np.argsort(at, kind="stable")
        value, length, owner = value[order], length[order], unit[at[order] // 8 // width]
    return _packed(value, length, owner, len(planes))


def _runs(flat: np.ndarray, same: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First pixels of all runs, and the pixel that breaks each, or the end of its line."""
    candidates = np.flatnonzero(flat)
    if not len(candidates):
        return candidates, candidates
    index = np.arange(len(same)).reshape(-1, width)
    stop = np.where(same.reshape(-1, width), index[:, :1] + width, index)
    stop = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1].ravel()[candidates]
    after = np.searchsorted(candidates, stop + (stop < candidates // width * width + width)).tolist()
    chosen, at = [], 0
    while at < len(after):
        chosen.append(at)
        at = after[at]
    return candidates[chosen], stop[chosen]


def _run_codes(start: np.ndarray, end: np.ndarray, open_end: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, unit: np.ndarray, width: int, s: scan._Coder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, value, length) of the codes of runs and of what breaks them."""
    codes: list[tuple[int, int, int]] = []
    n, single = len(x), len(x) == 1
    slots = s.components if s.mode == LINE else 1
    broken = np.where(open_end, end, 0)
    xs, la, lb = (v[:, broken].T.tolist() for v in (x, a, b))
    last = -1
    for i, (at, to, is_open, own) in enumerate(zip(start.tolist(), end.tolist(), open_end.tolist(), unit.tolist(), strict=True)):
        if own != last:
            s.restart_runs()
            last = own
        slot = at // width % slots  # intervals begin at a multiple of the components' number of lines
        index, left, ones = s.index[slot], to - at, 0
        while left >= 1 << RUN_BITS[index]:
            left -= 1 << RUN_BITS[index]
            ones += 1
            index = min(31, index + 1)
        if not is_open and left:
            ones += 1
        while ones:
            part = min(ones, 16)
            codes.append((at * 8, (1 << part) - 1, part))
            ones -= part
        s.index[slot] = index
        if not is_open:
            continue
        held = RUN_BITS[index]
        codes.append((at * 8, left, held + 1))
        for j in range(n):
            v, ra, rb = xs[i][j], la[i][j], lb[i][j]
            if single and ra == rb:
                kind, e = 1, s.fold(v - ra)
            else:
                kind, e = 0, s.fold(rb - v if rb < ra else v - rb)
            k, m = s.map_run(kind, e)
            h = m >> k
            if h < s.limit - held - 1 - s.wide - 1:
                codes.append((to * 8 + 1 + j, 1 << k | (m & ((1 << k) - 1)), h + 1 + k))
            else:
                codes.append((to * 8 + 1 + j, 1 << s.wide | (m - 1), s.limit - held - 1))
            s.learn_run(kind, e, m)
        s.index[slot] = max(0, index - 1)
    got = np.array(codes, np.int64).reshape(-1, 3)
    return got[:, 0], got[:, 1], got[:, 2]


def _stable(keys: np.ndarray, most: int) -> np.ndarray:
    return np.argsort(keys.astype(np.uint16) if most < 1 << 16 else keys, kind="stable")


def _contexts(q: np.ndarray, unit: np.ndarray, med: np.ndarray, x: np.ndarray, s: scan._Coder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(residual, code parameter, whether the residual is turned) of each sample, in order; q, unit: its context."""
    n = len(q)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
    order = _stable(q, _CONTEXTS)
    if unit[-1]:
        order = order[_stable(unit[order], int(unit[-1]) + 1)]
    key = unit[order] * _CONTEXTS + q[order]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(begin, n))
    by_size = np.argsort(-count, kind="stable")
    rank = np.empty(len(count), np.int64)
    rank[by_size] = np.arange(len(count))
    turn = np.arange(n) - np.repeat(begin, count)
    active = np.bincount(turn)
    offset = np.cumsum(active) - active
    place = offset[turn] + np.repeat(rank, count)
    steps = int(np.searchsorted(-active, -LEAST_CONTEXTS, "right"))
    done = int(offset[steps]) if steps < len(active) else n
    med, x = med[order], x[order]
    early = place < done
    m2, x2 = np.empty(done, np.int32), np.empty(done, np.int32)
    m2[place[early]], x2[place[early]] = med[early], x[early]
    e2, a2, b2 = (np.empty(done, np.int32) for _ in range(3))
    most, half, reset = s.most, s.range // 2, s.reset
    first_a = max(2, (s.range + 32) // 64)
    a, b, c = np.full(len(count), first_a, np.int32), np.zeros(len(count), np.int32), np.zeros(len(count), np.int32)
    ns, n_now = np.empty(len(active), np.int32), 1
    for t in range(len(active)):
        ns[t] = n_now
        n_now = (n_now >> 1 if n_now == reset else n_now) + 1
    for t in range(steps):
        g, o = int(active[t]), int(offset[t])
        at = slice(o, o + g)
        a, b, c, n_now = a[:g], b[:g], c[:g], int(ns[t])
        a2[at], b2[at] = a, b
        p = m2[at] + c
        np.minimum(p, most, out=p)
        np.maximum(p, 0, out=p)
        e = e2[at]
        np.subtract(x2[at], p, out=e)
        e += half
        e &= most
        e -= half
        a += np.abs(e)
        b += e
        if n_now == reset:
            a >>= 1
            b >>= 1
            n_now >>= 1
        n_now += 1
        turned = (b > 0).view(np.int8) - (b <= -n_now).view(np.int8)
        b -= turned * np.int32(n_now)
        np.maximum(b, 1 - n_now, out=b)
        np.minimum(b, 0, out=b)
        c += turned
        np.maximum(c, -128, out=c)
        np.minimum(c, 127, out=c)
    es, As, Bs = (np.empty(n, np.int32) for _ in range(3))
    es[early], As[early], Bs[early] = e2[place[early]], a2[place[early]], b2[place[early]]
    for r in range(int(active[steps]) if steps < len(active) else 0):
        g = int(by_size[r])
        at = slice(int(begin[g]) + steps, int(begin[g] + count[g]))
        es[at], As[at], Bs[at] = _one_context(med[at].tolist(), x[at].tolist(), (int(a[r]), int(b[r]), int(c[r]), int(ns[steps])), most, reset)
    if (As + np.abs(es)).max() >= _BOUND or np.abs(Bs + es).max() >= _BOUND:
        raise StreamError(Code.INVALID_DATA, "context out of bounds")
    now = ns[turn]
    k = _parameter(As, now)
    out = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n, bool)
    out[0][order], out[1][order], out[2][order] = es, k, (k == 0) & (2 * Bs + now - 1 < 0)
    return out


def _parameter(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The least k with n << k >= a: the exponent of a / n, one more unless it is a power of two."""
    ratio = (a / n).view(np.int64)
    return np.maximum(((ratio + ((1 << 52) - 1)) >> 52) - 1023, 0).astype(np.int32)


def _one_context(med: list[int], x: list[int], state: tuple[int, int, int, int], most: int, reset: int) -> tuple[list[int], list[int], list[int]]:
    """(residuals, A, B) of the samples of one context, before each is learned."""
    a, b, c, n = state
    half = (most + 1) >> 1
    es, As, Bs = [], [], []
    for m, v in zip(med, x, strict=True):
        p = m + c
        if p < 0:
            p = 0
        elif p > most:
            p = most
        e = ((v - p + half) & most) - half
        es.append(e)
        As.append(a)
        Bs.append(b)
        a += e if e >= 0 else -e
        b += e
        if n == reset:
            a >>= 1
            b >>= 1
            n >>= 1
        n += 1
        if b + n <= 0:
            b += n
            if b <= -n:
                b = 1 - n
            if c > -128:
                c -= 1
        elif b > 0:
            b -= n
            if b > 0:
                b = 0
            if c < 127:
                c += 1
    return es, As, Bs


def _packed(value: np.ndarray, length: np.ndarray, unit: np.ndarray, units: int) -> list[bytes]:
    """Bytes of each unit's codes: `length` bits each, zeros before the value's own."""
    total = np.bincount(unit, length, units).astype(np.int64)
    size = (total + 7) // 8
    first = np.cumsum(size) - size
    end = np.cumsum(length) + (first * 8 - (np.cumsum(total) - total))[unit]
    shift = -end & 7
    value = value << shift
    last = (end + shift) // 8 - 1
    room = int(size.sum())
    flat = np.zeros(room, np.int64)
    while len(value):
        flat += np.bincount(last, value & 255, room).astype(np.int64) if room else 0
        more = value > 255
        value, last = value[more] >> 8, last[more] - 1
    data = flat.astype(np.uint8).tobytes()
    return [_stuffed(data[f : f + n], t) for f, n, t in zip(first.tolist(), size.tolist(), total.tolist(), strict=True)]


def _stuffed(raw: bytes, bits: int) -> bytes:
    """A zero bit after each byte of ones. What follows is the same bits, moved by as many places."""
    if raw.find(b"\xff") < 0:
        return raw
    base = np.frombuffer(raw + b"\0\0", np.uint8)
    moved: list[bytes | None] = [base.tobytes(), *[None] * 7]
    out, at, stuffed = bytearray(), 0, 0
    while True:
        v, q = stuffed & 7, stuffed >> 3
        if moved[v] is None:
            shifted = base >> v
            shifted[1:] |= base[:-1] << (8 - v)
            moved[v] = shifted.tobytes()
        now, to = moved[v], (bits + stuffed + 7) // 8
        if stuffed:
            out.append(now[at - q] & 0x7F)
            at += 1
        found = now.find(b"\xff", at - q, to - q)
        if found < 0:
            return bytes(out + now[at - q : to - q])
        out += now[at - q : found + 1]
        at = found + 1 + q
        stuffed += 1


# Decoding


@dataclass
class Part:
    """One restart interval to decode."""

    data: bytes
    height: int
    width: int
    kind: Kind


def decode_intervals(parts: list[Part], strict: bool = True) -> list[np.ndarray | None]:
    """components x height x width samples of each part. The first bad part raises its error; or, if not strict, is None."""
    out: list[np.ndarray | None] = [None] * len(parts)
    groups: dict[Kind, list[int]] = {}
    for i, p in enumerate(parts):
        groups.setdefault(p.kind, []).append(i)
    for kind, members in groups.items():
        members.sort(key=lambda i: parts[i].height * parts[i].width)  # those of like size go together
        held: list[int] = []
        size = 0
        for i in members:
            held.append(i)
            size += parts[i].height * parts[i].width * kind.components
            if size >= MOST_DECODED or i == members[-1]:
                if len(held) >= LEAST_INTERVALS:
                    for j, v in zip(held, _decode([parts[j] for j in held], kind), strict=True):
                        out[j] = v
                held, size = [], 0
    for i, p in enumerate(parts):
        if out[i] is None:
            k = p.kind
            try:
                out[i] = scan.decode_interval(scan.bits_of(p.data), (p.height, p.width), k.bits, k.components, k.mode, k.near, k.preset)
            except StreamError:
                if strict:
                    raise
    return out


def _windows(parts: list[Part]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64 bits from each byte on of all parts' bits, without stuffed ones; first and last bit of each part."""
    raw = []
    size, room = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for i, p in enumerate(parts):
        data, bits = p.data, 8 * len(p.data)
        if data.find(b"\xff", 0, len(data) - 1) >= 0:
            v = np.frombuffer(data, np.uint8)
            stuffed = np.flatnonzero(v[:-1] == 255) + 1
            bits -= len(stuffed)
            data = np.packbits(np.delete(np.unpackbits(v), stuffed * 8)).tobytes()
        size[i], room[i] = bits, len(data) + 16
        raw += [data, _PAD]
    every = b"".join([*raw, _PAD])
    first = (np.cumsum(room) - room) * 8
    return np.ndarray((len(every) - 8,), ">u8", every, 0, (1,)).astype(np.uint64), first, first + size


def _decode(parts: list[Part], kind: Kind) -> list[np.ndarray | None]:
    """None where something is wrong: the coder of one interval then says what."""
    u64 = np.uint64
    n, near, single = kind.components, kind.near, kind.mode != SAMPLE
    window, first_bit, end_bit = _windows(parts)
    final = len(window) - 1
    heights, widths = (np.fromiter((getattr(p, k) for p in parts), np.int64, len(parts)) for k in ("height", "width"))
    turns = n if kind.mode == LINE else 1  # lines of the components in turn
    lines = (heights + 2) * turns
    plane = lines * (widths + 2)
    area = plane * (1 if single else n)
    base = np.cumsum(area) - area
    buf = np.zeros(int(area.sum()), np.int32)
    coders = scan._Coder(1, kind.bits, n, kind.mode, near, kind.preset)
    most, limit, wide, reset, step, span = coders.most, coders.limit, coders.wide, coders.reset, coders.step, coders.range
    escape = limit - wide - 1
    lut = _lut(kind)
    first_a = coders.A[0]
    lut81, lut9 = lut * 81, lut * 9
    state = np.tile(np.array([first_a, 0, 0, 1], np.int32), len(parts) * _CONTEXTS).view(np.dtype((np.void, 16)))  # A, B, C, N
    # Where residuals within the range can't take a context out of bounds, k may come from a table of all A and N
    tame = reset * span < _BOUND
    a_bits = (reset * span).bit_length()
    parameters = None
    if tame and a_bits <= 15 and reset <= 64:
        parameters = _parameter(np.tile(np.arange(1 << a_bits), reset + 1), np.repeat(np.maximum(np.arange(reset + 1), 1), 1 << a_bits))
    run_a, run_n, run_nn = np.full((len(parts), 2), first_a, np.int64), np.ones((len(parts), 2), np.int64), np.zeros((len(parts), 2), np.int64)
    run_index = np.zeros((len(parts), turns), np.int64)
    out: list[np.ndarray | None] = [None] * len(parts)
    # of the intervals that go on: number, place of the next sample, samples left of its line, lines left, next bit
    who = np.arange(len(parts))
    up_all = (widths + 2) * turns
    at = base + up_all + 1
    left, rows, bit = widths.copy(), heights * turns, first_bit.copy()
    up, wid, ctx, skip = up_all.copy(), widths.copy(), who * _CONTEXTS, plane.copy()
    planes = range(1) if single else range(n)

    def view(j: int) -> np.ndarray:
        own = buf[base[j] : base[j] + area[j]]
        if single:
            own = own.reshape(heights[j] + 2, turns, widths[j] + 2).transpose(1, 0, 2)
        else:
            own = own.reshape(n, heights[j] + 2, widths[j] + 2)
        return own[:, 1:-1, 1:-1]

    def bits_at(p: int, size: int) -> int:
        return (int(window[min(p >> 3, final)]) << (p & 7) & 0xFFFFFFFFFFFFFFFF) >> (64 - size) if size else 0

    def run(i: int) -> bool:
        """Decode a run and what breaks it."""
        p, w, pl = int(at[i]), int(who[i]), int(skip[i])
        s.RA, s.RN, s.RNn = run_a[w].tolist(), run_n[w].tolist(), run_nn[w].tolist()
        slot = (int(heights[w]) * turns - int(rows[i])) % turns
        index, room, to, count, end = int(run_index[w, slot]), int(left[i]), int(bit[i]), 0, int(end_bit[w])
        broken = False
        while count < room:
            if to >= end:
                return False
            to += 1
            if not bits_at(to - 1, 1):
                broken = True
                break
            block = 1 << RUN_BITS[index]
            if block <= room - count:
                count += block
                index = min(31, index + 1)
            else:
                count = room
        held = RUN_BITS[index]
        if broken:
            count += bits_at(to, held)
            to += held
            if count >= room or to > end:
                return False
        for j in planes:
            buf[p + j * pl : p + j * pl + count] = buf[p + j * pl - 1]
        if broken:
            for j in planes:
                x = p + j * pl + count
                ra, rb = int(buf[x - 1]), int(buf[x - up[i]])
                kind_ = int(single and abs(ra - rb) <= near)
                k, most_bits = s.golomb(kind_), limit - held - 1
                high = 0
                while high < most_bits - wide and to < end and not bits_at(to, 1):
                    to += 1
                    high += 1
                to += 1
                if high < most_bits - wide - 1:
                    m = high << k | bits_at(to, k)
                    to += k
                elif high == most_bits - wide - 1:
                    m = bits_at(to, wide) + 1
                    to += wide
                else:
                    return False
                if to > end or k > 16:
                    return False
                e = s.unmap_run(kind_, k, m)
                s.learn_run(kind_, e, m)
                buf[x] = s.rebuild(ra, e) if kind_ else s.rebuild(rb, -e if rb < ra else e)
            count += 1
            index = max(0, index - 1)
            run_a[w], run_n[w], run_nn[w] = s.RA, s.RN, s.RNn
        run_index[w, slot] = index
        at[i], left[i], bit[i] = p + count, room - count, to
        return True

    def many_bits(p: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        w = window.take(p >> 3, mode="clip") << (p & 7).view(u64)
        return ((w >> u64(1)) >> np.asarray(63 - size).astype(u64)).view(np.int64)

    def many_runs(i: np.ndarray) -> list[int]:
        """What `run` does, for many at once; those that are wrong."""
        p, w, room, to, pl = at[i], who[i], left[i], bit[i], skip[i]
        end, slot = end_bit[w], (heights[w] * turns - rows[i]) % turns
        index, count = run_index[w, slot], np.zeros(len(i), np.int64)
        bad, broken = np.zeros(len(i), bool), np.zeros(len(i), bool)
        on = np.arange(len(i))
        while len(on):
            over = to[on] >= end[on]
            bad[on[over]] = True
            on = on[~over]
            ones = many_bits(to[on], 1) > 0
            to[on] += 1
            broken[on[~ones]] = True
            on = on[ones]
            block, rest = 1 << _RUN_BITS[index[on]], room[on] - count[on]
            count[on] += np.minimum(block, rest)
            index[on] = np.minimum(index[on] + (block <= rest), 31)
            on = on[count[on] < room[on]]
        held = np.where(broken, _RUN_BITS[index], 0)
        count += many_bits(to, held) * (held > 0)
        to += held
        bad |= broken & ((count >= room) | (to > end))
        filled = np.flatnonzero(~bad & (count > 0))
        if len(filled):
            n_filled = count[filled]
            place = np.repeat(p[filled] - np.cumsum(n_filled) + n_filled, n_filled) + np.arange(n_filled.sum())
            for j in planes:
                own = j * pl[filled]
                buf[place + np.repeat(own, n_filled)] = np.repeat(buf[p[filled] + own - 1], n_filled)
        g = np.flatnonzero(broken & ~bad)
        wg, to_g, end_g = w[g], to[g], end[g]
        wrong = np.zeros(len(g), bool)
        escape_g = limit - held[g] - 2 - wide
        for j in planes if len(g) else ():
            x = p[g] + j * pl[g] + count[g]
            ra, rb = buf[x - 1].astype(np.int64), buf[x - up[i[g]]].astype(np.int64)
            kind_ = (np.abs(ra - rb) <= near).astype(np.int64) if single else np.zeros(len(g), np.int64)
            ka, kn, knn = run_a[wg, kind_], run_n[wg, kind_], run_nn[wg, kind_]
            k = _parameter(ka + (kn >> 1) * kind_, kn).astype(np.int64)
            wrong |= k > 16
            k = np.minimum(k, 16)
            v = window.take(to_g >> 3, mode="clip") << (to_g & 7).view(u64)
            high = np.minimum(np.minimum(1075 - ((v >> u64(11)).astype(np.float64).view(np.int64) >> 52), escape_g + 1), np.maximum(end_g - to_g, 0))
            to_g += high + 1
            coded = high == escape_g
            size = np.where(coded, np.int64(wide), k)
            got = many_bits(to_g, size) * (size > 0)
            m = np.where(coded, got + 1, (high << k) + got)
            to_g += size
            wrong |= (high > escape_g) | (to_g > end_g)
            t = m + kind_
            e = (t + 1) >> 1
            e = np.where(((k != 0) | (2 * knn >= kn)) == (t & 1 > 0), -e, e)
            knn += e < 0
            ka += (m + 1 - kind_) >> 1
            halve = kn == reset & 255
            ka >>= halve
            kn >>= halve
            knn >>= halve
            kn += 1
            run_a[wg, kind_], run_n[wg, kind_], run_nn[wg, kind_] = ka, kn, knn
            v = np.where(kind_ > 0, ra, rb) + np.where((kind_ == 0) & (rb < ra), -e, e) * step
            if near:
                v += ((v < -near).astype(np.int64) - (v > most + near)) * (span * step)
                v = np.clip(v, 0, most)
            else:
                v &= most
            buf[x] = v
        count[g] += 1
        index[g] = np.maximum(index[g] - 1, 0)
        to[g] = to_g
        bad[g[wrong]] = True
        fine = ~bad
        i_fine = i[fine]
        run_index[w[fine], slot[fine]] = index[fine]
        at[i_fine], left[i_fine], bit[i_fine] = p[fine] + count[fine], room[fine] - count[fine], to[fine]
        return i[bad].tolist()

    s = coders
    stopping = False
    while len(who):
        near_by = []
        flat = None
        for j in planes:
            p = at + j * skip if j else at
            over = p - up
            a, b, c = buf.take(p - 1), buf.take(over), buf.take(over - 1)
            q = lut81.take(buf.take(over + 1) - b, mode="wrap")
            q += lut9.take(b - c, mode="wrap")
            q += lut.take(c - a, mode="wrap")
            near_by.append((p, a, b, c, q))
            flat = q == 0 if flat is None else flat & (q == 0)
        runs_now = np.flatnonzero(flat)
        # A single component never uses context 0 otherwise, so what those in a run do there is undone by the run itself.
        chosen = np.flatnonzero(~flat) if len(runs_now) and not single else None
        now, offset = (bit, ctx) if chosen is None else (bit[chosen], ctx[chosen])
        wrong = None
        for j in planes if len(now) else ():
            p, a, b, c, q = near_by[j] if chosen is None else [v[chosen] for v in near_by[j]]
            if j == 3:
                q = third
            elif j == 2:
                third = q
            sign = q >> 31 | 1
            key = offset + np.abs(q)
            held = state.take(key)
            ca, cb, cc, cn = held.view(np.int32).reshape(-1, 4).T
            pred = a + b
            pred -= c
            np.maximum(pred, np.minimum(a, b), out=pred)
            np.minimum(pred, np.maximum(a, b), out=pred)
            pred += cc * sign
            np.maximum(pred, 0, out=pred)
            np.minimum(pred, most, out=pred)
            k = parameters.take((cn << a_bits) + ca, mode="clip") if parameters is not None else _parameter(ca, cn)
            w = window.take(now >> 3, mode="clip") << (now & 7).view(u64)
            zeros = 1075 - ((w >> u64(11)).astype(np.float64).view(np.int64) >> 52)
            skipped = zeros + 1
            coded = zeros >= escape
            any_coded = coded.any()
            size = np.where(coded, np.int64(wide), k) if any_coded else k.astype(np.int64)
            if limit <= 56:  # all of a code is in the window
                w <<= skipped.view(u64)
                now = now + (skipped + size)
            else:
                now = now + skipped
                w = window.take(now >> 3, mode="clip") << (now & 7).view(u64)
                now += size
            m = ((w >> u64(1)) >> (63 - size).view(u64)).view(np.int64)
            if any_coded:
                m = np.where(coded, m + 1, (np.minimum(zeros, 64) << k) + m)
            else:
                m += zeros << size
            m = m.astype(np.int32)
            e = (m >> 1) ^ -(m & 1)
            if not near:
                e ^= ((k == 0) & (2 * cb + cn < 1)).view(np.int8) * np.int8(-1)
            if near:
                x = pred + e * sign * step
                x += ((x < -near).astype(np.int32) - (x > most + near)) * (span * step)
                np.maximum(x, 0, out=x)
                np.minimum(x, most, out=x)
            else:
                x = e * sign
                x += pred
                x &= most
            buf[p] = x
            size_e = np.abs(e)
            ca += size_e
            cb += e * step if near else e
            if any_coded or not tame or m.max() > span + 1:
                # Residuals beyond the range are left to the other coder; others can't take a tame context out of bounds
                odd = (zeros > escape) | ((m > span + 1) if tame else (k > 16) | (size_e > 65535) | (np.maximum(ca, np.abs(cb)) >= _BOUND))
                wrong = odd if wrong is None else wrong | odd
            halve = cn == reset
            if halve.any():
                ca >>= halve
                cb >>= halve
                cn >>= halve
            cn += 1
            turned = (cb > 0).view(np.int8) - (cb <= -cn).view(np.int8)
            cb -= turned * cn
            np.maximum(cb, 1 - cn, out=cb)
            np.minimum(cb, 0, out=cb)
            cc += turned
            np.maximum(cc, -128, out=cc)
            np.minimum(cc, 127, out=cc)
            state[key] = held
        bad: list[int] = []
        if chosen is None:
            if wrong is not None:
                bad = np.flatnonzero(wrong & ~flat).tolist()
            if len(runs_now):
                kept = bit[runs_now]
                bit = now
                bit[runs_now] = kept
                step_on = (~flat).astype(np.int64)
                at += step_on
                left -= step_on
            else:
                bit = now
                at += 1
                left -= 1
        elif len(now):
            bit[chosen] = now
            at[chosen] += 1
            left[chosen] -= 1
            bad = chosen[wrong].tolist() if wrong is not None else []
        bad += many_runs(runs_now) if len(runs_now) >= _LEAST_RUNS else [i for i in runs_now.tolist() if not run(i)]
        i = np.flatnonzero(left == 0)
        if not len(i) and not bad:
            continue
        over = np.zeros(len(who), bool)
        over[bad] = True
        if len(i):
            for j in planes:
                p = at[i] + j * skip[i]
                buf[p] = buf[p - 1]
                head = p - wid[i]
                buf[head - 1 + up[i]] = buf[head]
            at[i] += 2
            rows[i] -= 1
            left[i] = wid[i]
            full = i[(rows[i] == 0) & ~over[i]]
            if len(full):
                spare = end_bit[who[full]] - bit[full]
                fine = (spare >= 0) & (spare <= 15) & ((window[np.minimum(bit[full] >> 3, final)] << (bit[full] & 7).astype(u64)) >> u64(49) == 0)
                for j in who[full[fine]].tolist():
                    out[j] = view(j)
            over |= rows == 0
            if stopping:
                park = i[(rows[i] % turns == 0) & ~over[i]]
                for x in park.tolist():
                    j = int(who[x])
                    y = int(heights[j]) - int(rows[x]) // turns
                    out[j] = _rest(parts[j], y, int(bit[x] - first_bit[j]), view(j), state[j * _CONTEXTS : (j + 1) * _CONTEXTS].view(np.int32).reshape(-1, 4).T.tolist(), [v[j].tolist() for v in (run_a, run_n, run_nn, run_index)])
                over[park] = True
        if over.any():
            keep = ~over
            who, at, left, rows, bit, up, wid, ctx, skip = (v[keep] for v in (who, at, left, rows, bit, up, wid, ctx, skip))
            stopping = len(who) < LEAST_INTERVALS
    return out


def _rest(part: Part, y: int, at: int, done: np.ndarray, contexts: list[list[int]], runs: list[list[int]]) -> np.ndarray | None:
    """The lines of an interval from y on, one by one."""
    k = part.kind
    try:
        return scan.decode_interval(scan.bits_of(part.data), (part.height, part.width), k.bits, k.components, k.mode, k.near, k.preset, (y, at, done, contexts, runs))
    except StreamError:
        return None
