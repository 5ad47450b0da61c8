"""The codec's arithmetic as Column expressions on integers. All stay in whole-stage code; none wraps around, so they
hold under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _div(a, b) -> Column:
    """Integer division toward zero, as an int."""
    a, b = _c(a), _c(b)
    return ((a - a % b) / b).cast("int")


def shl(a, b) -> Column:
    return F.call_function("shiftleft", _c(a), _c(b))


def shr(a, b) -> Column:
    return F.call_function("shiftright", _c(a), _c(b))


def outside_range(v, r) -> Column:
    return ~_c(v).between(-_c(r), _c(r))


def log2_ceiling(v) -> Column:
    """Bits for v values; 1 for v = 0."""
    v = _c(v)
    return F.when(v == 0, 1).when(v == 1, 0).otherwise(F.length(F.bin(v - 1)))


def byte_count(bits) -> Column:
    return _div(_c(bits) + 7, 8)


def max_sample(bits) -> Column:
    return shl(F.lit(1), _c(bits)) - 1


def max_near(maxval) -> Column:
    return F.least(F.lit(255), _div(maxval, 2))


def initial_a(range_) -> Column:
    return F.greatest(F.lit(2), _div(_c(range_) + 32, 64))


def map_error(e) -> Column:
    e = _c(e)
    return F.when(e >= 0, 2 * e).otherwise(-2 * e - 1)


def unmap_error(m) -> Column:
    m = _c(m)
    return F.when(m % 2 == 0, _div(m, 2)).otherwise(-_div(m + 1, 2))


def sign(n) -> Column:
    """-1 below zero, else 1."""
    return F.when(_c(n) < 0, -1).otherwise(1)


def bit_sign(n) -> Column:
    return shr(n, 31)


def apply_sign(i, s) -> Column:
    return F.when(_c(s) == -1, -_c(i)).otherwise(_c(i))


def range_parameter(maxval, near) -> Column:
    return _div(_c(maxval) + 2 * _c(near), 2 * _c(near) + 1) + 1


def limit_parameter(bits) -> Column:
    return 2 * (_c(bits) + F.greatest(F.lit(8), _c(bits)))


def predict(a, b, c) -> Column:
    """The median of a, b and a + b - c."""
    a, b, c = _c(a), _c(b), _c(c)
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), a + b - c))


def quantize_gradient(d, t1, t2, t3, near) -> Column:
    d, t1, t2, t3, near = map(_c, (d, t1, t2, t3, near))
    return F.when(d <= -t3, -4).when(d <= -t2, -3).when(d <= -t1, -2).when(d < -near, -1).when(d <= near, 0).when(d < t1, 1).when(d < t2, 2).when(d < t3, 3).otherwise(4)


def context_id(q1, q2, q3) -> Column:
    return (_c(q1) * 9 + _c(q2)) * 9 + _c(q3)


def clamp_prediction(p, maxval) -> Column:
    return F.least(F.greatest(_c(p), F.lit(0)), _c(maxval))


def quantize_error(e, near) -> Column:
    e, near = _c(e), _c(near)
    size = _div(F.abs(e) + near, 2 * near + 1)
    return F.when(e > 0, size).otherwise(-size)


def dequantize(e, near) -> Column:
    return _c(e) * (2 * _c(near) + 1)


def modulo_range(e, range_) -> Column:
    e, r = _c(e), _c(range_)
    up = F.when(e < 0, e + r).otherwise(e)
    return F.when(up >= _div(r + 1, 2), up - r).otherwise(up)


def modulo_bits(e, bits) -> Column:
    """The low bits of e, with a sign."""
    half = shl(F.lit(1), _c(bits) - 1)
    return (_c(e) + half).bitwiseAND(max_sample(bits)) - half


def reconstruct(p, e, near, maxval, range_) -> Column:
    p, e, near, maxval, range_ = map(_c, (p, e, near, maxval, range_))
    v = p + dequantize(e, near)
    turn = range_ * (2 * near + 1)
    back = F.when(v < -near, v + turn).when(v > maxval + near, v - turn).otherwise(v)
    return clamp_prediction(back, maxval)


def is_near(a, b, near) -> Column:
    return F.abs(_c(a) - _c(b)) <= _c(near)


def all_near(a: Column, b: Column, near) -> Column:
    """Of two arrays of equal size."""
    return F.forall(F.zip_with(a, b, lambda x, y: is_near(x, y, near)), lambda x: x)


def _inside(v, low, maxval) -> Column:
    return F.when((v > maxval) | (v < low), low).otherwise(v)


def default_preset(maxval, near) -> Column:
    """struct(maxval, t1, t2, t3, reset)"""
    m, n = _c(maxval), _c(near)
    f = _div(F.least(m, F.lit(4095)) + 128, 256)
    g = _div(F.lit(256), m + 1)
    g = F.greatest(g, F.lit(1))
    wide = m >= 128
    raw1 = F.when(wide, f + 2 + 3 * n).otherwise(F.greatest(F.lit(2), _div(F.lit(3), g) + 3 * n))
    raw2 = F.when(wide, 4 * f + 3 + 5 * n).otherwise(F.greatest(F.lit(3), _div(F.lit(7), g) + 5 * n))
    raw3 = F.when(wide, 17 * f + 4 + 7 * n).otherwise(F.greatest(F.lit(4), _div(F.lit(21), g) + 7 * n))
    t1 = _inside(raw1, n + 1, m)
    t2 = _inside(raw2, t1, m)
    t3 = _inside(raw3, t2, m)
    return F.struct(m.alias("maxval"), t1.alias("t1"), t2.alias("t2"), t3.alias("t3"), F.lit(64).alias("reset"))


def explicit_preset(p: Column, bits, near) -> Column:
    """p with defaults for zeros; null if it isn't valid for the sample size."""
    most = max_sample(bits)
    maxval = F.when(p["maxval"] == 0, most).otherwise(p["maxval"])
    d = default_preset(maxval, near)
    pick = {k: F.when(p[k] == 0, d[k]).otherwise(p[k]) for k in ("t1", "t2", "t3", "reset")}
    near = _c(near)
    fine = p["maxval"].between(0, most) & (near <= max_near(maxval)) & pick["t1"].between(near + 1, maxval) & pick["t2"].between(pick["t1"], maxval) & pick["t3"].between(pick["t2"], maxval) & pick["reset"].between(F.lit(3), F.greatest(F.lit(255), maxval))
    return F.when(fine, F.struct(maxval.alias("maxval"), *(v.alias(k) for k, v in pick.items())))


def golomb_k(a, n) -> Column:
    """The least k with n * 2**k >= a."""
    a, n = _c(a), _c(n)
    up = _div(a + n - 1, n)
    return F.when(a <= n, 0).otherwise(F.length(F.bin(up - 1)))


def golomb_k_run(a, n, kind) -> Column:
    return golomb_k(_c(a) + shr(n, 1) * _c(kind), n)


def error_correction(k, b, n) -> Column:
    return F.when(_c(k) != 0, 0).otherwise(bit_sign(2 * _c(b) + _c(n) - 1))


def golomb_length(k, m, limit, qbpp) -> Column:
    """Bits of a limited code."""
    high = shr(m, k)
    return F.when(high < _c(limit) - _c(qbpp) - 1, high + 1 + _c(k)).otherwise(_c(limit))


def mask_sample(v, bits) -> Column:
    return _c(v).bitwiseAND(max_sample(bits))


def transform_possible(bits, components) -> Column:
    return (_c(components) == 3) & _c(bits).isin(8, 16)


def hp_forward(kind: int, r, g, b, bits: int = 8) -> Column:
    """array of three samples."""
    r, g, b = map(_c, (r, g, b))
    m, h = (1 << bits) - 1, 1 << (bits - 1)
    low = lambda x: x.bitwiseAND(F.lit(m))
    if kind == 1:
        return F.array(low(r - g + h), g, low(b - g + h))
    if kind == 2:
        return F.array(low(r - g + h), g, low(b - shr(r + g, 1) - h))
    v2, v3 = low(b - g + h), low(r - g + h)
    return F.array(low(g + shr(v2 + v3, 2) - h // 2), v2, v3)


def hp_inverse(kind: int, v: Column, bits: int = 8) -> Column:
    m, h = (1 << bits) - 1, 1 << (bits - 1)
    low = lambda x: x.bitwiseAND(F.lit(m))
    a, b, c = v[0], v[1], v[2]
    if kind == 1:
        return F.array(low(a + b - h), b, low(c + b - h))
    if kind == 2:
        r = low(a + b - h)
        return F.array(r, b, low(c + shr(r + b, 1) - h))
    g = a - shr(b + c, 2) + h // 2
    return F.array(low(c + g - h), low(g), low(b + g - h))


def estimated_size(width, height, bits, components) -> Column:
    return _c(width).cast("long") * _c(height) * _c(components) * byte_count(bits) + 1024 + 34


def decoded_size(width, height, bits, components, mode, stride=0) -> Column:
    """Bytes of the decoded samples; the last row goes without padding. Null where it is beyond what a buffer can hold."""
    w, h, n, size, s = _c(width).cast("long"), _c(height), _c(components), byte_count(bits), _c(stride)
    least = F.when(_c(mode) == 0, w * size).otherwise(w * size * n)
    rows = F.when(_c(mode) == 0, h.cast("long") * n).otherwise(h.cast("long"))
    total = F.when(s == 0, rows * least).otherwise((rows - 1) * s + least)
    return F.when(total <= 2**31 - 1, total)


def colour_space(components) -> Column:
    return F.when(_c(components) == 1, 8).when(_c(components) == 3, 10).otherwise(2)
