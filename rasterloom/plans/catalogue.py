"""Queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import jls
from ..functions import scalars as s
from ..operators import container, samples
from ..operators.container import Options
from ..operators.scan import Preset
from . import views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _lit(*names: str) -> list:
    return [F.col(n) for n in names]


# Scalars, row by row

RGB = views.RGB_SQL


@_query(f"SELECT k, n, r - g AS e, CASE WHEN r >= g THEN 2 * (r - g) ELSE -2 * (r - g) - 1 END AS m FROM ({RGB})")
def zigzag_map(spark, sf_dir):
    return views.rgb(spark, sf_dir).select("k", "n", (F.col("r") - F.col("g")).alias("e"), s.map_error(F.col("r") - F.col("g")).alias("m"))


@_query(f"SELECT k, n, CASE WHEN r % 2 = 0 THEN r // 2 ELSE -((r + 1) // 2) END AS e, CASE WHEN r - g < 0 THEN -1 ELSE 1 END AS sgn, (r - g) >> 31 AS bsgn, CASE WHEN r - g < 0 THEN -b ELSE b END AS signed_b, abs(r - g) > b AS outside FROM ({RGB})")
def zigzag_unmap(spark, sf_dir):
    d = F.col("r") - F.col("g")
    return views.rgb(spark, sf_dir).select("k", "n", s.unmap_error(F.col("r")).alias("e"), s.sign(d).alias("sgn"), s.bit_sign(d).alias("bsgn"), s.apply_sign(F.col("b"), s.bit_sign(d)).alias("signed_b"), s.outside_range(d, F.col("b")).alias("outside"))


@_query("SELECT p_partkey, CASE WHEN p_size = 0 THEN 1 WHEN p_size = 1 THEN 0 ELSE length(bin(p_size - 1)) END AS bits, (p_size % 15 + 2 + 7) // 8 AS bytes FROM part")
def log2_ceiling(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", s.log2_ceiling(F.col("p_size")).alias("bits"), s.byte_count(F.col("p_size") % 15 + 2).alias("bytes"))


_PART = "SELECT p_partkey, CAST(p_size % 15 + 2 AS INTEGER) AS bits, CAST(pow(2, p_size % 15 + 2) AS INTEGER) - 1 AS maxval, least(p_size % 5, (CAST(pow(2, p_size % 15 + 2) AS INTEGER) - 1) // 2) AS near, p_size FROM part"


def _part(spark, sf_dir):
    bits = F.col("p_size") % 15 + 2
    return views.table(spark, sf_dir, "part").select("p_partkey", bits.alias("bits"), s.max_sample(bits).alias("maxval"), F.least(F.col("p_size") % 5, s.max_near(s.max_sample(bits))).alias("near"), "p_size")


@_query(f"SELECT p_partkey, maxval, near, (maxval + 2 * near) // (2 * near + 1) + 1 AS rng, 2 * (bits + greatest(8, bits)) AS lim, greatest(2, ((maxval + 2 * near) // (2 * near + 1) + 1 + 32) // 64) AS a0, least(255, maxval // 2) AS most_near FROM ({_PART})")
def range_limit_params(spark, sf_dir):
    r = s.range_parameter(F.col("maxval"), F.col("near"))
    return _part(spark, sf_dir).select("p_partkey", "maxval", "near", r.alias("rng"), s.limit_parameter(F.col("bits")).alias("lim"), s.initial_a(r).alias("a0"), s.max_near(F.col("maxval")).alias("most_near"))


_DEFAULTS = f"""
SELECT *, CASE WHEN r3 > maxval OR r3 < t2 THEN t2 ELSE r3 END AS t3, 64 AS reset FROM (
  SELECT *, CASE WHEN r2 > maxval OR r2 < t1 THEN t1 ELSE r2 END AS t2 FROM (
    SELECT *, CASE WHEN r1 > maxval OR r1 < near + 1 THEN near + 1 ELSE r1 END AS t1 FROM (
      SELECT *, CASE WHEN maxval >= 128 THEN f + 2 + 3 * near ELSE greatest(2, 3 // g + 3 * near) END AS r1,
             CASE WHEN maxval >= 128 THEN 4 * f + 3 + 5 * near ELSE greatest(3, 7 // g + 5 * near) END AS r2,
             CASE WHEN maxval >= 128 THEN 17 * f + 4 + 7 * near ELSE greatest(4, 21 // g + 7 * near) END AS r3
      FROM (SELECT *, (least(maxval, 4095) + 128) // 256 AS f, greatest(1, 256 // (maxval + 1)) AS g FROM ({_PART})))))
"""


@_query(f"SELECT p_partkey, maxval, near, t1, t2, t3, reset FROM ({_DEFAULTS})")
def default_presets(spark, sf_dir):
    d = s.default_preset(F.col("maxval"), F.col("near"))
    return _part(spark, sf_dir).select("p_partkey", "near", d.alias("d")).select("p_partkey", "near", "d.*")


_GIVEN = f"SELECT *, p_size % 4 * 5 AS g1, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS g3, p_size % 2 * 31 AS g_reset FROM ({_DEFAULTS})"
_FILLED = f"SELECT *, CASE WHEN g1 = 0 THEN t1 ELSE g1 END AS f1, t2 AS f2, CASE WHEN g3 = 0 THEN t3 ELSE g3 END AS f3, CASE WHEN g_reset = 0 THEN 64 ELSE g_reset END AS fr FROM ({_GIVEN})"
_VALID = "near <= least(255, maxval // 2) AND f1 BETWEEN near + 1 AND maxval AND f2 BETWEEN f1 AND maxval AND f3 BETWEEN f2 AND maxval AND fr BETWEEN 3 AND greatest(255, maxval)"


@_query(f"SELECT p_partkey, {_VALID} AS valid, CASE WHEN {_VALID} THEN f1 END AS t1, CASE WHEN {_VALID} THEN f3 END AS t3, CASE WHEN {_VALID} THEN fr END AS reset FROM ({_FILLED})")
def explicit_presets(spark, sf_dir):
    z = F.lit(0)
    given = F.struct(z.alias("maxval"), (F.col("p_size") % 4 * 5).alias("t1"), z.alias("t2"), F.when(F.col("p_size") % 3 == 0, 0).otherwise(F.col("p_size")).alias("t3"), (F.col("p_size") % 2 * 31).alias("reset"))
    e = _part(spark, sf_dir).withColumn("p", given).select("p_partkey", s.explicit_preset(F.col("p"), F.col("bits"), F.col("near")).alias("e"))
    return e.select("p_partkey", F.col("e").isNotNull().alias("valid"), "e.t1", "e.t3", "e.reset")


def _q_sql(d: str, t=(3, 7, 21), near: int = 0) -> str:
    t1, t2, t3 = t
    return f"CASE WHEN {d} <= -{t3} THEN -4 WHEN {d} <= -{t2} THEN -3 WHEN {d} <= -{t1} THEN -2 WHEN {d} < -{near} THEN -1 WHEN {d} <= {near} THEN 0 WHEN {d} < {t1} THEN 1 WHEN {d} < {t2} THEN 2 WHEN {d} < {t3} THEN 3 ELSE 4 END"


@_query(f"SELECT k, n, {_q_sql('(r - g)')} AS q0, {_q_sql('(r - g)', (5, 9, 23), 2)} AS q2 FROM ({RGB})")
def gradient_quantize(spark, sf_dir):
    d = F.col("r") - F.col("g")
    return views.rgb(spark, sf_dir).select("k", "n", s.quantize_gradient(d, 3, 7, 21, 0).alias("q0"), s.quantize_gradient(d, 5, 9, 23, 2).alias("q2"))


@_query(f"SELECT k, n, q AS qs, abs(q) AS folded, q >> 31 AS sgn FROM (SELECT k, n, ({_q_sql('(r - g)')} * 9 + {_q_sql('(g - b)')}) * 9 + {_q_sql('(b - r)')} AS q FROM ({RGB}))")
def context_id(spark, sf_dir):
    q = lambda a, b: s.quantize_gradient(F.col(a) - F.col(b), 3, 7, 21, 0)
    qs = s.context_id(q("r", "g"), q("g", "b"), q("b", "r"))
    return views.rgb(spark, sf_dir).select("k", "n", qs.alias("qs")).select("*", F.abs("qs").alias("folded"), s.bit_sign(F.col("qs")).alias("sgn"))


_MED = "CASE WHEN {c} >= greatest({a}, {b}) THEN least({a}, {b}) WHEN {c} <= least({a}, {b}) THEN greatest({a}, {b}) ELSE {a} + {b} - {c} END"


@_query(f"SELECT k, n, {_MED.format(a='r', b='g', c='b')} AS px FROM ({RGB})")
def med_predict_scalar(spark, sf_dir):
    return views.rgb(spark, sf_dir).select("k", "n", s.predict(*_lit("r", "g", "b")).alias("px"))


@_query(f"SELECT k, n, least(greatest(r - g + b, 0), 255) AS p FROM ({RGB})")
def correct_prediction(spark, sf_dir):
    return views.rgb(spark, sf_dir).select("k", "n", s.clamp_prediction(F.col("r") - F.col("g") + F.col("b"), 255).alias("p"))


_NQ = "CASE WHEN r - g > 0 THEN (abs(r - g) + 3) // 7 ELSE -((abs(r - g) + 3) // 7) END"


@_query(f"SELECT k, n, {_NQ} AS e, {_NQ} * 7 AS d FROM ({RGB})")
def near_quantize(spark, sf_dir):
    e = s.quantize_error(F.col("r") - F.col("g"), 3)
    return views.rgb(spark, sf_dir).select("k", "n", e.alias("e"), s.dequantize(e, 3).alias("d"))


@_query(f"SELECT k, n, CASE WHEN u >= 128 THEN u - 256 ELSE u END AS e, ((d + 128) & 255) - 128 AS e8 FROM (SELECT *, r - g AS d, CASE WHEN r - g < 0 THEN r - g + 256 ELSE r - g END AS u FROM ({RGB}))")
def modulo_range(spark, sf_dir):
    d = F.col("r") - F.col("g")
    return views.rgb(spark, sf_dir).select("k", "n", s.modulo_range(d, 256).alias("e"), s.modulo_bits(d, 8).alias("e8"))


@_query(f"SELECT k, n, least(greatest(CASE WHEN v < -3 THEN v + 266 WHEN v > 258 THEN v - 266 ELSE v END, 0), 255) AS x, (r + g - b) & 255 AS x0 FROM (SELECT *, r + (g - 2 * b) * 7 % 266 // 7 * 7 AS v FROM ({RGB}))")
def reconstruct(spark, sf_dir):
    t = (F.col("g") - 2 * F.col("b")) * 7 % 266
    e = ((t - t % 7) / 7).cast("int")
    return views.rgb(spark, sf_dir).select("k", "n", s.reconstruct(F.col("r"), e, 3, 255, 38).alias("x"), (F.col("r") + F.col("g") - F.col("b")).bitwiseAND(255).alias("x0"))


@_query(f"SELECT k, n, abs(r - g) <= 3 AS one, abs(r - g) <= 50 AND abs(g - b) <= 50 AND abs(b - r) <= 50 AS three FROM ({RGB})")
def is_near_tuple(spark, sf_dir):
    a, b = F.array("r", "g", "b"), F.array("g", "b", "r")
    return views.rgb(spark, sf_dir).select("k", "n", s.is_near(F.col("r"), F.col("g"), 3).alias("one"), s.all_near(a, b, 50).alias("three"))


@_query("SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_partkey & 4095 AS INTEGER) AS v12, CAST(l_partkey & 15 AS INTEGER) AS v4 FROM lineitem")
def sample_mask(spark, sf_dir):
    p = F.col("l_partkey").cast("int")
    return views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), s.mask_sample(p, 12).alias("v12"), s.mask_sample(p, 4).alias("v4"))


_K = "CASE WHEN {a} <= {n} THEN 0 ELSE length(bin(({a} + {n} - 1) // {n} - 1)) END"


@_query(f"SELECT k, n, {_K.format(a='r', n='(b + 1)')} AS k0, {_K.format(a='(r + ((b + 1) >> 1))', n='(b + 1)')} AS k1, CASE WHEN {_K.format(a='r', n='(b + 1)')} <> 0 THEN 0 ELSE (2 * (g - 128) + b) >> 31 END AS fix FROM ({RGB})")
def golomb_k(spark, sf_dir):
    r, n = F.col("r"), F.col("b") + 1
    return views.rgb(spark, sf_dir).select("k", "n", s.golomb_k(r, n).alias("k0"), s.golomb_k_run(r, n, 1).alias("k1"), s.error_correction(s.golomb_k(r, n), F.col("g") - 128, n).alias("fix"))


@_query(f"SELECT k, n, CASE WHEN m >> kk < 32 - 8 - 1 THEN (m >> kk) + 1 + kk ELSE 32 END AS bits FROM (SELECT k, n, r * 2 + 1 AS m, {_K.format(a='g', n='(b + 1)')} AS kk FROM ({RGB}))")
def golomb_code_length(spark, sf_dir):
    return views.rgb(spark, sf_dir).select("k", "n", s.golomb_length(s.golomb_k(F.col("g"), F.col("b") + 1), F.col("r") * 2 + 1, 32, 8).alias("bits"))


def _hp_sql(kind: int) -> str:
    v = {1: "((r - g + 128) & 255, g, (b - g + 128) & 255)", 2: "((r - g + 128) & 255, g, (b - ((r + g) >> 1) - 128) & 255)", 3: "((g + ((((b - g + 128) & 255) + ((r - g + 128) & 255)) >> 2) - 64) & 255, (b - g + 128) & 255, (r - g + 128) & 255)"}[kind]
    a, b, c = v[1:-1].split(", ")
    return f"SELECT k, n, {a} AS v1, {b} AS v2, {c} AS v3 FROM ({RGB})"


def _hp(kind: int):
    def run(spark, sf_dir):
        return views.rgb(spark, sf_dir).select("k", "n", s.hp_forward(kind, *_lit("r", "g", "b")).alias("v")).select("k", "n", *(F.col("v")[i].alias(f"v{i + 1}") for i in range(3)))

    run.__name__ = f"hp{kind}_fwd"
    return run


for _kind in (1, 2, 3):
    _query(_hp_sql(_kind))(_hp(_kind))


@_query(f"SELECT k, n, r, g, b, TRUE AS same FROM ({RGB})")
def hp_roundtrip(spark, sf_dir):
    x = views.rgb(spark, sf_dir)
    back = [s.hp_inverse(i, s.hp_forward(i, *_lit("r", "g", "b"))) for i in (1, 2, 3)]
    same = (back[0] == F.array("r", "g", "b")) & (back[1] == back[0]) & (back[2] == back[0])
    return x.select("k", "n", back[2][0].alias("r"), back[2][1].alias("g"), back[2][2].alias("b"), same.alias("same"))


@_query("SELECT p_partkey, CAST(p_size AS BIGINT) * 100 * 3 * ((p_size % 15 + 2 + 7) // 8) + 1058 AS estimated, CAST(p_size AS BIGINT) * 100 * 3 * ((p_size % 15 + 2 + 7) // 8) AS decoded, CASE WHEN p_size % 4 = 1 THEN 8 WHEN p_size % 4 = 3 THEN 10 ELSE 2 END AS space, p_size % 4 = 3 AND p_size % 15 + 2 IN (8, 16) AS possible FROM part")
def buffer_sizes(spark, sf_dir):
    w, bits, n = F.col("p_size"), F.col("p_size") % 15 + 2, F.col("p_size") % 4
    return views.table(spark, sf_dir, "part").select("p_partkey", s.estimated_size(w, 100, bits, 3).alias("estimated"), s.decoded_size(w, 100, bits, 3, 2).alias("decoded"), s.colour_space(n).alias("space"), s.transform_possible(bits, n).alias("possible"))


# Windows over samples

_NEAR_SQL = f"""
SELECT *, coalesce(lag(v) OVER row, rb) AS ra, coalesce(lag(rb) OVER row, two, 0) AS rc, coalesce(lead(rb) OVER row, rb) AS rd FROM (
  SELECT *, coalesce(lag(v) OVER col, 0) AS rb, lag(v, 2) OVER col AS two FROM ({views.SAMPLES8_SQL}) WINDOW col AS (PARTITION BY label, x ORDER BY y))
WINDOW row AS (PARTITION BY label, y ORDER BY x)
"""


def _near(spark, sf_dir):
    return samples.neighbours(views.samples8(spark, sf_dir), ["label"])


@_query(f"SELECT label, y, x, v, ra, rb, rc, rd FROM ({_NEAR_SQL})")
def neighbourhood(spark, sf_dir):
    return _near(spark, sf_dir)


@_query(f"SELECT label, y, x, rd - rb AS d1, rb - rc AS d2, rc - ra AS d3 FROM ({_NEAR_SQL})")
def gradients(spark, sf_dir):
    return samples.gradients(_near(spark, sf_dir)).select("label", "y", "x", "d1", "d2", "d3")


_CTX_SQL = f"SELECT label, y, x, ({_q_sql('(rd - rb)')} * 9 + {_q_sql('(rb - rc)')}) * 9 + {_q_sql('(rc - ra)')} AS qs FROM ({_NEAR_SQL})"


@_query(_CTX_SQL)
def contexts(spark, sf_dir):
    return samples.contexts(_near(spark, sf_dir), 3, 7, 21).select("label", "y", "x", "qs")


@_query(f"SELECT abs(qs) AS context, count(*) AS n FROM ({_CTX_SQL}) GROUP BY 1")
def context_histogram(spark, sf_dir):
    return samples.context_histogram(samples.contexts(_near(spark, sf_dir), 3, 7, 21))


_RES_SQL = f"SELECT label, y, x, v - ({_MED.format(a='ra', b='rb', c='rc')}) AS residual FROM ({_NEAR_SQL})"


@_query(_RES_SQL)
def med_residuals(spark, sf_dir):
    return samples.residuals(_near(spark, sf_dir)).select("label", "y", "x", "residual")


@_query(f"SELECT label, count(*) AS n, CAST(sum(abs(residual)) AS BIGINT) AS sum_abs, max(abs(residual)) AS max_abs, CAST(sum(residual) AS BIGINT) AS sum_residual FROM ({_RES_SQL}) GROUP BY label")
def residual_stats(spark, sf_dir):
    return samples.residual_stats(samples.residuals(_near(spark, sf_dir)), ["label"])


@_query(f"""
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(v) AS v, min(event_id) AS first, count(*) AS n FROM (
  SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (
    SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AND lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT NULL THEN 0 ELSE 1 END AS c FROM ({views.STRIP_SQL})))
GROUP BY user_id, run
""")
def run_islands(spark, sf_dir):
    return samples.run_islands(views.strip(spark, sf_dir), ["user_id"], "event_id", "v").select("user_id", "run", "v", "first", "n")


@_query(f"SELECT vec_id, list_slice(v, 1, 16) AS a, list_slice(v, 17, 32) AS b, list_slice(v, 33, 48) AS c, list_slice(v, 49, 64) AS d FROM ({views.emb_sql(127.5, 255)})")
def planar_to_pixel(spark, sf_dir):
    """Each vector as four planes of 16; gathered to pixels of four and split again."""
    rows = samples.explode_samples(views.emb8(spark, sf_dir), ["vec_id"], F.col("v"))
    planes = rows.select("vec_id", (F.col("x") % 16).alias("p"), s._div(F.col("x"), 16).alias("component"), "v")
    pixels = samples.to_pixels(planes, ["vec_id", "p"]).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("l"))
    plane = lambda i: F.transform("l", lambda q: q["v"][i])
    return pixels.select("vec_id", *(plane(i).alias(c) for i, c in enumerate("abcd")))


@_query(f"SELECT k, n, c AS component, CASE c WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS v FROM ({RGB}), (VALUES (0), (1), (2)) t(c)")
def pixel_to_planar(spark, sf_dir):
    return samples.to_planes(views.rgb(spark, sf_dir).select("k", "n", F.array("r", "g", "b").alias("v")), ["k", "n"])


@_query(f"SELECT k, n, b AS v1, g AS v2, r AS v3 FROM ({RGB})")
def bgr_to_rgb(spark, sf_dir):
    v = samples.swap_first_last(F.array("r", "g", "b"))
    return views.rgb(spark, sf_dir).select("k", "n", *(v[i].alias(f"v{i + 1}") for i in range(3)))


# Coding

_DOC = "encode(coalesce(text, ''))"


@_query(f"SELECT doc_id, md5({_DOC}) AS digest, octet_length({_DOC}) AS n FROM documents")
def roundtrip_docs(spark, sf_dir):
    """Every whole text as an image of 64 columns, coded and decoded; the flagship."""
    d = views.docbytes(spark, sf_dir).withColumn("jls", jls.encode(F.col("data"), F.col("width"), F.col("height"), F.lit(8), F.lit(1)))
    back = d.select("doc_id", "n", jls.decode(F.col("jls"), "failfast").alias("r"))
    return back.select("doc_id", F.md5(F.substring("r.data", F.lit(1), F.col("n").cast("int"))).alias("digest"), F.col("n").cast("bigint").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip_docs(spark, sf_dir)


def _hex(v, width: int):
    """Samples of an array as bytes: one each, or two little-endian."""
    one = lambda x: F.lpad(F.hex(x.bitwiseAND(255)), 2, "0")
    pair = (lambda x: one(x)) if width == 1 else (lambda x: F.concat(one(x), F.lpad(F.hex(s.shr(x, 8)), 2, "0")))
    return F.unhex(F.array_join(F.transform(v, pair), ""))


def _vectors(spark, sf_dir, bits: int) -> DataFrame:
    rows = views.emb8(spark, sf_dir) if bits == 8 else views.emb12(spark, sf_dir)
    return rows.repartition("vec_id").select("vec_id", "v", _hex(F.col("v"), 1 if bits == 8 else 2).alias("data"))


def _sum_sql(scale: float, most: int) -> str:
    return f"SELECT vec_id, TRUE AS same, CAST(list_sum(v) AS BIGINT) AS total FROM ({views.emb_sql(scale, most)})"


def _checked(df: DataFrame, width: int, height: int, bits: int, n: int, o: Options) -> DataFrame:
    """Coded and decoded: whether the bytes are the same, and the decoded samples' sum."""
    kind = "u1" if bits <= 8 else "<u2"
    total = F.pandas_udf(lambda d: d.map(lambda x: int(np.frombuffer(x, kind).sum(dtype=np.int64))), "bigint")
    code = jls.encode(F.col("data"), F.lit(width), F.lit(height), F.lit(bits), F.lit(n), o)
    back = df.select("vec_id", "data", jls.decode(code, "failfast")["data"].alias("back"))
    return back.select("vec_id", (F.col("back") == F.col("data")).alias("same"), total("back").alias("total"))


@_query(_sum_sql(2047.5, 4095))
def roundtrip_12bit(spark, sf_dir):
    return _checked(_vectors(spark, sf_dir, 12), 16, 4, 12, 1, Options())


@_query(_sum_sql(127.5, 255))
def roundtrip_rgb_line(spark, sf_dir):
    return _checked(_vectors(spark, sf_dir, 8), 8, 2, 8, 4, Options(mode=1))


@_query(_sum_sql(127.5, 255))
def roundtrip_rgb_sample(spark, sf_dir):
    return _checked(_vectors(spark, sf_dir, 8), 8, 4, 8, 2, Options(mode=2))


@_query(_sum_sql(127.5, 255))
def roundtrip_hp(spark, sf_dir):
    # all 64 samples and two zeros more, so that three components divide them
    rows = _vectors(spark, sf_dir, 8).select("vec_id", F.concat("data", F.unhex(F.lit("0000"))).alias("data"))
    parts = [_checked(rows, 11, 2, 8, 3, Options(mode=2 - k % 2, transform=k)) for k in (1, 2, 3)]
    every = parts[0].union(parts[1]).union(parts[2])
    return every.groupBy("vec_id").agg(F.min("same").alias("same"), F.max("total").alias("total"))


@_query("SELECT vec_id, TRUE AS within, CAST(NULL AS INTEGER) AS error_code FROM embeddings")
def near_lossless_bound(spark, sf_dir):
    code = jls.encode(F.col("data"), F.lit(16), F.lit(4), F.lit(8), F.lit(1), Options(near=3))
    back = _vectors(spark, sf_dir, 8).select("vec_id", "v", jls.decode(code).alias("r")).select("vec_id", "v", F.col("r.error_code").alias("error_code"), F.hex("r.data").alias("h"))
    got = F.transform("v", lambda x, i: F.conv(F.substring(F.col("h"), 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
    return back.select("vec_id", s.all_near(F.col("v"), got, 3).alias("within"), "error_code")


def _coded_docs(spark, sf_dir, o: Options | None = None) -> DataFrame:
    d = views.docbytes(spark, sf_dir)
    return d.select("doc_id", jls.encode(F.col("data"), F.col("width"), F.col("height"), F.lit(8), F.lit(1), o).alias("content"))


@_query(f"SELECT doc_id, 64 AS width, CAST(greatest(1, ceil(octet_length({_DOC}) / 64.0)) AS INTEGER) AS height, 8 AS bits_per_sample, 1 AS component_count, TRUE AS spiff_valid, CAST(NULL AS INTEGER) AS error_code FROM documents")
def frame_metadata(spark, sf_dir):
    f = jls.read_frames(_coded_docs(spark, sf_dir, Options(spiff={})), key="doc_id")
    return f.select("doc_id", "width", "height", "bits_per_sample", "component_count", "spiff_valid", "error_code")


@_query("SELECT doc_id, t.seq, t.marker, t.size AS data_size FROM documents, (VALUES (0, 216, 0), (1, 254, 5), (2, 227, 2), (3, 247, 9), (4, 218, 6), (5, 217, 0)) t(seq, marker, size)")
def segments_listing(spark, sf_dir):
    o = Options(comments=(b"hello",), app_data=((3, b"ab"),))
    return jls.read_segments(_coded_docs(spark, sf_dir, o), key="doc_id", mode="failfast").select("doc_id", "seq", "marker", "data_size")


@_query("SELECT n_nationkey AS k, n_name AS comment FROM nation")
def comments_roundtrip(spark, sf_dir):
    @F.pandas_udf("binary")
    def with_comment(names):
        return names.map(lambda x: container.encode(b"\1\2\3\4", 2, 2, 8, 1, Options(comments=(x.encode(),))))

    files = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), with_comment("n_name").alias("content"))
    return jls.read_segments(files, key="k").where("marker = 254").select("k", F.decode("payload", "UTF-8").alias("comment"))


def _palettes(spark, sf_dir) -> DataFrame:
    """A file for each region: a table of the region's nation names, eight bytes each, and an image of their numbers."""
    pad = F.encode(F.rpad(F.substring("n_name", 1, 8), 8, " "), "UTF-8")
    rows = views.table(spark, sf_dir, "nation").select("n_regionkey", F.struct("n_nationkey", pad.alias("p")).alias("s")).groupBy("n_regionkey").agg(F.array_sort(F.collect_list("s")).alias("l"))
    data = F.aggregate("l", F.lit(b""), lambda a, x: F.concat(a, x["p"]))

    @F.pandas_udf("binary")
    def build(key, table):
        out = []
        for k, t in zip(key, table, strict=True):
            n = len(t) // 8
            out.append(container.encode(bytes(range(n)), n, 1, 8, 1, Options(tables=((int(k) + 1, 8, bytes(t)),) if k != 2 else (), table_ids=(int(k) + 1,))))
        import pandas as pd

        return pd.Series(out, dtype=object)

    return rows.select("n_regionkey", build("n_regionkey", data).alias("content"))


@_query("SELECT n_regionkey, 0 AS table_index, n_regionkey + 1 AS table_id, 8 AS entry_size, CAST(8 * count(*) AS INTEGER) AS data_size, md5(string_agg(rpad(substr(n_name, 1, 8), 8, ' '), '' ORDER BY n_nationkey)) AS digest FROM nation WHERE n_regionkey <> 2 GROUP BY n_regionkey")
def mapping_tables(spark, sf_dir):
    t = jls.read_mapping_tables(_palettes(spark, sf_dir), key="n_regionkey")
    return t.select("n_regionkey", "table_index", "table_id", "entry_size", "data_size", F.md5("data").alias("digest"))


@_query("SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS x, CASE WHEN n_regionkey <> 2 THEN rpad(substr(n_name, 1, 8), 8, ' ') END AS entry FROM nation")
def palette_expand(spark, sf_dir):
    files = _palettes(spark, sf_dir)
    tables = jls.read_mapping_tables(files, key="n_regionkey")
    entries = tables.select("n_regionkey", F.explode(F.sequence(F.lit(0), s._div(F.col("data_size"), F.col("entry_size")) - 1)).alias("v"), "data", "entry_size")
    entries = entries.select("n_regionkey", "v", F.decode(F.substring("data", F.col("v") * F.col("entry_size") + 1, F.col("entry_size")), "UTF-8").alias("entry"))
    image = files.select("n_regionkey", jls.decode(F.col("content"))["data"].alias("d")).select("n_regionkey", F.posexplode(F.sequence(F.lit(0), F.octet_length("d") - 1)).alias("x", "i"), "d")
    index = image.select("n_regionkey", "x", F.conv(F.hex(F.substring("d", F.col("i") + 1, F.lit(1))), 16, 10).cast("int").alias("v"))
    return samples.expand_palette(index, entries, ["n_regionkey", "v"]).select("n_regionkey", "x", "entry")


@_query("SELECT 2 AS n_regionkey, 3 AS mapping_table_id, 2 AS format FROM region WHERE r_regionkey = 2")
def external_table_ids(spark, sf_dir):
    files = _palettes(spark, sf_dir)
    found = jls.external_table_ids(jls.read_components(files, key="n_regionkey"), jls.read_mapping_tables(files, key="n_regionkey"), "n_regionkey")
    return found.select("n_regionkey", "mapping_table_id", F.lit(container.IMAGE_ONLY).alias("format"))


@_query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 11 WHEN 1 THEN 16 WHEN 2 THEN 6 WHEN 3 THEN 15 ELSE 31 END AS error_code FROM documents")
def error_codes(spark, sf_dir):
    """Streams broken in five ways, one for each document."""
    bad = [b"\xff\xd9", b"\xff\xd8\xff\xd8", b"\xff\xd8\xff\xc0", b"\xff\xd8\xff\xf7\0\1", b"\xff\xd8" + container.segment(container.SOF, b"\1\0\1\0\1\1\1\x11\0")]
    pick = F.element_at(F.array(*(F.lit(b) for b in bad)), (F.col("doc_id") % 5 + 1).cast("int"))
    files = views.table(spark, sf_dir, "documents").select("doc_id", pick.alias("content"))
    return files.select("doc_id", jls.decode(F.col("content"))["error_code"].alias("error_code"))


_H45 = "ffd8fff7000b020004000301011100fff800110205 03ffffffff000000ff000000ffffda0008010105000000db95f0ffd9".replace(" ", "")


@_query("SELECT '000001010102020203030303' AS samples, 'ffffffff000000ff000000ff' AS palette FROM region WHERE r_regionkey = 0")
def golden_h45(spark, sf_dir):
    files = views.table(spark, sf_dir, "region").where("r_regionkey = 0").select("r_regionkey", F.unhex(F.lit(_H45)).alias("content"))
    data = files.select("r_regionkey", F.lower(F.hex(jls.decode(F.col("content"), "failfast")["data"])).alias("samples"))
    tables = jls.read_mapping_tables(files, key="r_regionkey").select("r_regionkey", F.lower(F.hex("data")).alias("palette"))
    return data.join(tables, "r_regionkey").select("samples", "palette")


_SIZES = (("blank", bytes(512 * 512), (512, 512, 8, 1), Options(), 99), ("even", bytes(512 * 512), (512, 512, 8, 1), Options(even_size=True), 100), ("reset", bytes(512 * 512), (512, 512, 8, 1), Options(preset=Preset(255, 3, 7, 21, 65)), 114), ("oversize", bytes(131072), (65536, 1, 16, 1), Options(), 46), ("wide", bytes(2), (1, 1, 16, 1), Options(presets_for_wide=True), 43), ("quad", bytes((10, 20, 30, 40)), (1, 1, 8, 4), Options(mode=2), 47))


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', {size})" for name, *_, size in _SIZES) + ") t(image, size)")
def golden_sizes(spark, sf_dir):
    parts = []
    for name, data, frame, o, _ in _SIZES:
        row = spark.sql(f"SELECT '{name}' AS image").withColumn("d", F.unhex(F.repeat(F.lit("00"), len(data))) if not any(data) else F.lit(data))
        parts.append(row.select("image", F.octet_length(jls.encode(F.col("d"), *(F.lit(x) for x in frame), o)).alias("size")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@_query(f"SELECT doc_id, md5({_DOC}) AS digest FROM documents")
def restart_decode(spark, sf_dir):
    """Texts coded with a restart every five lines; the intervals of one file are decoded in different tasks."""
    d = views.docbytes(spark, sf_dir)
    files = d.select("doc_id", jls.encode(F.col("data"), F.col("width"), F.col("height"), F.lit(8), F.lit(1), Options(restart_interval=5)).alias("content"))
    back = jls.decode_distributed(files, key="doc_id")
    sizes = views.table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    return back.join(sizes, "doc_id").select("doc_id", F.md5(F.substring("data", F.lit(1), F.col("n"))).alias("digest"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
