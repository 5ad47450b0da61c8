"""Queries over small files that are built from the test tables: containers, layouts, errors, SQL functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import jls
from ..functions import scalars as s
from ..functions import sql
from ..operators import container
from ..operators.container import Options
from ..operators.scan import Preset
from ..sources import netpbm
from . import views

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _query(text: str) -> Callable:
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, text
        return f

    return add


def _made(build: Callable[[int], bytes], key: Column) -> Column:
    return F.pandas_udf(lambda k: pd.Series([build(int(x)) for x in k], dtype=object), "binary")(key)


def _nations(spark, sf_dir, build: Callable[[int], bytes]) -> DataFrame:
    """(k, content): a file for each nation, made of its key."""
    return views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), _made(build, F.col("n_nationkey")).alias("content"))


def _ramp(n: int, k: int) -> bytes:
    return bytes((i * (k + 1)) % 251 for i in range(n))


def _ramp_sum(n: str, k: str) -> str:
    return f"CAST(list_sum(list_transform(range({n}), lambda i: (i * ({k} + 1)) % 251)) AS BIGINT)"


def _sum(data: Column) -> Column:
    """Of the bytes of data."""
    return F.pandas_udf(lambda d: pd.Series([sum(bytes(x)) if x is not None else None for x in d], dtype="Int64"), "bigint")(data)


@_query(f"SELECT n_nationkey AS k, 255 AS maxval, CAST(3 + n_nationkey % 5 AS INTEGER) AS t1, 9 AS t2, 25 AS t3, CAST(40 + n_nationkey AS INTEGER) AS reset, {_ramp_sum('24', 'n_nationkey')} AS total FROM nation")
def preset_parameters(spark, sf_dir):
    files = _nations(spark, sf_dir, lambda k: container.encode(_ramp(24, k), 6, 4, 8, 1, Options(preset=Preset(255, 3 + k % 5, 9, 25, 40 + k))))
    frames = jls.read_frames(files, key="k").select("k", *(F.col(f"preset.{c}").alias(c) for c in ("maxval", "t1", "t2", "t3", "reset")))
    return frames.join(files.select("k", _sum(jls.decode(F.col("content"), "failfast")["data"]).alias("total")), "k")


@_query("SELECT r_regionkey AS k, CAST(CASE WHEN r_regionkey % 2 = 0 THEN 65536 + r_regionkey ELSE 1 END AS INTEGER) AS width, CAST(CASE WHEN r_regionkey % 2 = 0 THEN 1 ELSE 65536 + r_regionkey END AS INTEGER) AS height, 65536 + r_regionkey AS n FROM region")
def oversize_frames(spark, sf_dir):
    def build(k: int) -> bytes:
        w, h = (65536 + k, 1) if k % 2 == 0 else (1, 65536 + k)
        return container.encode(bytes(w * h), w, h, 8, 1)

    files = views.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), _made(build, F.col("r_regionkey")).alias("content"))
    data = files.select("k", F.octet_length(jls.decode(F.col("content"), "failfast")["data"]).cast("bigint").alias("n"))
    return jls.read_frames(files, key="k").select("k", "width", "height").join(data, "k")


@_query(f"SELECT n_nationkey AS k, CAST(2 + n_nationkey AS INTEGER) AS height, {_ramp_sum('5 * (2 + n_nationkey)', 'n_nationkey')} AS total FROM nation")
def late_line_counts(spark, sf_dir):
    """Files whose frame has no height; a segment after the first scan tells it."""

    def build(k: int) -> bytes:
        good, h = container.encode(_ramp(5 * (2 + k), k), 5, 2 + k, 8, 1), 2 + k
        at = good.index(bytes((0xFF, container.SOF)))
        return good[: at + 5] + b"\0\0" + good[at + 7 : -2] + container.segment(container.DNL, h.to_bytes(2, "big")) + good[-2:]

    files = _nations(spark, sf_dir, build)
    return files.select("k", jls.decode(F.col("content"), "failfast").alias("r")).select("k", F.col("r.height").alias("height"), _sum(F.col("r.data")).alias("total"))


@_query("SELECT n_nationkey AS k, CAST(t.tag AS BIGINT) AS tag, CASE t.tag WHEN 3 THEN encode(n_name) WHEN 64 THEN encode(CAST(n_nationkey AS VARCHAR)) ELSE encode('') END AS entry FROM nation, (VALUES (3), (64), (1)) t(tag)")
def spiff_directory(spark, sf_dir):
    """Entries of the directory behind a SPIFF header; the last, with tag 1, ends it."""
    rows = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    built = F.pandas_udf(lambda k, n: pd.Series([container.encode(b"\1\2", 2, 1, 8, 1, Options(spiff={}, spiff_entries=((3, x.encode()), (64, str(i).encode())))) for i, x in zip(k, n)], dtype=object), "binary")
    segments = jls.read_segments(rows.select("k", built("k", "n_name").alias("content")), key="k", mode="failfast").where("marker = 232 AND seq > 1")
    entry = F.when(F.col("payload").substr(1, 4) == F.unhex(F.lit("00000001")), F.lit(b"")).otherwise(F.col("payload").substr(F.lit(5), F.octet_length("payload")))
    return segments.select("k", F.conv(F.hex(F.col("payload").substr(1, 4)), 16, 10).cast("bigint").alias("tag"), entry.alias("entry"))


@_query("SELECT n_nationkey AS k, CAST(n_nationkey + 1 AS INTEGER) AS table_id, CAST(t.n AS INTEGER) AS entry_size, 12 AS data_size FROM nation, (VALUES (2)) t(n)")
def tables_only_streams(spark, sf_dir):
    """Abbreviated streams: mapping tables without an image."""
    files = _nations(spark, sf_dir, lambda k: container.tables_only(((k + 1, 2, _ramp(12, k)),)))
    return jls.read_mapping_tables(files, key="k", mode="failfast").select("k", "table_id", "entry_size", "data_size")


@_query("SELECT n_nationkey AS k, CAST(t.i AS INTEGER) AS scan_index, t.ids AS component_ids, CAST(t.mode AS INTEGER) AS interleave_mode FROM nation, (VALUES (0, [1], 0), (1, [2, 3], 2), (2, [4], 0)) t(i, ids, mode)")
def component_scans(spark, sf_dir):
    """Four components coded in three groups, one of them by pixels."""
    files = _nations(spark, sf_dir, lambda k: container.encode(_ramp(48, k), 4, 3, 8, 4, [(1, Options()), (2, Options(mode=2)), (1, Options())]))
    return jls.read_scans(files, key="k", mode="failfast").select("k", "scan_index", "component_ids", "interleave_mode")


@_query(f"SELECT n_nationkey AS k, {_ramp_sum('48', 'n_nationkey')} AS total FROM nation")
def component_groups(spark, sf_dir):
    files = _nations(spark, sf_dir, lambda k: container.encode(_ramp(48, k), 4, 3, 8, 4, [(1, Options()), (2, Options(mode=2)), (1, Options())]))
    return files.select("k", _sum(jls.decode(F.col("content"), "failfast")["data"]).alias("total"))


@_query(f"SELECT n_nationkey AS k, {_ramp_sum('15', 'n_nationkey')} AS total, CAST(5 + 2 * 8 AS BIGINT) AS n FROM nation")
def strides(spark, sf_dir):
    """Rows of five samples that lie eight bytes apart, coded and decoded to such rows again."""

    def build(k: int) -> bytes:
        rows = _ramp(15, k)
        wide = b"".join(rows[i : i + 5] + b"\xaa" * 3 for i in range(0, 15, 5))
        return container.decode(container.encode(wide, 5, 3, 8, 1, Options(), stride=8), stride=8)[1]

    back = _nations(spark, sf_dir, build)
    inside = F.concat(*(F.col("content").substr(1 + 8 * y, 5) for y in range(3)))
    return back.select("k", _sum(inside).alias("total"), s.decoded_size(5, 3, 8, 1, 0, 8).alias("n"))


@_query(f"SELECT n_nationkey AS k, 4 AS width, 3 AS height, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 3 END AS component_count, {_ramp_sum('12 * CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 3 END', 'n_nationkey')} AS total, TRUE AS same FROM nation")
def netpbm_files(spark, sf_dir):
    """Graymaps and pixmaps with a comment, read, coded, decoded and written again."""

    def build(k: int) -> bytes:
        n = 1 if k % 2 == 0 else 3
        w, h, bits, n, data = netpbm.parse(f"P{5 if n == 1 else 6}\n# nation {k}\n4 3\n255\n".encode() + _ramp(12 * n, k))
        return container.encode(data, w, h, bits, n, Options(mode=2 if n == 3 else 0))

    back = _nations(spark, sf_dir, build).select("k", jls.decode(F.col("content"), "failfast").alias("r")).select("k", "r.*")
    again = netpbm.to_bytes(*(F.col(c) for c in ("width", "height", "bits_per_sample", "component_count", "data")))
    head = F.concat(F.lit(b"P"), F.when(F.col("component_count") == 1, F.lit(b"5")).otherwise(F.lit(b"6")), F.lit(b"\n4 3\n255\n"))
    return back.select("k", "width", "height", "component_count", _sum(F.col("data")).alias("total"), (again == F.concat(head, "data")).alias("same"))


@_query("SELECT n_nationkey AS k, 6 AS width, 4 AS height, 8 AS bits_per_sample, 1 AS component_count, CAST(CASE WHEN n_nationkey % 5 = 0 THEN 11 END AS INTEGER) AS error_code FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey, NULL, NULL, NULL, NULL, 11 FROM nation WHERE n_nationkey % 5 = 0")
def sql_frames(spark, sf_dir):
    """jls_frame in SQL; each fifth file has no start."""
    sql.register(spark)
    files = _nations(spark, sf_dir, lambda k: container.encode(_ramp(24, k), 6, 4, 8, 1)[0 if k % 5 else 2 :])
    return spark.sql("SELECT k, f.width, f.height, f.bits_per_sample, f.component_count, f.error_code FROM (SELECT k, jls_frame(content) AS f FROM {files})", files=files)


@_query(f"SELECT n_nationkey AS k, {_ramp_sum('24', 'n_nationkey')} AS total, 216 AS first_marker, CAST(4 AS BIGINT) AS segments FROM nation")
def sql_functions(spark, sf_dir):
    """jls_encode, jls_decode and jls_segments in SQL."""
    sql.register(spark)
    raw = _nations(spark, sf_dir, lambda k: _ramp(24, k))
    files = spark.sql("SELECT k, jls_encode(content, 6, 4, 8, 1, 0, 0) AS content FROM {raw}", raw=raw)
    found = spark.sql("SELECT k, min_by(marker, seq) AS first_marker, count(*) AS segments FROM (SELECT k, s.* FROM {files}, LATERAL jls_segments(content) s) GROUP BY k", files=files)
    back = spark.sql("SELECT k, jls_decode(content) AS data FROM {files}", files=files)
    return back.select("k", _sum(F.col("data")).alias("total")).join(found, "k")


@_query("SELECT p_partkey AS k, CASE p_size % 5 + 1 WHEN 1 THEN 8 WHEN 3 THEN 10 ELSE 2 END AS space, p_size % 5 + 1 = 3 AND p_size % 15 + 2 IN (8, 16) AS transform_possible, abs(p_size - 25) > 10 AS outside FROM part")
def frame_rules(spark, sf_dir):
    """Colour space by components, whether a colour transform is possible, values outside of a range."""
    n, bits = F.col("p_size") % 5 + 1, F.col("p_size") % 15 + 2
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), s.colour_space(n).alias("space"), s.transform_possible(bits, n).alias("transform_possible"), s.outside_range(F.col("p_size") - 25, F.lit(10)).alias("outside"))


# Streams that break a rule, and the number by which the error is known.
_SOI, _EOI = b"\xff\xd8", b"\xff\xd9"


def _frame(bits: int = 8, w: int = 2, h: int = 2, parts: tuple = ((1, 0x11),)) -> bytes:
    return container.segment(container.SOF, bytes((bits,)) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes((len(parts),)) + b"".join(bytes((i, f, 0)) for i, f in parts))


def _start(*ids: int, near: int = 0, mode: int = 0) -> bytes:
    return container.segment(container.SOS, bytes((len(ids),)) + b"".join(bytes((i, 0)) for i in ids) + bytes((near, mode, 0)))


_BROKEN = (
    ("empty", b"", 4), ("no marker", b"xyz", 10), ("unknown marker", _SOI + b"\xff\x02", 13), ("scan first", _SOI + _start(1), 14), ("restart outside", _SOI + b"\xff\xd5", 22),
    ("early line count", _SOI + container.segment(container.DNL, b"\0\2"), 25), ("segment too long", _SOI + b"\xff\xf7\0\x21", 15), ("two frames", _SOI + _frame() + _frame(), 17),
    ("one id twice", _SOI + _frame(parts=((2, 0x11), (2, 0x11))), 18), ("subsampled", _SOI + _frame(parts=((1, 0x21),)), 7), ("one bit", _SOI + _frame(1), 31), ("no components", _SOI + _frame(parts=()), 32),
    ("near too large", _SOI + _frame() + _start(1, near=129), 34), ("lines of one", _SOI + _frame() + _start(1, mode=1), 33), ("no such component", _SOI + _frame() + _start(7, near=1), 27), ("no width", _SOI + _frame(w=0) + _start(1), 29),
    ("no line count", _SOI + _frame(h=0) + _start(1) + b"\0" + _EOI, 26), ("preset type", _SOI + container.segment(container.LSE, b"\x0f"), 20), ("extended preset", _SOI + container.segment(container.LSE, b"\x06"), 9),
    ("table zero", _SOI + container.segment(container.LSE, b"\x02\0\x01b"), 37), ("table goes on", _SOI + container.segment(container.LSE, b"\x03\x02\x01b"), 38), ("transform unknown", _SOI + container.segment(container.APP8, b"mrfx\x07"), 36),
)


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', {code})" for name, _, code in _BROKEN) + ") t(fault, error_code)")
def broken_streams(spark, sf_dir):
    files = spark.createDataFrame([(name, data) for name, data, _ in _BROKEN], "fault string, content binary")
    return files.select("fault", jls.decode(F.col("content"))["error_code"].alias("error_code"))


#: Images of zeros: (name, (width, height, bits, components), known size of the file).
_BLANK = (("square", (512, 512, 8, 1), 99), ("line", (65536, 1, 16, 1), 46))


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', CAST({f[0] * f[1] * (f[2] // 8)} AS BIGINT), CAST({size} AS BIGINT), CAST(0 AS INTEGER))" for name, f, size in _BLANK) + ") t(image, raw, coded, max_error)")
def compression_sizes(spark, sf_dir):
    """Bytes before and after, of which the ratio is made, and the largest difference of a sample after decoding."""
    out = None
    for name, frame, _ in _BLANK:
        data = F.unhex(F.repeat(F.lit("00"), frame[0] * frame[1] * (frame[2] // 8)))
        row = spark.sql(f"SELECT '{name}' AS image").withColumn("data", data).withColumn("f", jls.encode(F.col("data"), *map(F.lit, frame)))
        largest = F.pandas_udf(lambda a, b: pd.Series([max(abs(x - y) for x, y in zip(bytes(p), bytes(q))) for p, q in zip(a, b)]), "int")
        row = row.select("image", F.octet_length("data").cast("bigint").alias("raw"), F.octet_length("f").cast("bigint").alias("coded"), largest("data", jls.decode(F.col("f"), "failfast")["data"]).alias("max_error"))
        out = row if out is None else out.union(row)
    return out


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
