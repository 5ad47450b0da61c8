"""Compressed images as DataFrames.

All functions take a DataFrame with a binary column of whole files, as spark.read.format("binaryFile") gives, and a
key column. `mode` "permissive" puts an error's number into error_code; "failfast" raises it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, astuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import batch, container, scan
from .operators.container import Options, Reader
from .operators.errors import StreamError

_PRESET = "struct<maxval:int,t1:int,t2:int,t3:int,reset:int>"
_SPIFF = "struct<" + ",".join(f"{k}:int" for k in container.SPIFF_FIELDS) + ">"
_FRAME = f"width int, height int, bits_per_sample int, component_count int, restart_interval int, colour_transform int, format int, preset {_PRESET}, spiff {_SPIFF}, spiff_valid boolean, error_code int"


def _rows(df: DataFrame, key: str, content: str, schema: str, parse: Callable[[object, bytes], Iterator[tuple]]) -> DataFrame:
    """Rows that `parse` makes of each file. Headers only; batches are the input's partitions."""
    kind = dict(df.dtypes)[key]
    names = None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [row for k, data in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True) if data is not None for row in parse(k, bytes(data))]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    chosen = df.select(F.col(f"`{key}`"), F.col(f"`{content}`"))
    full = f"`{key}` {kind}, {schema}"
    names = [key, *(f.name for f in df.sparkSession.createDataFrame([], schema).schema)]
    return chosen.mapInPandas(run, full)


def _code(error: StreamError, mode: str) -> int:
    if mode == "failfast":
        raise error
    return int(error.code)


def read_segments(df: DataFrame, *, key: str = "path", content: str = "content", mode: str = "permissive") -> DataFrame:
    """(key, seq, offset, marker, data_size, payload); a broken file ends in a row whose error_code isn't null."""

    def parse(k: object, data: bytes) -> Iterator[tuple]:
        r, code = Reader(data), None
        try:
            r.all_segments()
        except StreamError as e:
            code = _code(e, mode)
        for i, (offset, marker, at, size) in enumerate(r.segments):
            yield k, i, offset, marker, size, data[at : at + size], None
        if code is not None:
            yield k, len(r.segments), r.at, None, None, None, code

    return _rows(df, key, content, "seq int, offset int, marker int, data_size int, payload binary, error_code int", parse)


def read_frames(df: DataFrame, *, key: str = "path", content: str = "content", mode: str = "permissive") -> DataFrame:
    """One row for each file, from its header alone."""

    def parse(k: object, data: bytes) -> Iterator[tuple]:
        r, code = Reader(data), None
        try:
            r.header()
        except StreamError as e:
            code = _code(e, mode)
        yield k, r.width, r.height, r.bits, r.count, r.interval, r.transform, r.format, asdict(r.preset), r.spiff, r.spiff_is_valid(), code

    return _rows(df, key, content, _FRAME, parse)


def _whole(parse: Callable[[object, Reader], Iterator[tuple]], mode: str) -> Callable[[object, bytes], Iterator[tuple]]:
    def run(k: object, data: bytes) -> Iterator[tuple]:
        r = Reader(data)
        try:
            r.all_segments()
        except StreamError as e:
            _code(e, mode)
        yield from parse(k, r)

    return run


def read_components(df: DataFrame, *, key: str = "path", content: str = "content", mode: str = "permissive") -> DataFrame:
    def parse(k: object, r: Reader) -> Iterator[tuple]:
        for i, c in enumerate(r.components):
            yield k, i, c.id, c.near, c.mode, c.table_id

    return _rows(df, key, content, "component_index int, component_id int, near int, interleave_mode int, mapping_table_id int", _whole(parse, mode))


def read_scans(df: DataFrame, *, key: str = "path", content: str = "content", mode: str = "permissive") -> DataFrame:
    def parse(k: object, r: Reader) -> Iterator[tuple]:
        for i, s in enumerate(r.scans):
            yield k, i, s.component_ids, s.near, s.mode, s.offset, asdict(s.preset)

    return _rows(df, key, content, f"scan_index int, component_ids array<int>, near int, interleave_mode int, entropy_offset int, preset {_PRESET}", _whole(parse, mode))


def read_mapping_tables(df: DataFrame, *, key: str = "path", content: str = "content", mode: str = "permissive") -> DataFrame:
    def parse(k: object, r: Reader) -> Iterator[tuple]:
        for i, t in enumerate(r.tables):
            yield k, i, t.id, t.entry_size, len(t.data), t.data

    return _rows(df, key, content, "table_index int, table_id int, entry_size int, data_size int, data binary", _whole(parse, mode))


def external_table_ids(components: DataFrame, tables: DataFrame, key: str = "path") -> DataFrame:
    """Components whose mapping table isn't in their file."""
    return components.where("mapping_table_id <> 0").join(tables.select(key, F.col("table_id").alias("mapping_table_id")), [key, "mapping_table_id"], "left_anti")


def encode(data: Column, width: Column, height: Column, bits: Column, components: Column, options: Options | None = None) -> Column:
    """Compressed bytes of raw samples: planes for mode 0, else pixels; 16-bit samples are little-endian."""
    o = options or Options()

    @F.pandas_udf("binary")
    def run(d: pd.Series, w: pd.Series, h: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        out, held, size = [None] * len(d), [], 0
        for i, x in enumerate(d):
            if x is not None:
                held.append(i)
                size += len(x)
            if held and (size >= batch.MOST_CODED or i + 1 == len(d)):
                images = [(bytes(d[j]), int(w[j]), int(h[j]), int(b[j]), int(n[j]), o, 0) for j in held]
                for j, coded in zip(held, container.encode_many(images), strict=True):
                    out[j] = coded
                held, size = [], 0
        return pd.Series(out, dtype=object)

    return run(data, width, height, bits, components)


def decode(content: Column, mode: str = "permissive") -> Column:
    """struct(width, height, bits_per_sample, component_count, data, error_code) of a file."""

    @F.pandas_udf("width int, height int, bits_per_sample int, component_count int, data binary, error_code int")
    def run(c: pd.Series) -> pd.DataFrame:
        rows = []
        for got in container.decode_many([bytes(x) if x is not None else b"" for x in c]):
            if isinstance(got, StreamError):
                rows.append((None, None, None, None, None, _code(got, mode)))
            else:
                r, data = got
                rows.append((r.width, r.height, r.bits, r.count, data, None))
        return pd.DataFrame(rows, columns=["width", "height", "bits_per_sample", "component_count", "data", "error_code"], dtype=object)

    return run(content)


def intervals(df: DataFrame, *, key: str = "path", content: str = "content") -> DataFrame:
    """The independent parts of files: one row for each restart interval of each scan, with what it takes to decode it."""

    def parse(k: object, data: bytes) -> Iterator[tuple]:
        r = Reader(data).all_segments()
        for i, s in enumerate(r.scans):
            for j, part in enumerate(container.split_intervals(r, s)):
                yield k, i, j, part.width, part.height, r.bits, part.kind.components, s.mode, s.near, asdict(part.kind.preset), r.transform, part.data

    return _rows(df, key, content, f"scan_index int, interval int, width int, height int, bits int, components int, mode int, near int, preset {_PRESET}, transform int, bits_data binary", parse)


#: Samples of a scan that go to one task at least, if it has as many; samples that are decoded at a time.
_PIECE, _TOGETHER = 1 << 14, 1 << 20


def _pieces(df: DataFrame, key: str, content: str) -> DataFrame:
    """As `intervals`, but a row for each stretch of them: `lines` of an interval, but for the last of `height` lines, and the sizes of their bytes."""

    def parse(k: object, data: bytes) -> Iterator[tuple]:
        r = Reader(data).all_segments()
        for i, s in enumerate(r.scans):
            parts = container.split_intervals(r, s)
            lines, kind = parts[0].height, parts[0].kind
            step = max(1, -(-_PIECE // (lines * r.width * kind.components)))
            for j in range(0, len(parts), step):
                own = parts[j : j + step]
                sizes = np.fromiter((len(p.data) for p in own), "<i4", len(own)).tobytes()
                yield k, i, j, r.width, sum(p.height for p in own), lines, r.bits, kind.components, s.mode, s.near, *astuple(kind.preset), r.transform, sizes, b"".join(p.data for p in own)

    return _rows(df, key, content, f"scan_index int, interval int, {', '.join(f'{c} int' for c in _OF_PIECE)}, sizes binary, bits_data binary", parse)


_OF_PIECE = ("width", "height", "lines", "bits", "components", "mode", "near", "maxval", "t1", "t2", "t3", "reset", "transform")


def _decoded(pieces: list[tuple]) -> list[bytes]:
    """The samples of each piece, given as its columns from width on."""
    parts, counts = [], []
    for w, h, lines, bits, n, mode, near, *preset, _, sizes, data in pieces:
        kind = batch.Kind(bits, n, mode, near, scan.Preset(*preset))
        to = np.cumsum(np.frombuffer(sizes, "<i4"), dtype=np.int64).tolist()
        parts += [batch.Part(data[a:b], min(lines, h - i * lines), w, kind) for i, (a, b) in enumerate(zip([0, *to[:-1]], to, strict=True))]
        counts.append(len(to))
    found, at, out = batch.decode_intervals(parts), 0, []
    for (_, _, _, bits, n, mode, *_, transform, _, _), count in zip(pieces, counts, strict=True):
        own, at = found[at : at + count], at + count
        v = np.concatenate(own, axis=1) if len(own) > 1 else own[0]
        if transform and mode and n == 3:
            v = container.transform_inverse(v, transform, bits)
        out.append(container.planes_to_bytes(v, bits, mode != 0))
    return out


def decode_distributed(df: DataFrame, *, key: str = "path", content: str = "content") -> DataFrame:
    """(key, data): as `decode`, but the parts of a file are decoded in different tasks; files of many scans or restart
    intervals aren't bound to one worker. Intervals go by stretches of some 16,384 samples, so small files stay whole."""
    n = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a number that is given isn't lowered by bytes: these are few next to the work
    parts = _pieces(df, key, content).repartition(n, F.col(f"`{key}`"), "scan_index", "interval")

    @F.pandas_udf("binary")
    def run(*columns: pd.Series) -> pd.Series:
        out, held, size = [], [], 0
        for piece in zip(*(c.tolist() for c in columns), strict=True):
            held.append(piece)
            size += piece[0] * piece[1] * piece[4]
            if size >= _TOGETHER:
                out += _decoded(held)
                held, size = [], 0
        return pd.Series(out + _decoded(held), dtype=object)

    done = parts.select(key, "scan_index", "interval", run(*_OF_PIECE, "sizes", "bits_data").alias("data"))
    ordered = F.array_sort(F.collect_list(F.struct("scan_index", "interval", "data")))
    # A file's samples fit one row, as in the raster table; joined as texts, as adding piece to piece would copy all before it each time
    joined = F.when(F.size("parts") == 1, F.col("parts")[0]["data"]).otherwise(F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["data"])), "")))
    return done.groupBy(key).agg(ordered.alias("parts")).select(key, joined.alias("data"))
