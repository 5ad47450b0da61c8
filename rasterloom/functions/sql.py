"""The codec for SQL: register(spark) adds the functions jls_encode, jls_decode and jls_frame and the table function jls_segments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import container
from ..operators.errors import StreamError


class Segments:
    """(seq, offset, marker, data_size, payload, error_code) of a file; a broken file's last row has the error."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        reader, code = container.Reader(bytes(content)), None
        try:
            reader.all_segments()
        except StreamError as e:
            code = int(e.code)
        for i, (offset, marker, at, size) in enumerate(reader.segments):
            yield i, offset, marker, size, reader.data[at : at + size], None
        if code is not None:
            yield len(reader.segments), reader.at, None, None, None, code


def _encode(data: pd.Series, width: pd.Series, height: pd.Series, bits: pd.Series, components: pd.Series, mode: pd.Series, near: pd.Series) -> pd.Series:
    rows = zip(data, width, height, bits, components, mode, near, strict=True)
    whole = [None if any(v is None or v != v for v in r) else (bytes(r[0]), *map(int, r[1:5]), container.Options(mode=int(r[5]), near=int(r[6])), 0) for r in rows]
    coded = iter(container.encode_many([r for r in whole if r]))
    return pd.Series([next(coded) if r else None for r in whole], dtype=object)


def _decode(content: pd.Series) -> pd.Series:
    """Samples of a file; null where it can't be read."""
    got = container.decode_many([b"" if c is None else bytes(c) for c in content])
    return pd.Series([None if isinstance(g, StreamError) else g[1] for g in got], dtype=object)


#: What jls_frame tells, from the header alone.
FRAME = "width int, height int, bits_per_sample int, component_count int, restart_interval int, colour_transform int, error_code int"


def _frame(content: pd.Series) -> pd.DataFrame:
    """A file's frame; where its header can't be read, only the error. A null file has neither."""
    rows = []
    for c in content:
        r = container.Reader(bytes(c) if c is not None else b"")
        try:
            if c is not None:
                r.header()
            rows.append((r.width, r.height, r.bits, r.count, r.interval, r.transform, None) if c is not None else (None,) * 7)
        except StreamError as e:
            rows.append((None,) * 6 + (int(e.code),))
    return pd.DataFrame(rows, columns=[f.split()[0] for f in FRAME.split(", ")], dtype=object)


def register(spark: SparkSession) -> None:
    spark.udf.register("jls_encode", F.pandas_udf(_encode, "binary"))
    spark.udf.register("jls_decode", F.pandas_udf(_decode, "binary"))
    spark.udf.register("jls_frame", F.pandas_udf(_frame, FRAME))
    spark.udtf.register("jls_segments", F.udtf(Segments, returnType="seq int, offset int, marker int, data_size int, payload binary, error_code int"))
