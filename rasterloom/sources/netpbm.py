"""Binary portable graymaps and pixmaps (P5, P6), with comments; 16-bit samples are big-endian in files, little-endian here."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(data: bytes) -> tuple[int, int, int, int, bytes]:
    """(width, height, bits per sample, components, samples)"""
    if data[:1] != b"P" or data[1:2] not in b"56" or len(data) < 2:
        raise ValueError("not a binary graymap or pixmap")
    numbers, at = [], 2
    while len(numbers) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("header ends early")
        numbers.append(int(data[at:end]))
        at = end
    width, height, most = numbers
    n, bits = 3 if data[1:2] == b"6" else 1, max(1, most.bit_length())
    size = width * height * n * (2 if most > 255 else 1)
    body = data[at + 1 : at + 1 + size]
    if len(body) != size or not 0 < most < 65536:
        raise ValueError("samples end early")
    return width, height, bits, n, np.frombuffer(body, ">u2").astype("<u2").tobytes() if most > 255 else body


def build(width: int, height: int, bits: int, components: int, data: bytes) -> bytes:
    if components not in (1, 3) or len(data) != width * height * components * (2 if bits > 8 else 1):
        raise ValueError("one or three components, and all samples, are needed")
    body = np.frombuffer(data, "<u2").astype(">u2").tobytes() if bits > 8 else data
    return f"P{5 if components == 1 else 6}\n{width} {height}\n{(1 << bits) - 1}\n".encode() + body


def _parsed(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(bytes(c)) for c in content], columns=["width", "height", "bits_per_sample", "component_count", "data"])


def _built(w: pd.Series, h: pd.Series, b: pd.Series, n: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([build(int(p), int(q), int(r), int(s), bytes(x)) for p, q, r, s, x in zip(w, h, b, n, d, strict=True)], dtype=object)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, bits_per_sample, component_count, data) of files; pixels of three components are interleaved."""
    parsed = F.pandas_udf(_parsed, "width int, height int, bits_per_sample int, component_count int, data binary")
    return spark.read.format("binaryFile").load(path).select("path", parsed("content").alias("r")).select("path", "r.*")


def to_bytes(width: Column, height: Column, bits: Column, components: Column, data: Column) -> Column:
    return F.pandas_udf(_built, "binary")(width, height, bits, components, data)
