"""Samples as rows (image, component, y, x, v): neighbourhoods by windows, residuals, runs, layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s


def explode_samples(df: DataFrame, keys: list[str], values: Column) -> DataFrame:
    """A row for each element of an array of samples, with its place x."""
    return df.select(*keys, F.posexplode(values).alias("x", "v"))


def neighbours(samples: DataFrame, image: list[str], width: int | None = None) -> DataFrame:
    """Adds ra, rb, rc, rd (left, above, above left, above right) by the causal edge rules.

    Partitions are rows and columns of one image: bounded by the image's sides. With a restart interval, add y div
    interval to `image`.
    """
    row, col = Window.partitionBy(*image, "y").orderBy("x"), Window.partitionBy(*image, "x").orderBy("y")
    above = samples.select("*", F.coalesce(F.lag("v").over(col), F.lit(0)).alias("rb"), F.lag("v", 2).over(col).alias("__two"))
    return above.select(
        *samples.columns, "rb", F.coalesce(F.lag("v").over(row), "rb").alias("ra"),
        F.coalesce(F.lag("rb").over(row), "__two", F.lit(0)).alias("rc"), F.coalesce(F.lead("rb").over(row), "rb").alias("rd"),
    )


def gradients(near_by: DataFrame) -> DataFrame:
    return near_by.withColumns({"d1": F.col("rd") - F.col("rb"), "d2": F.col("rb") - F.col("rc"), "d3": F.col("rc") - F.col("ra")})


def contexts(near_by: DataFrame, t1: int, t2: int, t3: int, near: int = 0) -> DataFrame:
    """Adds qs, the signed number of the context; |qs| and its sign are the folded one."""
    q = lambda c: s.quantize_gradient(F.col(c), t1, t2, t3, near)
    return gradients(near_by).withColumn("qs", s.context_id(q("d1"), q("d2"), q("d3")))


def residuals(near_by: DataFrame) -> DataFrame:
    return near_by.withColumn("px", s.predict(F.col("ra"), F.col("rb"), F.col("rc"))).withColumn("residual", F.col("v") - F.col("px"))


def residual_stats(res: DataFrame, by: list[str]) -> DataFrame:
    e = F.col("residual")
    return res.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.abs(e)).alias("sum_abs"), F.max(F.abs(e)).alias("max_abs"), F.sum(e).alias("sum_residual"))


def context_histogram(ctx: DataFrame) -> DataFrame:
    return ctx.groupBy(F.abs("qs").alias("context")).agg(F.count("*").alias("n"))


def run_islands(samples: DataFrame, line: list[str], order: str, value: str) -> DataFrame:
    """Maximal stretches of equal samples of a line: (line, run, v, first, n)."""
    w = Window.partitionBy(*line).orderBy(order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    marked = samples.select(*line, order, value, changed.alias("__c")).withColumn("run", F.sum("__c").over(w))
    return marked.groupBy(*line, "run").agg(F.first(value).alias("v"), F.min(order).alias("first"), F.count("*").alias("n"))


def to_pixels(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v array by component) of rows with component and v."""
    return samples.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "v"))), lambda p: p["v"]).alias("v"))


def to_planes(pixels: DataFrame, keys: list[str], values: str = "v") -> DataFrame:
    """(keys, component, v) of arrays by component."""
    return pixels.select(*keys, F.posexplode(values).alias("component", "v"))


def swap_first_last(v: Column) -> Column:
    return F.array(v[2], v[1], v[0])


def expand_palette(samples: DataFrame, palette: DataFrame, on: list[str]) -> DataFrame:
    """Joins samples with the entries (table keys, entry, colour) of a palette; a palette has 65536 entries at most a table."""
    return samples.join(palette, [*on], "left")
