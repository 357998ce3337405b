"""Operators on rasters (one row for each sample) and signals: neighbours by windows, lifting, planes, metrics.

Windows are partitioned by image and row, or by signal, so that a task holds one line at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import color


def neighbours(raster: DataFrame) -> DataFrame:
    """raster(name, y, x, v) with a (left), b (above), c (upper left) and d (upper right) by the rules of T.87.

    Above the image are zeros; left of a line stands the sample above, right of it the last one of the line above.
    """
    row, column = Window.partitionBy("name", "y").orderBy("x"), Window.partitionBy("name", "x").orderBy("y")
    up = raster.withColumn("b", F.lag("v", 1, 0).over(column)).withColumn("_bb", F.lag("v", 2, 0).over(column))
    a, d = F.coalesce(F.lag("v").over(row), F.col("b")), F.coalesce(F.lead("b").over(row), F.col("b"))
    c = F.coalesce(F.lag("b").over(row), F.col("_bb"))
    return up.withColumn("a", a).withColumn("c", c).withColumn("d", d).drop("_bb")


def predicted(raster: DataFrame, middle: int) -> DataFrame:
    """raster with p0 to p7, the predictions of T.81's lossless coding: the first line from the left, the first column from above, the first sample `middle`."""
    row, column = Window.partitionBy("name", "y").orderBy("x"), Window.partitionBy("name", "x").orderBy("y")
    up = raster.withColumn("_b", F.lag("v").over(column)).withColumn("_a", F.lag("v").over(row)).withColumn("_c", F.lag("_b").over(row))
    edge = F.when(F.col("_a").isNull() & F.col("_b").isNull(), middle).when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b"))
    inner = {0: F.lit(0)} | color.predictors(F.col("_a"), F.col("_b"), F.col("_c"))
    return up.select(*raster.columns, *(F.coalesce(edge, p).alias(f"p{k}") for k, p in inner.items()))


def residuals(raster: DataFrame) -> DataFrame:
    near = neighbours(raster)
    e = F.col("v") - color.med(F.col("a"), F.col("b"), F.col("c"))
    return near.select("name", "y", "x", e.alias("residual"), color.mapped_error(e).alias("mapped"))


def lifted_53(signal: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """One level of the reversible 5/3 transform of each signal: high (odd places) and low (even places), mirrored at the ends; one sample alone is its low."""
    w = Window.partitionBy(key).orderBy(at)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    high = F.col(value) - F.floor((F.coalesce(before, after) + F.coalesce(after, before)) / 2)
    one = signal.withColumn("d", F.when(F.col(at) % 2 == 1, high))
    left, right = F.lag("d").over(w), F.lead("d").over(w)
    low = F.col(value) + F.coalesce(F.floor((F.coalesce(left, right) + F.coalesce(right, left) + 2) / 4), F.lit(0))
    return one.select(key, at, value, F.when(F.col(at) % 2 == 1, F.col("d")).otherwise(low).cast("long").alias("w"))


def unlifted_53(waves: DataFrame, key: str, at: str) -> DataFrame:
    """The inverse of lifted_53."""
    w = Window.partitionBy(key).orderBy(at)
    left, right = F.lag("w").over(w), F.lead("w").over(w)
    even = F.col("w") - F.coalesce(F.floor((F.coalesce(left, right) + F.coalesce(right, left) + 2) / 4), F.lit(0))
    one = waves.withColumn("e", F.when(F.col(at) % 2 == 0, even))
    before, after = F.lag("e").over(w), F.lead("e").over(w)
    odd = F.col("w") + F.floor((F.coalesce(before, after) + F.coalesce(after, before)) / 2)
    return one.withColumn("back", F.when(F.col(at) % 2 == 0, F.col("e")).otherwise(odd).cast("long"))


def compared(pairs: DataFrame, key: str, x: str, y: str, top: int) -> DataFrame:
    """Mean absolute error, largest difference, mean square error and signal to noise (infinite where they are equal) of two versions of each image."""
    d = F.col(x) - F.col(y)
    out = pairs.groupBy(key).agg(F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("max_diff"), F.avg(d * d).alias("mse"))
    return out.withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(F.lit(float(top * top)) / F.col("mse"))).when(F.col("mse") == 0, float("inf"))).withColumn("lossless", F.col("max_diff") == 0)


def gradient(spark, name: str, width: int, height: int, top: int = 255) -> DataFrame:
    """The ramp over all samples, from 0 to top."""
    n = width * height
    i = F.col("id")
    return spark.range(n).select(F.lit(name).alias("name"), F.floor(i / width).cast("int").alias("y"), (i % width).cast("int").alias("x"), F.floor(i * top / max(1, n - 1)).cast("int").alias("v"))
