"""Operators on rasters (one row for each sample) and tables of levels: contexts, runs, tiles, bit planes, trees, codes, files.

Windows are partitioned by image and line or by restart group; a task never holds more than one of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import color

from . import signals


def dead_zone(value: Column, step: float) -> tuple[Column, Column]:
    """The level of a coefficient (towards zero) and its reconstruction in the middle of the interval."""
    level = (F.signum(value) * F.floor(F.abs(value) / step)).cast("long")
    return level, F.signum(level) * (F.abs(level) + 0.5) * step


def gradient_class(g: Column, near: int, t: tuple[int, int, int]) -> Column:
    """-4 to 4 by three thresholds."""
    size = F.when(F.abs(g) <= near, 0).when(F.abs(g) < t[0], 1).when(F.abs(g) < t[1], 2).when(F.abs(g) < t[2], 3).otherwise(4)
    # On the negative side the thresholds themselves belong to the outer class, as they do on the positive one.
    return (F.signum(g) * size).cast("long")


def contexts(raster: DataFrame, near: int = 0, t: tuple[int, int, int] = (3, 7, 21)) -> DataFrame:
    """raster(name, y, x, v) with its neighbours and the context number (0 to 364) of each sample."""
    q = [gradient_class(g, near, t) for g in (F.col("d") - F.col("b"), F.col("b") - F.col("c"), F.col("c") - F.col("a"))]
    return signals.neighbours(raster).withColumn("context", F.abs((q[0] * 9 + q[1]) * 9 + q[2]))


def run_modes(raster: DataFrame) -> DataFrame:
    """The mode that lossless coding (T.87) is in at each sample: run, interruption (the sample that ends a run) or regular.

    A run begins where all gradients are zero and goes on while samples equal their left neighbour. So in a stretch of
    such samples all from the first flat place on are in the run; stretches are numbered by the samples that break them.
    """
    row = Window.partitionBy("name", "y").orderBy("x")
    one = contexts(raster).withColumn("_flat", F.col("context") == 0).withColumn("_same", F.col("v") == F.col("a"))
    one = one.withColumn("_stretch", F.sum(F.when(F.col("_same"), 0).otherwise(1)).over(row))
    begun = F.max(F.when(F.col("_same") & F.col("_flat"), 1).otherwise(0)).over(Window.partitionBy("name", "y", "_stretch").orderBy("x"))
    one = one.withColumn("_run", F.col("_same") & (begun == 1))
    ends = ~F.col("_same") & (F.col("_flat") | F.coalesce(F.lag("_run").over(row), F.lit(False)))
    return one.select("name", "y", "x", F.when(F.col("_run"), "run").when(ends, "interruption").otherwise("regular").alias("mode"))


def segments(raster: DataFrame) -> DataFrame:
    """The runs of equal samples in each line: name, y, start, length and value."""
    row = Window.partitionBy("name", "y").orderBy("x")
    marked = raster.withColumn("_new", F.when(F.col("v") == F.lag("v").over(row), 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_new").over(row))
    return marked.groupBy("name", "y", "_run").agg(F.min("x").alias("start"), F.count("*").alias("length"), F.first("v").alias("v")).drop("_run")


def tiled(raster: DataFrame, side: int = 8) -> DataFrame:
    """name, by, bx and the samples of each block in an array; places outside the image are 0."""
    at = (F.col("y") % side * side + F.col("x") % side).cast("int")
    of = [F.floor(F.col(c) / side).alias(f"b{c}") for c in ("y", "x")]
    some = raster.groupBy("name", *of).agg(F.map_from_entries(F.collect_list(F.struct(at, F.col("v")))).alias("_m"))
    places = F.sequence(F.lit(0), F.lit(side * side - 1))
    return some.select("name", "by", "bx", F.transform(places, lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0))).alias("block"))


def untiled(blocks: DataFrame, width: int, height: int, side: int = 8) -> DataFrame:
    """The samples of blocks that lie inside the image."""
    s = blocks.select("name", "by", "bx", F.posexplode("block").alias("pos", "v"))
    y, x = F.col("by") * side + F.floor(F.col("pos") / side), F.col("bx") * side + F.col("pos") % side
    return s.select("name", y.alias("y"), x.alias("x"), "v").where((F.col("y") < height) & (F.col("x") < width))


def differences(dc: DataFrame, image: str, order: str, value: str, interval: int | None = None) -> DataFrame:
    """diff of each value to the one before it in its image; with an interval the prediction starts anew after as many."""
    mcu = F.row_number().over(Window.partitionBy(image).orderBy(order)) - 1
    one = dc.withColumn("mcu", mcu).withColumn("restart", F.floor(F.col("mcu") / interval) if interval else F.lit(0).cast("long"))
    w = Window.partitionBy(image, "restart").orderBy("mcu")
    return one.withColumn("diff", F.col(value) - F.lag(value, 1, 0).over(w))


def bit_planes(levels: DataFrame, planes: int) -> DataFrame:
    """Of each plane, the number of levels whose magnitude has its bit."""
    each = levels.select(F.abs("level").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(planes - 1))).alias("plane"))
    return each.groupBy("plane").agg(F.sum(F.expr("shiftright(m, plane) & 1")).alias("ones"))


def top_bits(levels: DataFrame, key: str) -> DataFrame:
    """The largest magnitude of each block and how many bit planes it needs."""
    top = levels.groupBy(key).agg(F.max(F.abs("level")).alias("top"))
    return top.withColumn("planes", color.category(F.col("top")))


def tag_tree(raster: DataFrame, levels: int) -> DataFrame:
    """The minima of each level of the tree: one shuffle for all levels, after partial minima of each task."""
    each = raster.select("name", "y", "x", "v", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    at = [F.expr(f"shiftright({c}, level)").alias(f"n{c}") for c in ("y", "x")]
    return each.groupBy("name", "level", *at).agg(F.min("v").alias("v"))


def canonical_codes(lengths: DataFrame) -> DataFrame:
    """lengths(name, idx, symbol, bits) with the canonical prefix code of each symbol: the share of the code space before it."""
    before = Window.partitionBy("name").orderBy("bits", "idx").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("bits"))).over(before), F.lit(0.0))
    return lengths.withColumn("code", (used * F.pow(F.lit(2.0), "bits")).cast("long"))


def first_difference(pairs: DataFrame, key: str, at: Column, got: str, expected: str) -> DataFrame:
    """The first place at which two versions of an image differ, and both values; images without one have no row."""
    return pairs.where(F.col(got) != F.col(expected)).groupBy(key).agg(F.min(F.struct(at.alias("pos"), F.col(got).alias("got"), F.col(expected).alias("expected"))).alias("m")).select(key, "m.*")


def byte_counts(df: DataFrame, text: str) -> DataFrame:
    """How often each byte (two hexadecimal digits) stands in the texts, in UTF-8: at most 256 numbers leave a task."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(256, np.int64)
        for pdf in batches:
            for t in pdf[text].dropna():
                total += np.bincount(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        some = np.flatnonzero(total)
        if len(some):
            yield pd.DataFrame({"byte": [f"{b:02X}" for b in some], "n": total[some]})

    return df.select(text).mapInPandas(counted, "byte string, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def stuffed(data: Column) -> Column:
    """The bytes that a coded scan grows by: one after each 0xFF."""
    return F.size(F.filter(F.regexp_extract_all(F.hex(data), F.lit("(..)")), lambda b: b == "FF"))


def refinement_context(refined: Column, around: Column) -> Column:
    """The context of a sample that is significant already: 16 after its first refinement, before it by its neighbours."""
    return F.when(refined, 16).when(around > 0, 15).otherwise(14)


def quad_contexts(raster: DataFrame, col: str) -> DataFrame:
    """name, qy, qx, rho (which of a quad's 2 x 2 samples have col other than 0) and context: whether a quad to the left or above is hit."""
    bit = F.pow(F.lit(2), F.col("x") % 2 + F.col("y") % 2 * 2).cast("int")
    quads = raster.groupBy("name", F.floor(F.col("y") / 2).alias("qy"), F.floor(F.col("x") / 2).alias("qx")).agg(F.sum(F.when(F.col(col) != 0, bit).otherwise(0)).cast("int").alias("rho"))
    row, column = Window.partitionBy("name", "qy").orderBy("qx"), Window.partitionBy("name", "qx").orderBy("qy")
    up = quads.withColumn("_u", F.lag("rho", 1, 0).over(column))
    seen = F.lag("rho", 1, 0).over(row) + F.col("_u") + F.lag("_u", 1, 0).over(row) + F.lead("_u", 1, 0).over(row)
    return up.withColumn("context", (seen > 0).cast("int")).drop("_u")


def graymap(raster: DataFrame) -> DataFrame:
    """name and the binary portable graymap of each 8-bit image; one image is one row, as any file is."""
    image = raster.groupBy("name").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    body = F.unhex(F.array_join(F.transform("p", lambda s: F.lpad(F.hex(s["v"].cast("long")), 2, "0")), ""))
    return image.select("name", F.concat(F.encode(F.format_string("P5\n%d %d\n255\n", "w", "h"), "US-ASCII"), body).alias("file"))


def pixmap(raster: DataFrame) -> DataFrame:
    """name and the binary portable pixmap of each image of raster(name, y, x, r, g, b)."""
    image = raster.groupBy("name").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.sort_array(F.collect_list(F.struct("y", "x", "r", "g", "b"))).alias("p"))
    byte = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    body = F.unhex(F.array_join(F.transform("p", lambda s: F.concat(byte(s["r"]), byte(s["g"]), byte(s["b"]))), ""))
    return image.select("name", F.concat(F.encode(F.format_string("P6\n%d %d\n255\n", "w", "h"), "US-ASCII"), body).alias("file"))
