"""Wavelets of lines and planes, and what block coders look at around a sample: windows over one line or column each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import color

from . import signals

#: The four lifting steps of the irreversible 9/7 transform (odd, even, odd, even places) and its scale.
STEPS_97 = [-1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971]
SCALE_97 = 1.230174104914001


def _lift(df: DataFrame, key: str, at: str, col: str, odd: int, weight: float) -> DataFrame:
    """The places of one parity plus weight times both neighbours, mirrored at the ends; one place alone stays as it is."""
    w = Window.partitionBy(key).orderBy(at)
    before, after = F.lag(col).over(w), F.lead(col).over(w)
    both = F.coalesce(before, after) + F.coalesce(after, before)
    return df.withColumn(col, F.when((F.col(at) % 2 == odd) & ~_alone(key, at), F.col(col) + both * weight).otherwise(F.col(col)))


def _alone(key: str, at: str) -> Column:
    """Whether a signal has this one place only."""
    w = Window.partitionBy(key).orderBy(at)
    return F.lag(at).over(w).isNull() & F.lead(at).over(w).isNull()


def lifted_97(signal: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """One level of the 9/7 transform, as `w` beside the value: all steps share one partitioning and one sort."""
    out = signal.select(key, at, value, F.col(value).cast("double").alias("w"))
    for i, weight in enumerate(STEPS_97):
        out = _lift(out, key, at, "w", (i + 1) % 2, weight)
    scaled = F.when(F.col(at) % 2 == 1, F.col("w") * SCALE_97).otherwise(F.col("w") / SCALE_97)
    return out.withColumn("w", F.when(_alone(key, at), F.col("w")).otherwise(scaled))


def unlifted_97(waves: DataFrame, key: str, at: str) -> DataFrame:
    """The inverse of lifted_97, as `back`."""
    scaled = F.when(F.col(at) % 2 == 1, F.col("w") / SCALE_97).otherwise(F.col("w") * SCALE_97)
    out = waves.withColumn("back", F.when(_alone(key, at), F.col("w")).otherwise(scaled))
    for i, weight in reversed(list(enumerate(STEPS_97))):
        out = _lift(out, key, at, "back", (i + 1) % 2, -weight)
    return out


def _lines(raster: DataFrame, across: str, along: str, lift) -> DataFrame:
    """raster(name, y, x, v) after lift(signal, key, at) of each line (or column) `across`; lift's result is named v."""
    key = F.concat_ws("\x01", "name", F.col(across).cast("string")).alias("_k")
    out = lift(raster.select(key, along, "v"), "_k", along)
    split = F.split("_k", "\x01")
    return out.select(split[0].alias("name"), split[1].cast("int").alias(across), along, "v").select("name", "y", "x", "v")


def _forward(reversible: bool):
    if reversible:
        return lambda s, k, at: signals.lifted_53(s.withColumn("v", F.col("v").cast("long")), k, at, "v").select(k, at, F.col("w").alias("v"))
    return lambda s, k, at: lifted_97(s, k, at, "v").select(k, at, F.col("w").alias("v"))


def _inverse(reversible: bool):
    undo = signals.unlifted_53 if reversible else unlifted_97
    return lambda s, k, at: undo(s.withColumnRenamed("v", "w"), k, at).select(k, at, F.col("back").alias("v"))


def plane(raster: DataFrame, reversible: bool = True) -> DataFrame:
    """One level of the 5/3 or 9/7 transform of raster(name, y, x, v): columns, then rows; w and band of each place."""
    out = _lines(_lines(raster, "x", "y", _forward(reversible)), "y", "x", _forward(reversible))
    band = F.when(F.col("x") % 2 == 0, F.when(F.col("y") % 2 == 0, "LL").otherwise("LH")).otherwise(F.when(F.col("y") % 2 == 0, "HL").otherwise("HH"))
    return out.select("name", "y", "x", F.col("v").alias("w"), band.alias("band"))


def plane_53(raster: DataFrame) -> DataFrame:
    return plane(raster, True)


def unplane(waves: DataFrame, reversible: bool = True) -> DataFrame:
    """The inverse of plane, as raster(name, y, x, v): rows, then columns."""
    return _lines(_lines(waves.select("name", "y", "x", F.col("w").alias("v")), "y", "x", _inverse(reversible)), "x", "y", _inverse(reversible))


def pyramid(raster: DataFrame, levels: int, reversible: bool = True) -> DataFrame:
    """name, level (1 is the finest), band, y, x (places in the band) and w: each level splits the LL band of the one before it."""
    out, low = None, raster.select("name", "y", "x", "v")
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    for level in range(1, levels + 1):
        one = plane(low, reversible).select("name", F.lit(level).alias("level"), "band", half("y"), half("x"), "w")
        part = one if level == levels else one.where("band <> 'LL'")
        out = part if out is None else out.unionByName(part)
        low = one.where("band = 'LL'").select("name", "y", "x", F.col("w").alias("v"))
    return out


def unpyramid(bands: DataFrame, levels: int, reversible: bool = True) -> DataFrame:
    """The inverse of pyramid, as raster(name, y, x, v)."""
    low = bands.where((F.col("level") == levels) & (F.col("band") == "LL")).select("name", "y", "x", F.col("w").alias("v"))
    for level in range(levels, 0, -1):
        odd = lambda c, names: (F.col(c) * 2 + F.col("band").isin(names).cast("int")).alias(c)
        rest = bands.where((F.col("level") == level) & (F.col("band") != "LL")).select("name", odd("y", ["LH", "HH"]), odd("x", ["HL", "HH"]), "w")
        low = unplane(rest.unionByName(low.select("name", (F.col("y") * 2).alias("y"), (F.col("x") * 2).alias("x"), F.col("v").alias("w"))), reversible)
    return low


def around(raster: DataFrame, col: str) -> DataFrame:
    """raster(name, y, x, ...) with h, v2 and d: sums of col over the two horizontal, two vertical and four diagonal neighbours."""
    row, column = Window.partitionBy("name", "y").orderBy("x"), Window.partitionBy("name", "x").orderBy("y")
    both = lambda c, w: F.lag(c, 1, 0).over(w) + F.lead(c, 1, 0).over(w)
    return raster.withColumn("h", both(col, row)).withColumn("v2", both(col, column)).withColumn("d", both("h", column))


def zero_context(h: Column, v: Column, d: Column, band: str) -> Column:
    """The context of a sample that isn't significant yet, by the counts of its significant neighbours."""
    if band == "HH":
        s = h + v
        few = F.least(s, F.lit(2))
        return F.when(d >= 3, 8).when(d == 2, F.when(s >= 1, 7).otherwise(6)).when(d == 1, 3 + few).otherwise(few)
    if band == "HL":
        h, v = v, h
    one = F.when(v >= 1, 7).when(d >= 1, 6).otherwise(5)
    none = F.when(v == 2, 4).when(v == 1, 3).otherwise(F.least(d, F.lit(2)))
    return F.when(h == 2, 8).when(h == 1, one).otherwise(none)


def sign_context(h: Column, v: Column) -> tuple[Column, Column]:
    """Context and flip of a sign, by the sums of the signs of its significant horizontal and vertical neighbours."""
    a, b = F.signum(h).cast("int"), F.signum(v).cast("int")
    flip = (a < 0) | ((a == 0) & (b < 0))
    return F.when(a == 0, 9 + F.abs(b)).otherwise(12 + a * b), flip.cast("int")


def step_code(step: Column, depth: int) -> tuple[Column, Column]:
    """Exponent and 11-bit mantissa of a step size in a band of `depth` bits."""
    log = F.floor(F.log2(step))
    return (depth - log).cast("int"), F.floor((step / F.pow(F.lit(2.0), log) - 1) * 2048).cast("int")


def step_of(exponent: Column, mantissa: Column, depth) -> Column:
    """The step size that an exponent and a mantissa stand for in a band of `depth` bits."""
    return F.pow(F.lit(2.0), depth - exponent) * (1 + mantissa / 2048)


def derived_exponent(first: Column, levels: Column, level: Column) -> Column:
    """The exponent of a band at a decomposition level (the coarsest is `levels`), where only the first band's is said."""
    return (first - (levels - level)).cast("int")


def finalised(value: Column, bits: Column) -> Column:
    """Reconstructed values of `bits` bits, still around 0, as samples of 8 bits."""
    shifted = value + F.pow(F.lit(2.0), bits - 1)
    return color.clamp(F.floor(shifted / F.pow(F.lit(2.0), F.greatest(F.lit(0), bits - 8)) + 0.5), 0, 255).cast("int")


def upsampled(plane: DataFrame, width: int, height: int, across: int, down: int) -> DataFrame:
    """plane(y, x, v) at the size of the image by its nearest sample: across and down are the factors."""
    grid = plane.sparkSession.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    small = plane.select(F.col("y").alias("_y"), F.col("x").alias("_x"), "v")
    return grid.join(small, (F.floor(F.col("y") / down) == F.col("_y")) & (F.floor(F.col("x") / across) == F.col("_x"))).select("y", "x", "v")
