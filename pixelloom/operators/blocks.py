"""Operators on tables of 8x8 blocks (one row for each, its 64 samples in an array): transforms, quantisation, scans.

All are expressions over the array of a row or explode it, but for the transform, a matrix product of Arrow batches;
nothing is shuffled but for aggregates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import color, fixed


def basis(u: int, x: int) -> float:
    return (math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16)


def coefficients(df: DataFrame, id: str, block: str, inverse: bool = False) -> DataFrame:
    """id, pos (row-major) and coef of each block: a batch of blocks is one product with the constant matrix; null blocks have none."""
    line = np.array([[basis(u, x) for x in range(8)] for u in range(8)])
    whole = np.kron(line, line)  # rows: places of coefficients, columns: places of samples
    matrix = whole if inverse else whole.T

    @F.pandas_udf("array<double>")
    def product(blocks: pd.Series) -> pd.Series:
        out = np.empty(len(blocks), object)
        some = np.flatnonzero(blocks.notna())
        if len(some):
            for k, row in zip(some, np.stack(blocks.iloc[some].to_numpy()) @ matrix, strict=True):
                out[k] = row
        return pd.Series(out)

    return df.select(id, F.posexplode(product(F.col(block).cast("array<double>"))).alias("pos", "coef"))


def fixed_point_inverse(df: DataFrame, id: str, block: str) -> DataFrame:
    """id, pos and v of each block of coefficients, in whole numbers: twelve bits of cosine, eight of input, each product shifted down; a batch of blocks at once."""
    angle = np.float32(np.pi) * np.arange(8, dtype=np.float32)[None, :] * (2 * np.arange(8, dtype=np.float32)[:, None] + 1) / np.float32(16)
    cosine = (np.cos(angle) * np.float32(4096)).astype(np.int64)  # place by frequency
    scale = np.where(np.arange(8) == 0, 2896, 4096)

    def one_pass(values: np.ndarray) -> np.ndarray:
        """Along the last axis."""
        return ((values * scale >> 12)[..., None, :] * cosine >> 12).sum(-1)

    @F.pandas_udf("array<double>")
    def samples(blocks: pd.Series) -> pd.Series:
        out = np.empty(len(blocks), object)
        some = np.flatnonzero(blocks.notna())
        if len(some):
            given = np.trunc(np.stack(blocks.iloc[some].to_numpy()) * 256).astype(np.int64).reshape(-1, 8, 8)
            whole = one_pass(one_pass(given).swapaxes(1, 2)).swapaxes(1, 2).reshape(-1, 64) / 1024
            for k, row in zip(some, whole, strict=True):
                out[k] = row
        return pd.Series(out)

    return df.select(id, F.posexplode(samples(F.col(block).cast("array<double>"))).alias("pos", "v"))


def quantised(coef: DataFrame, table: list[int], value: str = "coef") -> DataFrame:
    """level (rounded, halves away from zero) and recon of each coefficient."""
    q = F.get(F.array(*map(F.lit, table)), F.col("pos"))
    level = (F.signum(value) * F.floor(F.abs(value) / q + 0.5)).cast("int")
    return coef.withColumn("level", level).withColumn("recon", (level * q).cast("double"))


def scanned(levels: DataFrame) -> DataFrame:
    """The zig-zag place of each level."""
    order = fixed.zigzag()
    place = F.array(*(F.lit(order.index(p)) for p in range(64)))
    return levels.withColumn("k", F.get(place, F.col("pos")))


def zero_runs(scan: DataFrame, id: str) -> DataFrame:
    """Each level other than 0 after the first place with the zeros before it, and its magnitude's bits."""
    last = F.lag("k", 1, 0).over(Window.partitionBy(id).orderBy("k"))
    some = scan.where("k > 0 AND level <> 0")
    return some.select(id, "k", "level", (F.col("k") - last - 1).alias("run"), color.category(F.col("level")).alias("ssss"))


def run_symbols(scan: DataFrame, id: str) -> DataFrame:
    """The coded symbols of each block's places after the first: zrl (runs of 16 zeros before it) and symbol (rest of the run, magnitude's bits); symbol 0 with k 64 ends a block whose last place is 0."""
    some = zero_runs(scan, id)
    coded = some.select(id, "k", F.floor(F.col("run") / 16).cast("int").alias("zrl"), (F.col("run") % 16 * 16 + F.col("ssss")).cast("int").alias("symbol"))
    last = scan.where("k = 63 AND level = 0").select(id, F.lit(64).alias("k"), F.lit(0).alias("zrl"), F.lit(0).alias("symbol"))
    return coded.unionByName(last)
