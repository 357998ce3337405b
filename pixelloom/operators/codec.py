"""Whole-image coding as DataFrame operators: one row an image, coded where it lies, without a shuffle.

An image is width, height, components, bits and pixels: interleaved samples, row by row, one byte each up to 8 bits and
two (little-endian) above. Null or wrong input gives null results and a text in `error`; rows are never dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.codecs import jpeg, jpegls, lossless, segments, wavelet
from pixelloom.sources import streams

IMAGE = "pixels binary, width long, height long, components long, bits long, error string"


def array_of(pixels: bytes, width: int, height: int, components: int, bits: int) -> np.ndarray:
    """Raises ValueError where the bytes are not as many as the geometry says."""
    return np.frombuffer(pixels, "u1" if bits <= 8 else "<u2").reshape(int(height), int(width), int(components))


def bytes_of(samples: np.ndarray, bits: int) -> bytes:
    return samples.astype("u1" if bits <= 8 else "<u2").tobytes()


def decode_one(data: bytes) -> tuple[np.ndarray, int]:
    found = segments.kind(data)
    if found == "jpegls":
        return jpegls.decode(data)
    if found == "jpeg":
        return jpeg.decode(data)
    if found in ("jp2", "j2k"):
        return wavelet.decode(data)
    raise ValueError(f"{found} can't be decoded")


def encode_one(samples: np.ndarray, bits: int, codec: str, **options) -> bytes:
    if codec == "jpegls":
        return jpegls.encode(samples, bits, **options)
    if codec == "jpeg":
        if bits != 8:
            raise ValueError("samples of 8 bits are needed")
        return jpeg.encode(samples.astype(np.uint8), **options)
    if codec == "jpeg_lossless":
        return lossless.encode(samples, bits, **options)
    if codec in ("j2k", "jp2"):
        return wavelet.encode(samples, bits, boxed=codec == "jp2", **options)
    raise ValueError(f"unknown codec {codec}")


def _schema(kept: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), more])


def encode(images: DataFrame, codec: str, **options) -> DataFrame:
    """images with content and error added. Options: quality, restart, planar, progressive (jpeg); predictor, shift, restart_lines (jpeg_lossless);

    near, layout, given, spiff (jpegls); levels, reversible, step, tile, progression, block, precinct (j2k and jp2).
    """
    kept = images.drop("content", "error")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shapes = zip(pdf["width"], pdf["height"], pdf["components"], pdf["bits"], strict=True)
            done = [streams.guarded(lambda p, g=g: encode_one(array_of(p, *g), int(g[3]), codec, **options), p) for g, p in zip(shapes, pdf["pixels"], strict=True)]
            yield pdf.assign(content=[d for d, _ in done], error=[e for _, e in done])

    return kept.mapInPandas(run, _schema(kept, "content binary, error string"))


def decode(streams_: DataFrame, content: str = "content") -> DataFrame:
    """streams_ with pixels, width, height, components, bits and error added (or replaced)."""
    names = [c.split()[0] for c in IMAGE.split(", ")]
    kept = streams_.drop(*names)

    def one(data: bytes) -> tuple:
        samples, bits = decode_one(data)
        h, w, n = samples.shape
        return bytes_of(samples, bits), w, h, n, bits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [streams.guarded(one, d) for d in pdf[content]]
            more = pd.DataFrame([(*(got or [None] * 5), error) for got, error in done], columns=names, index=pdf.index).astype(object)
            for c in names[1:5]:
                more[c] = more[c].astype("Int64")
            yield pd.concat([pdf, more], axis=1)

    return kept.mapInPandas(run, _schema(kept, IMAGE))


def transcode(streams_: DataFrame, codec: str, content: str = "content", **options) -> DataFrame:
    """streams_ with its content decoded and coded again, in one pass; the old content goes, bytes that fail give null and an error."""
    kept = streams_.drop("error")

    def one(data: bytes) -> bytes:
        samples, bits = decode_one(data)
        return encode_one(samples, bits, codec, **options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [streams.guarded(one, d) for d in pdf[content]]
            yield pdf.assign(**{content: [d for d, _ in done], "error": [e for _, e in done]})

    return kept.mapInPandas(run, _schema(kept, "error string"))


def report(decoded: DataFrame, key: str) -> DataFrame:
    """One row an input: OK or ERROR, and why."""
    return decoded.select(key, F.when(F.col("error").isNull(), "OK").otherwise("ERROR").alias("status"), "error")


def success_rates(reported: DataFrame, by: str) -> DataFrame:
    """For each value of `by`: files, how many were decoded, and their share."""
    ok = F.count(F.when(F.col("status") == "OK", 1))
    return reported.groupBy(by).agg(F.count("*").alias("n"), ok.alias("n_ok"), (ok / F.count("*")).alias("rate"))


def status_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two reports side by side, also of files that only one has: key, status_a, status_b and whether they agree."""
    one, other = (r.select(key, F.col("status").alias(f"status_{k}")) for k, r in (("a", a), ("b", b)))
    return one.join(other, key, "full").withColumn("agree", F.col("status_a").eqNullSafe(F.col("status_b")))


def sizes(coded: DataFrame) -> DataFrame:
    """Images with their content, and raw_bytes, coded_bytes and ratio."""
    raw = F.col("width") * F.col("height") * F.col("components") * F.when(F.col("bits") > 8, 2).otherwise(1)
    return coded.withColumn("raw_bytes", raw.cast("long")).withColumn("coded_bytes", F.length("content").cast("long")).withColumn("ratio", F.col("raw_bytes") / F.col("coded_bytes"))


def samples(images: DataFrame, key: str) -> DataFrame:
    """One row a sample: key, comp, y, x, v; images without pixels have none. An image is laid out at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, p, w, h, n, bits in pdf.itertuples(index=False, name=None):
                if p is None or not len(p):
                    continue
                v = array_of(p, w, h, n, bits)
                y, x, c = np.indices(v.shape)
                yield pd.DataFrame({key: [k] * v.size, "comp": c.ravel().astype(np.int32), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "v": v.ravel().astype(np.int32)})

    own = images.select(key, "pixels", "width", "height", "components", "bits")
    return own.mapInPandas(run, f"`{key}` {images.schema[key].dataType.simpleString()}, comp int, y int, x int, v int")


def images(raster: DataFrame, bits: int = 8) -> DataFrame:
    """Images of raster(name, comp, y, x, v), all samples there; a row of an image is put together first, then the rows."""
    half = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    v = F.col("v").cast("long")
    one = half(v) if bits <= 8 else F.concat(half(v % 256), half(F.shiftright(v, 8)))
    joined = lambda names, col: F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*names, col))), lambda s: F.hex(s[col])), ""))
    rows = raster.withColumn("_b", one).groupBy("name", "y").agg(joined(["x", "comp"], "_b").alias("_r"), (F.max("x") + 1).alias("_w"), (F.max("comp") + 1).alias("_n"))
    whole = rows.groupBy("name").agg(joined(["y"], "_r").alias("pixels"), F.max("_w").alias("width"), (F.max("y") + 1).alias("height"), F.max("_n").alias("components"))
    return whole.select("name", *(F.col(c).cast("long") for c in ("width", "height", "components")), F.lit(bits).cast("long").alias("bits"), "pixels")
