"""Encoded still images as tables: files in, and what their headers say, without decoding pixels.

Every operator keeps one row for each input row or says in `error` why it can't; null bytes give the error 'no bytes'.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.codecs import segments, wavelet

INFO = "format string, width long, height long, components long, bits long, error string"


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path and content of all files under a folder (but empty ones, which Spark's reader passes over)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: files that arrive later are read as they come."""
    schema = spark.read.format("binaryFile").load(path).schema
    return spark.readStream.format("binaryFile").schema(schema).load(path).select("path", "content")


def guarded(f: Callable, data: bytes | None):
    """(f of the bytes, None), or (None, what is wrong with them)."""
    try:
        return (f(bytes(data)), None) if data is not None else (None, "no bytes")
    except Exception as e:  # struct.error and the like: a corrupt row must not end the job
        return None, f"{type(e).__name__}: {e}"[:200]


def image_info(df: DataFrame, content: str = "content") -> DataFrame:
    """df with format, width, height, components, bits and error; its other columns of these names are replaced."""
    names = [c.split()[0] for c in INFO.split(", ")]
    kept = df.drop(*names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [guarded(segments.info, d) for d in pdf[content]]
            more = pd.DataFrame([{**(got or {}), "error": error} for got, error in found], columns=names, index=pdf.index).astype(object)
            for c in names[1:5]:
                more[c] = more[c].astype("Int64")
            yield pd.concat([pdf, more], axis=1)

    return kept.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), INFO]))


def listed(df: DataFrame, key: str, content: str, row: Callable[[bytes], list[tuple]], columns: str) -> DataFrame:
    """key and the columns of row(bytes) for each of its tuples; bytes that it refuses give one row with an error."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for k, data in zip(pdf[key], pdf[content], strict=True):
                got, error = guarded(row, data)
                out += [(k, *t, None) for t in got] if error is None else [(k, *[None] * len(names), error)]
            if not out:
                continue
            frame = pd.DataFrame(out, columns=[key, *names, "error"])
            for c, kind in (x.split() for x in columns.split(", ")):
                if kind == "long":
                    frame[c] = frame[c].astype("Int64")
            yield frame

    return df.select(key, content).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {columns}, error string")


def marker_segments(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row for each marker segment: its number, place, name and payload size."""
    return listed(df, key, content, lambda d: [(i, at, segments.name_of(c), len(p)) for i, (at, c, p) in enumerate(segments.walk(d))], "seq long, place long, marker string, size long")


def jp2_boxes(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row for each box at top level and in the header box."""
    return listed(df, key, content, lambda d: [(i, at, n, s) for i, (at, n, s, _) in enumerate(segments.boxes(d))], "seq long, place long, box string, size long")


def format_of(content: str) -> Column:
    """The format by the first bytes alone, as an expression that Spark runs itself: jp2, j2k, jpeg (either kind) or unknown."""
    head = F.hex(F.substring(F.col(content), 1, 12))
    return (
        F.when(head == segments.JP2_SIGNATURE.hex().upper(), "jp2").when(head.startswith("FF4FFF51"), "j2k").when(head.startswith("FFD8"), "jpeg").otherwise("unknown")
    )


def spiff_headers(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """The SPIFF header of each stream that has one: its fields, valid (it says T.87 coding) and fits (it agrees with the frame)."""
    names = segments.SPIFF_FIELDS
    row = lambda d: [(*(h[n] for n in names), h["valid"], h["fits"]) for h in [segments.spiff_header(d)] if h]
    return listed(df, key, content, row, ", ".join(f"{n} long" for n in names) + ", valid boolean, fits boolean")


def preset_parameters(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row for each segment of preset coding parameters."""
    row = lambda d: [got for _, c, p in segments.walk(d) if c == segments.LSE and (got := segments.presets(p))]
    return listed(df, key, content, row, "top long, t1 long, t2 long, t3 long, reset long")


def tile_parts(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row for each tile part of a wavelet codestream, bare or in a file of boxes."""
    return listed(df, key, content, segments.tile_parts, "place long, tile long, part long, parts long, size long, packets_at long")


def codestream_markers(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row for each marker of a wavelet codestream."""
    row = lambda d: [(i, *t) for i, t in enumerate(segments.codestream_markers(d))]
    return listed(df, key, content, row, "seq long, place long, marker string, size long")


def wavelet_styles(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """What a codestream's main header says: geometry, coding style, quantisation, region shifts, and whether it is high-throughput."""
    names = ("width", "height", "components", "bits", "tiles", "progression", "layers", "colour_transform", "levels", "quantisation", "guard_bits")

    def row(data: bytes) -> list[tuple]:
        head = segments.wavelet_header(data)
        return [(*(head.get(n) for n in names), head.get("reversible"), head["high_throughput"], len(head.get("steps", [])), max(head.get("shifts", {}).values(), default=0))]

    return listed(df, key, content, row, ", ".join(f"{n} long" for n in names) + ", reversible boolean, high_throughput boolean, steps long, shift long")


def icc_profiles(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """The embedded colour profile of each file that has one."""
    return listed(df, key, content, lambda d: [(p,) for p in [segments.profile(d)] if p is not None], "profile binary")


def code_blocks(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row for each code-block of a codestream: its place, and the coding passes and bytes that its packets include."""
    columns = "tile long, component long, resolution long, band string, y long, x long, height long, width long, passes long, bytes long"
    return listed(df, key, content, wavelet.code_blocks, columns)


def raw_images(df: DataFrame, width: int, height: int, components: int, bits: int = 8, content: str = "content") -> DataFrame:
    """Raw samples of a given geometry as images: bytes that are too few give an error, what is beyond them is left out."""
    need = width * height * components * (2 if bits > 8 else 1)
    enough = F.length(content) >= need
    geometry = [F.lit(v).cast("long").alias(k) for k, v in (("width", width), ("height", height), ("components", components), ("bits", bits))]
    error = F.when(F.col(content).isNull(), "no bytes").when(~enough, F.format_string(f"%d bytes, {need} are needed", F.length(content)))
    return df.select("*", *geometry, F.when(enough, F.substring(F.col(content), 1, need)).alias("pixels"), error.alias("error"))


#: What the library codes and decodes.
CODECS = [
    ("jpeg", "ITU-T T.81", "baseline, extended, progressive, lossless", True, True),
    ("jpegls", "ITU-T T.87", "lossless, near-lossless", True, True),
    ("j2k", "ITU-T T.800", "5/3 and 9/7 wavelets, tiles, layers, regions", True, True),
    ("jp2", "ITU-T T.800", "boxes around the same", True, True),
]


def codecs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODECS, "codec string, standard string, modes string, encode boolean, decode boolean")
