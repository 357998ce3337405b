"""The library in SQL: functions, table functions and a data source, registered with one call.

`register(spark)` adds
* `image_decode(content)`: a struct of pixels, width, height, components, bits and error;
* `image_encode(pixels, width, height, components, bits, codec)`: the stream, null where it can't be made;
* the table functions `jpeg_segments(content)` and `jp2_boxes(content)`, for LATERAL joins;
* the data source `pixelloom_images`: the decoded images of a folder, or of its files with one of the given `extensions`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pixelloom.codecs import segments
from pixelloom.operators import codec
from pixelloom.sources import sinks, streams

DECODED = "pixels binary, width long, height long, components long, bits long, error string"


def _decoded(data: bytes | None) -> tuple:
    got, error = streams.guarded(codec.decode_one, data)
    if error:
        return (None, None, None, None, None, error)
    samples, bits = got
    height, width, n = samples.shape
    return (codec.bytes_of(samples, bits), width, height, n, bits, None)


def _encoded(pixels: bytes | None, width: int, height: int, components: int, bits: int, name: str) -> bytes | None:
    if None in (width, height, components, bits, name):
        return None
    return streams.guarded(lambda p: codec.encode_one(codec.array_of(p, width, height, components, bits), int(bits), name), pixels)[0]


class JpegSegments:
    def eval(self, content: bytes):
        got, _ = streams.guarded(lambda d: [(i, at, segments.name_of(c), len(p)) for i, (at, c, p) in enumerate(segments.walk(d))], content)
        yield from got or ()


class Jp2Boxes:
    def eval(self, content: bytes):
        got, _ = streams.guarded(lambda d: [(i, at, n, size) for i, (at, n, size, _) in enumerate(segments.boxes(d))], content)
        yield from got or ()


class FileRange(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class ImageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.extensions = tuple(e for e in options.get("extensions", "").split(",") if e)
        self.files = int(options.get("filesperpartition", "64"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(x.path for x in found if x.is_file and not x.base_name.startswith((".", "_")) and x.base_name.endswith(self.extensions or ""))
        return [FileRange(names[i : i + self.files]) for i in range(0, len(names), self.files)]

    def read(self, partition: FileRange) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.uri)
        for name in partition.names:
            with store.open_input_stream(name, compression=None) as f:
                data = f.read()
            yield (name, segments.kind(data), *_decoded(data))


class ImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pixelloom_images"

    def schema(self) -> str:
        return f"path string, format string, {DECODED}"

    def reader(self, schema) -> DataSourceReader:
        return ImageReader(self.options)


def register(spark: SparkSession) -> None:
    @F.pandas_udf(DECODED)
    def image_decode(content: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([_decoded(d) for d in content], columns=[c.split()[0] for c in DECODED.split(", ")]).astype(object)
        for c in ("width", "height", "components", "bits"):
            out[c] = out[c].astype("Int64")
        return out

    @F.pandas_udf("binary")
    def image_encode(pixels: pd.Series, width: pd.Series, height: pd.Series, components: pd.Series, bits: pd.Series, name: pd.Series) -> pd.Series:
        rows = zip(*(s.astype(object).where(s.notna(), None) for s in (pixels, width, height, components, bits, name)), strict=True)
        return pd.Series([_encoded(*r) for r in rows], dtype=object)

    spark.udf.register("image_decode", image_decode)
    spark.udf.register("image_encode", image_encode)
    spark.udtf.register("jpeg_segments", F.udtf(JpegSegments, returnType="seq int, place long, marker string, size long"))
    spark.udtf.register("jp2_boxes", F.udtf(Jp2Boxes, returnType="seq int, place long, box string, size long"))
    spark.dataSource.register(ImageSource)


def images(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ()) -> object:
    """The data source over a folder that Spark names."""
    return spark.read.format("pixelloom_images").option("extensions", ",".join(extensions)).load(sinks.qualified(spark, folder))
