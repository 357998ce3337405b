"""Queries on whole images: coded, decoded and compared with the formula that their samples came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.codecs import segments
from pixelloom.operators import codec
from pixelloom.sources import streams

#: name, width, height of the fixtures.
SHAPES = [("wide", 24, 7), ("square", 16, 16), ("dot", 1, 1), ("tall", 1, 8)]
#: Of lossy coding at quality 100: a sample may be off by this much less one (colours by more, as both transforms round).
NEAR, CLOSE, CLOSE_COLOUR = 3, 3, 5


def fixtures(spark: SparkSession, components: int, bits: int) -> DataFrame:
    """Samples from their places alone: component 0 a ramp, 1 a ramp down, 2 stripes with steps."""
    top = (1 << bits) - 1
    shapes = spark.createDataFrame(SHAPES, "name string, w long, h long")
    places = shapes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") * F.col("h") - 1)).alias("i"))
    one = places.select("*", F.explode(F.sequence(F.lit(0), F.lit(components - 1))).alias("comp"))
    ramp = F.floor(F.col("i") * top / F.greatest(F.lit(1), F.col("w") * F.col("h") - 1))
    v = F.when(F.col("comp") == 0, ramp).when(F.col("comp") == 1, top - ramp).otherwise(F.floor(F.col("i") / 5) * 37 % (top + 1))
    return one.select("name", F.col("comp").cast("int").alias("comp"), F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), v.cast("int").alias("v"))


def _back(spark: SparkSession, components: int, bits: int, name: str, **options) -> DataFrame:
    coded = codec.encode(codec.images(fixtures(spark, components, bits), bits), name, **options)
    return codec.samples(codec.decode(coded.select("name", "content")), "name")


def _lossless(components: int, bits: int, **options):
    return lambda spark, sf_dir: _back(spark, components, bits, "jpegls", **options)


def _lossy(components: int, **options):
    def query(spark, sf_dir):
        """How many samples come back, and how many of them within the bound."""
        was = fixtures(spark, components, 8)
        both = was.join(_back(spark, components, 8, "jpeg", quality=100, **options).withColumnRenamed("v", "got"), ["name", "comp", "y", "x"], "full")
        return both.groupBy("name").agg(F.count("*").alias("n"), F.count(F.when(F.abs(F.col("v") - F.col("got")) < (CLOSE if components == 1 else CLOSE_COLOUR), 1)).alias("close"))

    return query


def jpegls_near_bound(spark, sf_dir):
    both = fixtures(spark, 3, 8).join(_back(spark, 3, 8, "jpegls", near=NEAR, layout="line").withColumnRenamed("v", "got"), ["name", "comp", "y", "x"], "full")
    return both.groupBy("name").agg(F.count("*").alias("n"), F.coalesce(F.max(F.abs(F.col("v") - F.col("got"))) <= NEAR, F.lit(False)).alias("within"))


def transcode_jpeg_to_jpegls(spark, sf_dir):
    """Samples that differ between a lossy stream and its lossless copy: none."""
    lossy = codec.encode(codec.images(fixtures(spark, 3, 8)), "jpeg", quality=75).select("name", "content")
    copy = codec.samples(codec.decode(codec.transcode(lossy, "jpegls", layout="sample")), "name").withColumnRenamed("v", "got")
    both = codec.samples(codec.decode(lossy), "name").join(copy, ["name", "comp", "y", "x"], "full")
    return both.groupBy("name").agg(F.count("*").alias("n"), F.count(F.when(~F.col("v").eqNullSafe(F.col("got")), 1)).alias("different"))


def _streams(spark: SparkSession) -> DataFrame:
    """Two coded fixtures, a wavelet header bare and in a file, and bytes that are wrong in three ways."""
    gray = codec.images(fixtures(spark, 1, 8)).where("name = 'square'")
    a = codec.encode(gray, "jpegls").select(F.lit("a").alias("file"), "content")
    b = codec.encode(gray, "jpeg").select(F.lit("b").alias("file"), "content")
    bare = segments.wavelet_header_bytes(300, 200, 3, 12, 5, True)
    whole = segments.JP2_SIGNATURE + segments.box("ftyp", b"jp2 \0\0\0\0jp2 ") + segments.box("jp2h", segments.box("colr", b"\2\0\0profile")) + segments.box("jp2c", bare)
    rest = spark.createDataFrame([("c", bare), ("d", whole), ("e", b"no image"), ("f", b"\xff\xd8\xff\xf7\x00"), ("g", None)], "file string, content binary")
    return a.unionByName(b).unionByName(rest)


def format_detect(spark, sf_dir):
    return _streams(spark).select("file", F.coalesce(streams.format_of("content"), F.lit("unknown")).alias("format"))


def image_info(spark, sf_dir):
    return streams.image_info(_streams(spark)).select("file", "format", "width", "height", "components", "bits", F.col("error").isNull().alias("ok"))


def marker_segments(spark, sf_dir):
    return streams.marker_segments(_streams(spark).where("file IN ('a', 'b')"), "file").select("file", "seq", "marker")


def jp2_boxes(spark, sf_dir):
    return streams.jp2_boxes(_streams(spark).where("file = 'd'"), "file").select("file", "box", "size")


def batch_decode_report(spark, sf_dir):
    return codec.report(codec.decode(_streams(spark)), "file").select("file", "status")


QUERIES = {
    "jpegls_roundtrip_gray8": _lossless(1, 8),
    "jpegls_roundtrip_gray16": _lossless(1, 16),
    "jpegls_roundtrip_rgb_planar": _lossless(3, 8, layout="none"),
    "jpegls_roundtrip_rgb_line": _lossless(3, 8, layout="line"),
    "jpegls_roundtrip_rgb_sample": _lossless(3, 8, layout="sample"),
    "jpegls_near_bound": jpegls_near_bound,
    "jpeg_roundtrip_gray": _lossy(1),
    "jpeg_roundtrip_restart": _lossy(1, restart=2),
    "jpeg_roundtrip_rgb": _lossy(3),
    "jpeg_roundtrip_planar": _lossy(3, planar=True),
    "transcode_jpeg_to_jpegls": transcode_jpeg_to_jpegls,
    "format_detect": format_detect,
    "image_info": image_info,
    "marker_segments": marker_segments,
    "jp2_boxes": jp2_boxes,
    "batch_decode_report": batch_decode_report,
}


def _made(components: int, bits: int) -> str:
    top = (1 << bits) - 1
    shapes = ", ".join(f"('{n}', {w}, {h})" for n, w, h in SHAPES)
    return f"""SELECT name, comp, (i // w)::INT AS y, (i % w)::INT AS x, (CASE comp WHEN 0 THEN i * {top} // greatest(1, w * h - 1) WHEN 1 THEN {top} - i * {top} // greatest(1, w * h - 1) ELSE i // 5 * 37 % {top + 1} END)::INT AS v
FROM (SELECT name, w, h, unnest(range(w * h)) AS i FROM (VALUES {shapes}) s(name, w, h)), (SELECT range::INT AS comp FROM range({components}))"""


def _counted(components: int, column: str, value: str) -> str:
    return f"SELECT name, count(*) AS n, {value} AS {column} FROM ({_made(components, 8)}) GROUP BY name"


ORACLES = {
    **{f"jpegls_roundtrip_{k}": _made(n, b) for k, n, b in (("gray8", 1, 8), ("gray16", 1, 16), ("rgb_planar", 3, 8), ("rgb_line", 3, 8), ("rgb_sample", 3, 8))},
    **{f"jpeg_roundtrip_{k}": _counted(n, "close", "count(*)") for k, n in (("gray", 1), ("restart", 1), ("rgb", 3), ("planar", 3))},
    "jpegls_near_bound": _counted(3, "within", "true"),
    "transcode_jpeg_to_jpegls": _counted(3, "different", "0::BIGINT"),
    "format_detect": "SELECT * FROM (VALUES ('a', 'jpeg'), ('b', 'jpeg'), ('c', 'j2k'), ('d', 'jp2'), ('e', 'unknown'), ('f', 'jpeg'), ('g', 'unknown')) t(file, format)",
    "image_info": """SELECT file, format, width::BIGINT AS width, height::BIGINT AS height, components::BIGINT AS components, bits::BIGINT AS bits, ok FROM (VALUES ('a', 'jpegls', 16, 16, 1, 8, true), ('b', 'jpeg', 16, 16, 1, 8, true),
('c', 'j2k', 300, 200, 3, 12, true), ('d', 'jp2', 300, 200, 3, 12, true), ('e', NULL, NULL, NULL, NULL, NULL, false), ('f', NULL, NULL, NULL, NULL, NULL, false), ('g', NULL, NULL, NULL, NULL, NULL, false)) t(file, format, width, height, components, bits, ok)""",
    "marker_segments": """SELECT file, seq::BIGINT AS seq, marker FROM (VALUES ('a', 0, 'SOI'), ('a', 1, 'SOF55'), ('a', 2, 'SOS'), ('a', 3, 'EOI'),
('b', 0, 'SOI'), ('b', 1, 'DQT'), ('b', 2, 'SOF0'), ('b', 3, 'DHT'), ('b', 4, 'DHT'), ('b', 5, 'SOS'), ('b', 6, 'EOI')) t(file, seq, marker)""",
    "jp2_boxes": "SELECT 'd' AS file, box, size::BIGINT AS size FROM (VALUES ('jP  ', 12), ('ftyp', 20), ('jp2h', 26), ('colr', 18), ('jp2c', 96)) t(box, size)",
    "batch_decode_report": "SELECT * FROM (VALUES ('a', 'OK'), ('b', 'OK'), ('c', 'ERROR'), ('d', 'ERROR'), ('e', 'ERROR'), ('f', 'ERROR'), ('g', 'ERROR')) t(file, status)",
}
