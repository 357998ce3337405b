"""Queries on wavelet, progressive and lossless streams, headers, sinks and the wavelet planes, and their equivalents."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.codecs import arithmetic, jpegls, quads, segments, wavelet
from pixelloom.functions import color, fixed
from pixelloom.operators import bands, blocks, codec, planes, signals
from pixelloom.sources import extension, sinks, streams

from . import images

LEVELS, TILE = 2, 8
PREDICTORS = range(1, 8)
PRESETS = (255, 9, 20, 40, 31)
#: The worked example of T.87 (its samples and its whole stream).
EXAMPLE = [0, 0, 90, 74, 68, 50, 43, 205, 64, 145, 145, 145, 100, 145, 145, 145]
EXAMPLE_STREAM = "FFD8FFF7000B080004000401011100FFDA0008010100000000C000006C80208E01C00000574000006EE6000001BC18000005D800009160FFD9"
#: The test sequence of the arithmetic coder (T.88) and its code.
SEQUENCE = "00020051000000C0035287" + "2AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF"
CODED = "84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADF"
#: A lossless scan made by hand, 2 x 2 samples: table with codes of 1, 2 and 3 bits, and data.
BY_HAND = b"\xff\xd8" + segments.segment(0xC3, segments.frame_bytes(8, 2, 2, [(1, 1, 1, 0)])) + segments.segment(0xC4, bytes([0, 1, 1, 1, *[0] * 13, 0, 2, 3])) + segments.segment(0xDA, bytes([1, 1, 0, 1, 0, 0])) + b"\x53\x40\xff\xd9"
#: name, width, height, components, bits and pattern of the golden images of lossless coding.
GOLDEN = [
    *((f"tiny_8x8_gray_{p}", 8, 8, 1, 8, p) for p in ("gradient", "noise", "checker", "solid")),
    *((f"{n}_{w}x{h}_gray_gradient", w, h, 1, 8, "gradient") for n, w, h in (("small", 16, 16), ("small", 32, 32), ("medium", 64, 64), ("medium", 128, 128), ("large", 256, 256), ("rect", 16, 32), ("rect", 32, 16))),
    *((f"{n}_{s}x{s}_rgb_{p}", s, s, 3, 8, p) for n, s, p in (("tiny", 8, "gradient"), ("small", 16, "gradient"), ("small", 32, "gradient"), ("medium", 64, "gradient"), ("small", 16, "noise"), ("small", 16, "checker"))),
    *((f"small_{s}x{s}_gray16_gradient", s, s, 1, 16, "gradient") for s in (16, 32)),
    ("edge_1x1_gray", 1, 1, 1, 8, "solid"), ("edge_1x8_gray", 1, 8, 1, 8, "gradient"), ("edge_8x1_gray", 8, 1, 1, 8, "gradient"),
]
#: Bytes of the lossless streams of the fixtures in images.SHAPES; the standard leaves a coder no choice.
CODED_BYTES = {"dot": 28, "square": 76, "tall": 38, "wide": 73}
SHIFTS = [(v, b) for b in (1, 4, 8, 10, 12, 16) for v in (-70000, -2048, -128, -1, 0, 1, 7, 127, 128, 511, 2047, 32767)]
WRONG_PRESETS = [(8, 0, (255, 3, 7, 21, 64)), (8, 0, (300, 3, 7, 21, 64)), (8, 2, (255, 2, 7, 21, 64)), (8, 0, (255, 9, 7, 21, 64)), (8, 0, (255, 3, 7, 300, 64)), (8, 0, (255, 3, 7, 21, 2)), (8, 0, (0, 0, 0, 0, 0)), (12, 100, (4095, 400, 500, 600, 4095)), (8, 200, (255, 0, 0, 0, 0))]
RUNS = "20"


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def golden(spark: SparkSession) -> DataFrame:
    """The golden images as raster(name, comp, y, x, v), with their bits."""
    cases = spark.createDataFrame(GOLDEN, "name string, w long, h long, n int, bits int, pattern string")
    one = cases.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") * F.col("h") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("comp"))
    top = F.when(F.col("bits") == 16, 65535).otherwise(255).cast("long")
    y, x = F.floor(F.col("i") / F.col("w")), F.col("i") % F.col("w")
    ramp = lambda i: F.floor(i * top / F.greatest(F.lit(1), F.col("w") * F.col("h") - 1))
    gradient = F.when(F.col("comp") == 0, ramp(F.col("i"))).when(F.col("comp") == 1, ramp(x * F.col("w") + y)).otherwise(F.floor(top / 2))
    noise = (F.col("i") * F.col("i") * 7 + F.col("i") * 13 + F.col("comp") * 101) % (top + 1)
    v = F.when(F.col("pattern") == "gradient", gradient).when(F.col("pattern") == "noise", noise).when(F.col("pattern") == "checker", F.when(y % 2 == x % 2, top).otherwise(0)).otherwise(F.floor(top / 2))
    return one.select("name", "bits", "comp", y.cast("int").alias("y"), x.cast("int").alias("x"), v.cast("int").alias("v"))


def _gray(spark: SparkSession) -> DataFrame:
    return codec.images(images.fixtures(spark, 1, 8))


def _headed(spark: SparkSession) -> DataFrame:
    """Streams with headers of all kinds: T.87 with SPIFF and presets, wavelets bare, tiled and in boxes, with a profile, a region and a capability."""
    square = _gray(spark).where("name = 'square'")
    made = [
        codec.encode(square, "jpegls", given=PRESETS, spiff=True).select(F.lit("ls").alias("file"), "content"),
        codec.encode(square, "j2k", levels=LEVELS, tile=TILE).select(F.lit("tiled").alias("file"), "content"),
        codec.encode(square, "jp2", levels=1, reversible=False).select(F.lit("boxed").alias("file"), "content"),
    ]
    bare = segments.wavelet_header_bytes(300, 200, 3, 12, 5, True)
    more = segments.segment(0x50, bytes([0, 2, 0, 0])) + segments.segment(0x5E, bytes([0, 0, 7]))
    capable = bare[:-2] + more + bare[-2:]
    profiled = segments.JP2_SIGNATURE + segments.box("jp2h", segments.box("colr", b"\2\0\0profile")) + segments.box("jp2c", bare)
    rest = spark.createDataFrame([("capable", capable), ("profiled", profiled), ("empty", b""), ("none", None)], "file string, content binary")
    return _union([*made, rest])


def build(embedded: Callable, levels: Callable, raster: Callable, rgb: Callable, signal: Callable) -> dict[str, Callable]:
    """The queries over the catalogue's inputs."""

    def j2k_roundtrip_53(spark, sf_dir):
        return images._back(spark, 3, 8, "j2k", levels=3)

    def j2k_roundtrip_53_gray16(spark, sf_dir):
        return images._back(spark, 1, 16, "jp2", levels=LEVELS)

    def j2k_roundtrip_97_fine(spark, sf_dir):
        """Lossy coding with steps so small that rounding gives each sample back."""
        return images._back(spark, 3, 8, "j2k", levels=LEVELS, reversible=False, step=1 / 32)

    def j2k_roundtrip_97_psnr(spark, sf_dir):
        both = images.fixtures(spark, 3, 8).join(images._back(spark, 3, 8, "j2k", levels=3, reversible=False, step=0.5).withColumnRenamed("v", "got"), ["name", "comp", "y", "x"], "full")
        return signals.compared(both, "name", "v", "got", 255).select("name", (F.col("max_diff") <= 2).alias("near"), (F.col("psnr") > 45).alias("over_45"))

    def j2k_tiles_progressions(spark, sf_dir):
        each = (images._back(spark, 3, 8, "j2k", levels=LEVELS, tile=TILE, block=2, precinct=3, progression=p).withColumn("progression", F.lit(p)) for p in wavelet.PROGRESSIONS)
        return _union(each)

    def j2k_code_blocks(spark, sf_dir):
        """Code-blocks of a flat and a rough image, joined with the grid that they should lie on: which have contributions."""
        flat = raster(spark).where("name = 'rough'").select(F.lit(0).alias("comp"), "y", "x", "v")
        both = flat.withColumn("name", F.lit("rough")).unionByName(flat.withColumn("name", F.lit("flat")).withColumn("v", F.lit(128)))
        coded = codec.encode(codec.images(both), "j2k", levels=1, block=3)
        found = streams.code_blocks(coded, "name").select("name", "band", "y", "x", (F.col("passes") > 0).alias("included"))
        grid = spark.range(2 * 4 * 4).select(F.floor(F.col("id") / 16).cast("int").alias("k"), F.floor(F.col("id") / 4 % 4).cast("int").alias("b"), (F.col("id") % 4).alias("i"))
        grid = grid.select(F.element_at(F.array(F.lit("flat"), F.lit("rough")), F.col("k") + 1).alias("name"), F.element_at(F.array(*map(F.lit, ("LL", "HL", "LH", "HH"))), F.col("b") + 1).alias("band"), (F.floor(F.col("i") / 2) * 8).alias("y"), (F.col("i") % 2 * 8).alias("x"))
        return grid.join(found, ["name", "band", "y", "x"], "left")

    def jpeg_progressive_roundtrip(spark, sf_dir):
        """Samples of a progressive stream that differ from those of the baseline stream of the same levels: none."""
        base = images._back(spark, 3, 8, "jpeg", quality=75)
        other = images._back(spark, 3, 8, "jpeg", quality=75, progressive=True).withColumnRenamed("v", "got")
        both = base.join(other, ["name", "comp", "y", "x"], "full")
        return both.groupBy("name").agg(F.count("*").alias("n"), F.count(F.when(~F.col("v").eqNullSafe(F.col("got")), 1)).alias("different"))

    def jpeg_quality75_mae(spark, sf_dir):
        """Quality 75 keeps the gray ramps within one level on average, and every sample within four."""
        both = images.fixtures(spark, 1, 8).join(images._back(spark, 1, 8, "jpeg", quality=75).withColumnRenamed("v", "got"), ["name", "comp", "y", "x"], "full").where("name IN ('square', 'wide')")
        return signals.compared(both, "name", "v", "got", 255).select("name", (F.col("mae") <= 2).alias("mean_ok"), (F.col("max_diff") <= 8).alias("max_ok"))

    def jpeg_lossless_roundtrip(spark, sf_dir):
        return _union(images._back(spark, 3, 16, "jpeg_lossless", predictor=k).withColumn("predictor", F.lit(k)) for k in PREDICTORS)

    def jpeg_lossless_by_hand(spark, sf_dir):
        return codec.samples(codec.decode(spark.createDataFrame([("hand", BY_HAND)], "name string, content binary")), "name")

    def jpegls_presets_roundtrip(spark, sf_dir):
        return images._back(spark, 3, 8, "jpegls", given=PRESETS, layout="sample")

    def jpegls_standard_example(spark, sf_dir):
        """The worked example of the standard, read from its stream and written again."""
        given = spark.createDataFrame([("example", bytes.fromhex(EXAMPLE_STREAM))], "name string, content binary")
        back = codec.decode(given)
        again = codec.encode(back.drop("content"), "jpegls").select("name", F.hex("content").alias("stream"))
        return codec.samples(back, "name").join(again, "name").select("y", "x", "v", "stream")

    def jpegls_golden_images(spark, sf_dir):
        own = golden(spark)
        back = [codec.samples(codec.decode(codec.encode(codec.images(own.where(F.col("bits") == b), b), "jpegls", layout="line").select("name", "content")), "name") for b in (8, 16)]
        both = own.join(_union(back).withColumnRenamed("v", "got"), ["name", "comp", "y", "x"], "full")
        return both.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("got").cast("long") * (F.col("x") + 1)).alias("weighted"), F.count(F.when(~F.col("v").eqNullSafe(F.col("got")), 1)).alias("wrong"))

    def spiff_headers(spark, sf_dir):
        return streams.spiff_headers(_headed(spark), "file").where("error IS NULL").drop("error")

    def preset_parameters(spark, sf_dir):
        return streams.preset_parameters(_headed(spark), "file").where("error IS NULL").drop("error")

    def tile_parts(spark, sf_dir):
        return streams.tile_parts(_headed(spark), "file").where("error IS NULL").select("file", "tile", "part", "parts")

    def codestream_markers(spark, sf_dir):
        return streams.codestream_markers(_headed(spark), "file").where("error IS NULL").groupBy("file", "marker").agg(F.count("*").alias("n"))

    def wavelet_styles(spark, sf_dir):
        return streams.wavelet_styles(_headed(spark), "file").where("error IS NULL").select("file", "tiles", "levels", "reversible", "quantisation", "guard_bits", "steps", "colour_transform", "high_throughput", "shift")

    def icc_profiles(spark, sf_dir):
        return streams.icc_profiles(_headed(spark), "file").where("error IS NULL").select("file", F.decode("profile", "US-ASCII").alias("profile"))

    def codec_listing(spark, sf_dir):
        return streams.codecs(spark).select("codec", "encode", "decode")

    def idct_fixed_point(spark, sf_dir):
        scan = levels(spark, sf_dir).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("pos", "recon"))).alias("s"))
        whole = scan.select("vec_id", F.transform("s", lambda s: s["recon"]).alias("block"))
        return blocks.fixed_point_inverse(whole, "vec_id", "block")

    def ycbcr_to_rgb_truncated(spark, sf_dir):
        r, g, b = color.ycbcr_to_rgb(F.col("r"), F.col("g"), F.col("b"), truncate=True)
        return rgb(spark).select("id", r.alias("red"), g.alias("green"), b.alias("blue"))

    def j2k_finalise(spark, sf_dir):
        return spark.createDataFrame(SHIFTS, "v int, bits int").select("v", "bits", bands.finalised(F.col("v"), F.col("bits")).alias("sample"))

    def stepsize_decode(spark, sf_dir):
        e, m = F.floor(F.col("id") / 64) % 32, F.col("id") * 37 % 2048
        return spark.range(2048).select("id", bands.step_of(e, m, F.lit(10)).alias("step"))

    def derived_steps(spark, sf_dir):
        """Exponents of all bands where only the first is said, for one to six levels."""
        n = spark.range(1, 7).select(F.col("id").cast("int").alias("levels"))
        each = n.select("levels", F.explode(F.sequence(F.lit(1), F.col("levels"))).alias("level"))
        return each.select("levels", "level", bands.derived_exponent(F.lit(13), F.col("levels"), F.col("level")).alias("exponent"))

    def preset_validation(spark, sf_dir):
        def valid(bits, near, given):
            try:
                return bool(jpegls.presets(bits, near, given))
            except ValueError:
                return False

        return spark.createDataFrame([(i, valid(*w)) for i, w in enumerate(WRONG_PRESETS)], "i int, valid boolean")

    def decoder_status_diff(spark, sf_dir):
        """Decoding against reading the header: where the two disagree on whether a file is sound."""
        source = images._streams(spark)
        header = streams.image_info(source).select("file", "error")
        return codec.status_differences(codec.report(codec.decode(source), "file"), codec.report(header, "file"), "file")

    def success_rate(spark, sf_dir):
        source = images._streams(spark).withColumn("format", streams.format_of("content"))
        done = codec.decode(source).select("format", F.when(F.col("error").isNull(), "OK").otherwise("ERROR").alias("status"))
        return codec.success_rates(done.withColumn("format", F.coalesce("format", F.lit("unknown"))), "format")

    def compression_ratio(spark, sf_dir):
        coded = codec.sizes(codec.encode(_gray(spark), "jpegls")).select("name", "raw_bytes", "coded_bytes", F.round("ratio", 6).alias("ratio"))
        stats = images.fixtures(spark, 1, 8).groupBy("name").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.avg("v"), 6).alias("mean"))
        return coded.join(stats, "name")

    def psnr_of_equal_images(spark, sf_dir):
        pairs = raster(spark).withColumn("w", F.when(F.col("name") == "ramp", F.col("v")).otherwise(F.floor(F.col("v") / 4) * 4))
        return signals.compared(pairs, "name", "v", "w", 255).select("name", (F.col("psnr") == float("inf")).alias("infinite"))

    def raw_scan(spark, sf_dir):
        given = spark.createDataFrame([(1, bytes(range(24))), (2, bytes(range(30))), (3, bytes(23)), (4, b""), (5, None)], "id long, content binary")
        return streams.raw_images(given, 4, 3, 2).select("id", F.hex("pixels").alias("pixels"), F.col("error").isNull().alias("ok"))

    def file_sinks(spark, sf_dir):
        """Raw and coded images written as files and read again: samples that differ, none."""
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.gettempdir()
        folder = f"{folder}/sinks-{spark.sparkContext.applicationId}"
        own = _gray(spark)
        raw = own.select(F.concat("name", F.lit(".raw")).alias("file"), F.col("pixels").alias("content"))
        coded = codec.encode(own, "jp2", levels=1).select(F.concat("name", F.lit(".jp2")).alias("file"), "content")
        sinks.write_files(raw.unionByName(coded), folder, "file", "content").collect()
        back = streams.files(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
        pixels = codec.decode(back.where("file LIKE '%.jp2'")).select(F.regexp_replace("file", ".jp2", "").alias("name"), F.col("pixels").alias("got"))
        kept = back.where("file LIKE '%.raw'").select(F.regexp_replace("file", ".raw", "").alias("name"), "content")
        both = own.join(pixels, "name", "left").join(kept, "name", "left")
        return both.select("name", F.length("pixels").cast("long").alias("bytes"), F.col("got").eqNullSafe(F.col("pixels")).alias("decoded"), F.col("content").eqNullSafe(F.col("pixels")).alias("raw"))

    def ppm_export_rgb(spark, sf_dir):
        one = rgb(spark).where("id < 64").select(F.lit("rgb").alias("name"), F.floor(F.col("id") / 16).cast("int").alias("y"), (F.col("id") % 16).cast("int").alias("x"), "r", "g", "b")
        return planes.pixmap(one).select("name", F.hex("file").alias("file_hex"))

    def mr_context(spark, sf_dir):
        near = bands.around(raster(spark).withColumn("s", (F.abs(F.col("v") - 128) >= 64).cast("int")), "s")
        return near.where("s = 1").select("name", "y", "x", planes.refinement_context(F.abs(F.col("v") - 128) >= 96, F.col("h") + F.col("v2") + F.col("d")).alias("context"))

    def ht_quad_context(spark, sf_dir):
        return planes.quad_contexts(raster(spark).withColumn("s", F.when(F.abs(F.col("v") - 128) >= 100, 1).otherwise(0)), "s")

    def ht_block_roundtrip(spark, sf_dir):
        """Blocks of levels coded in quads and back."""
        whole = levels(spark, sf_dir).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("pos", "level"))).alias("s")).select("vec_id", F.transform("s", lambda s: s["level"].cast("long")).alias("block"))

        @F.pandas_udf("array<long>")
        def back(blocks_):
            return blocks_.map(lambda b: quads.decode(quads.encode(b.reshape(8, 8)), 8, 8).ravel())

        return whole.select("vec_id", F.posexplode(back("block")).alias("pos", "level"))

    def mel_runs(spark, sf_dir):
        got = quads.doubling_runs(bytes.fromhex(RUNS), 4)
        return spark.createDataFrame([(i, s, k) for i, (s, k) in enumerate(got)], "i int, symbol int, state int")

    def golomb_codes(spark, sf_dir):
        return spark.createDataFrame([(k, b, *x) for k in range(4) for b, x in enumerate(jpegls.golomb_table(k))], "k int, byte int, value int, bits int")

    def arithmetic_sequence(spark, sf_dir):
        bits = [b >> 7 - i & 1 for b in bytes.fromhex(SEQUENCE) for i in range(8)]
        coder, reader = arithmetic.Encoder([0]), arithmetic.Decoder([0], bytes.fromhex(CODED))
        for b in bits:
            coder.code(0, b)
        back = "".join(str(reader.code(0)) for _ in bits)
        return spark.createDataFrame([(coder.done().hex().upper(), f"{int(back, 2):064X}")], "coded string, sequence string")

    def dwt53_2d_inverse(spark, sf_dir):
        return bands.unplane(bands.plane(raster(spark)))

    def dwt97_2d_inverse(spark, sf_dir):
        return bands.unplane(bands.plane(raster(spark), False), False).select("name", "y", "x", F.round("v", 6).alias("v"))

    def dwt53_pyramid(spark, sf_dir):
        return bands.pyramid(raster(spark), LEVELS).groupBy("name", "level", "band").agg(F.count("*").alias("n"), F.sum("w").alias("total"), F.sum(F.abs("w")).alias("size"))

    def dwt53_pyramid_inverse(spark, sf_dir):
        return bands.unpyramid(bands.pyramid(raster(spark), LEVELS), LEVELS)

    def ac_symbols(spark, sf_dir):
        return blocks.run_symbols(blocks.scanned(levels(spark, sf_dir)), "vec_id")

    def standard_code_tables(spark, sf_dir):
        rows = [(t, i, s, n) for t, ss, counts in (("dc", range(12), fixed.DC_COUNTS), ("ac", fixed.ac_symbols(), fixed.AC_COUNTS)) for i, (s, n) in enumerate(zip(ss, fixed.lengths(counts), strict=True))]
        return planes.canonical_codes(spark.createDataFrame(rows, "name string, idx int, symbol int, bits int"))

    def jpegls_run_modes(spark, sf_dir):
        return planes.run_modes(raster(spark).withColumn("v", F.floor(F.col("v") / 64).cast("int")))

    def jpeg_standard_tables(spark, sf_dir):
        """Samples that differ between streams with the scan's own code tables and with the standard's: none."""
        base = images._back(spark, 3, 8, "jpeg", quality=75)
        both = base.join(images._back(spark, 3, 8, "jpeg", quality=75, standard=True).withColumnRenamed("v", "got"), ["name", "comp", "y", "x"], "full")
        return both.groupBy("name").agg(F.count("*").alias("n"), F.count(F.when(~F.col("v").eqNullSafe(F.col("got")), 1)).alias("different"))

    def marker_segments_sql(spark, sf_dir):
        """Markers by the table function in SQL."""
        extension.register(spark)
        images._streams(spark).where("file IN ('a', 'b', 'e', 'g')").createOrReplaceTempView("pixelloom_streams")
        return spark.sql("SELECT file, s.seq, s.marker FROM pixelloom_streams, LATERAL jpeg_segments(content) s")

    def image_functions_sql(spark, sf_dir):
        """Images coded and decoded by the SQL functions."""
        extension.register(spark)
        _gray(spark).createOrReplaceTempView("pixelloom_images")
        coded = spark.sql("SELECT name, pixels, image_encode(pixels, width, height, components, bits, 'jpegls') AS content FROM pixelloom_images")
        back = coded.select("name", "pixels", F.expr("image_decode(content)").alias("d"))
        return back.select("name", "d.width", "d.height", "d.bits", (F.col("d.pixels") == F.col("pixels")).alias("equal"))

    def stripe_scan_order(spark, sf_dir):
        """The place of each sample in the order of bit-plane passes: stripes of four rows, column by column."""
        w = signals.Window.partitionBy("name").orderBy(F.floor(F.col("y") / 4), "x", F.col("y") % 4)
        return raster(spark).select("name", "y", "x", (F.row_number().over(w) - 1).alias("place"))

    def packet_orders(spark, sf_dir):
        """The place of each packet of two layers, three resolutions, three components in the progressions that go by these alone."""
        one = spark.range(18).select(F.floor(F.col("id") / 9).cast("int").alias("layer"), F.floor(F.col("id") / 3 % 3).cast("int").alias("resolution"), (F.col("id") % 3).cast("int").alias("component"))
        keys = {"LRCP": ("layer", "resolution", "component"), "RLCP": ("resolution", "layer", "component"), "CPRL": ("component", "resolution", "layer")}
        return _union(one.select(F.lit(p).alias("progression"), "*", (F.row_number().over(signals.Window.partitionBy(F.lit(p)).orderBy(*k)) - 1).alias("place")) for p, k in keys.items())

    def subband_recomposition(spark, sf_dir):
        """The four bands of a plane put together again."""
        w = bands.plane(raster(spark))
        return _union(w.where(F.col("band") == b).select("name", "y", "x", "w") for b in ("LL", "HL", "LH", "HH"))

    def failing_only_in_decoding(spark, sf_dir):
        """Files whose header can be read, less those that can be decoded."""
        source = images._streams(spark)
        sound = streams.image_info(source).where("error IS NULL").select("file")
        return sound.exceptAll(codec.decode(source).where("error IS NULL").select("file"))

    def idct_values(spark, sf_dir):
        """The samples that come back from their coefficients."""
        c = blocks.coefficients(embedded(spark, sf_dir), "vec_id", "block")
        whole = F.transform(F.sort_array(F.collect_list(F.struct("pos", "coef"))), lambda s: s["coef"])
        back = blocks.coefficients(c.groupBy("vec_id").agg(whole.alias("c")), "vec_id", "c", True)
        return back.select("vec_id", "pos", (F.round("coef", 3) + 0).alias("v"))

    def dwt53_inverse(spark, sf_dir):
        return signals.unlifted_53(signals.lifted_53(signal(spark, sf_dir), "user_id", "i", "v"), "user_id", "i").select("user_id", "i", "back")

    def dwt97_inverse(spark, sf_dir):
        return bands.unlifted_97(bands.lifted_97(signal(spark, sf_dir), "user_id", "i", "v"), "user_id", "i").select("user_id", "i", (F.round("back", 6) + 0).alias("back"))

    def golden_fixtures(spark, sf_dir):
        return golden(spark).groupBy("name", "comp").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum(F.col("v").cast("long") * (F.col("y") * 3 + F.col("x") + 1)).alias("weighted"))

    def rgb_opposed_ramps(spark, sf_dir):
        one = spark.range(128 * 4).select(F.floor(F.col("id") / 128).cast("int").alias("y"), (F.col("id") % 128).cast("int").alias("x"))
        up = F.floor(F.col("x") * 255 / 127).cast("int")
        return one.select("y", "x", up.alias("r"), (255 - up).alias("g"), F.lit(128).alias("b"))

    own = (
        j2k_roundtrip_53, j2k_roundtrip_53_gray16, j2k_roundtrip_97_fine, j2k_roundtrip_97_psnr, j2k_tiles_progressions, j2k_code_blocks, jpeg_progressive_roundtrip, jpeg_quality75_mae,
        jpeg_lossless_roundtrip, jpeg_lossless_by_hand, jpegls_presets_roundtrip, jpegls_standard_example, jpegls_golden_images, spiff_headers, preset_parameters, tile_parts,
        codestream_markers, wavelet_styles, icc_profiles, codec_listing, idct_fixed_point, ycbcr_to_rgb_truncated, j2k_finalise, stepsize_decode, derived_steps, preset_validation,
        decoder_status_diff, success_rate, compression_ratio, psnr_of_equal_images, raw_scan, file_sinks, ppm_export_rgb, mr_context, ht_quad_context, ht_block_roundtrip, mel_runs,
        golomb_codes, arithmetic_sequence, dwt53_2d_inverse, dwt97_2d_inverse, dwt53_pyramid, dwt53_pyramid_inverse, ac_symbols, standard_code_tables, jpegls_run_modes, golden_fixtures,
        rgb_opposed_ramps, jpeg_standard_tables, marker_segments_sql, image_functions_sql, stripe_scan_order, packet_orders, subband_recomposition, failing_only_in_decoding,
        idct_values, dwt53_inverse, dwt97_inverse,
    )
    return {f.__name__: f for f in own}


def _lift(source: str, line: str, at: str, out: str) -> str:
    """SQL of one level of the 5/3 transform of source(name, y, x, v) along `at`."""
    other = lambda t, d: f"LEFT JOIN {{s}} {t} ON {t}.name = o.name AND {t}.{line} = o.{line} AND {t}.{at} = o.{at} {d}"
    pair = " ".join((other("l", "- 1"), other("r", "+ 1")))
    return f"""h_{out} AS (SELECT o.*, CASE WHEN o.{at} % 2 = 1 THEN o.v - floor((l.v + coalesce(r.v, l.v)) / 2)::BIGINT END AS d FROM {source} o {pair.format(s=source)}),
{out} AS (SELECT o.name, o.y, o.x, coalesce(o.d, o.v + coalesce(floor((coalesce(l.d, r.d) + coalesce(r.d, l.d) + 2) / 4)::BIGINT, 0)) AS v FROM h_{out} o {pair.format(s=f"h_{out}")})"""


def oracles(coef: str, level: str, img: str, px: str, signal: str) -> dict[str, str]:
    """SQL over the catalogue's common parts."""
    rows = lambda values: ", ".join(map(str, values))
    shapes = images.SHAPES
    angle = [[(2 * x + 1) * u for u in range(8)] for x in range(8)]
    cosine = f"cosine AS (SELECT x, u, trunc(cos((2 * x + 1) * u * pi() / 16) * 4096)::BIGINT AS c, CASE WHEN u = 0 THEN 2896 ELSE 4096 END AS s FROM range({len(angle)}) t(x), range(8) r(u))"
    fall = "floor(floor({v} * s / 4096.0) * c / 4096.0)::BIGINT"
    band = "CASE WHEN x % 2 = 0 THEN CASE WHEN y % 2 = 0 THEN 'LL' ELSE 'LH' END ELSE CASE WHEN y % 2 = 0 THEN 'HL' ELSE 'HH' END END"
    pyramid = f"""WITH {img}, p0 AS (SELECT name, y, x, v::BIGINT AS v FROM img), {_lift("p0", "x", "y", "c1")}, {_lift("c1", "y", "x", "p1")},
q1 AS (SELECT name, (y // 2)::INT AS y, (x // 2)::INT AS x, v FROM p1 WHERE y % 2 = 0 AND x % 2 = 0), {_lift("q1", "x", "y", "c2")}, {_lift("c2", "y", "x", "p2")},
every AS (SELECT name, 1 AS level, {band} AS band, v FROM p1 WHERE y % 2 = 1 OR x % 2 = 1 UNION ALL SELECT name, 2, {band}, v FROM p2)"""
    gold = ", ".join(f"('{n}', {w}, {h}, {c}, {65535 if b == 16 else 255}, '{p}')" for n, w, h, c, b, p in GOLDEN)
    golds = f"""g AS (SELECT name, n, top, pattern, w, w * h AS all_, unnest(range(w * h)) AS i FROM (VALUES {gold}) t(name, w, h, n, top, pattern)),
s AS (SELECT name, comp, i // w AS y, i % w AS x, CASE pattern WHEN 'gradient' THEN CASE comp WHEN 0 THEN i * top // greatest(1, all_ - 1) WHEN 1 THEN (i % w * w + i // w) * top // greatest(1, all_ - 1) ELSE top // 2 END
WHEN 'noise' THEN (i * i * 7 + i * 13 + comp * 101) % (top + 1) WHEN 'checker' THEN CASE WHEN i // w % 2 = i % w % 2 THEN top ELSE 0 END ELSE top // 2 END AS v FROM g, range(3) c(comp) WHERE comp < n)"""
    hit = "(abs(v - 128) >= {})::INT"
    counted = images._counted
    modes = f"""WITH RECURSIVE {img.replace("::INT AS v FROM range(768)", "::INT // 64 AS v FROM range(768)").replace("% 256)::INT FROM", "% 256)::INT // 64 FROM")},
up AS (SELECT s.name, s.y, s.x, s.v, n.a, n.b, n.c, coalesce(r.v, n.b) AS d FROM side s JOIN near n USING (name, y, x) LEFT JOIN img r ON r.name = s.name AND r.y = s.y - 1 AND r.x = s.x + 1),
walk AS (SELECT name, y, x, CASE WHEN a = b AND b = c AND c = d THEN CASE WHEN v = a THEN 'run' ELSE 'interruption' END ELSE 'regular' END AS mode FROM up WHERE x = 0
UNION ALL SELECT u.name, u.y, u.x, CASE WHEN w.mode = 'run' OR (a = b AND b = c AND c = d) THEN CASE WHEN v = a THEN 'run' ELSE 'interruption' END ELSE 'regular' END FROM walk w JOIN up u ON u.name = w.name AND u.y = w.y AND u.x = w.x + 1)"""
    whole = lambda n, b, extra: f"SELECT m.*, {extra} FROM ({images._made(n, b)}) m"
    tables = rows((t, i, s, n) for t, ss, counts in (("dc", range(12), fixed.DC_COUNTS), ("ac", fixed.ac_symbols(), fixed.AC_COUNTS)) for i, (s, n) in enumerate(zip(ss, fixed.lengths(counts), strict=True)))
    stats = {n: w * h for n, w, h in shapes}
    return {
        "j2k_roundtrip_53": images._made(3, 8),
        "j2k_roundtrip_53_gray16": images._made(1, 16),
        "j2k_roundtrip_97_fine": images._made(3, 8),
        "j2k_roundtrip_97_psnr": f"SELECT name, true AS near, true AS over_45 FROM (VALUES {rows(shapes)}) t(name, w, h)",
        "j2k_tiles_progressions": whole(3, 8, "progression").replace(") m", f") m, (VALUES {', '.join(f'({p!r})' for p in wavelet.PROGRESSIONS)}) p(progression)"),
        "j2k_code_blocks": "SELECT name, band, y::BIGINT * 8 AS y, x::BIGINT * 8 AS x, CASE WHEN x * 8 < 16 AND y * 8 < 12 THEN name = 'rough' END AS included FROM (VALUES ('flat'), ('rough')) n(name), (VALUES ('LL'), ('HL'), ('LH'), ('HH')) b(band), range(2) s(y), range(2) t(x)",
        "jpeg_progressive_roundtrip": f"SELECT name, count(*) AS n, 0::BIGINT AS different FROM ({images._made(3, 8)}) GROUP BY name",
        "jpeg_quality75_mae": "SELECT name, true AS mean_ok, true AS max_ok FROM (VALUES ('square'), ('wide')) t(name)",
        "jpeg_lossless_roundtrip": whole(3, 16, "predictor::INT AS predictor").replace(") m", ") m, range(1, 8) p(predictor)"),
        "jpeg_lossless_by_hand": "SELECT 'hand' AS name, 0 AS comp, y, x, v FROM (VALUES (0, 0, 128), (0, 1, 130), (1, 0, 128), (1, 1, 132)) t(y, x, v)",
        "jpegls_presets_roundtrip": images._made(3, 8),
        "jpegls_standard_example": f"SELECT (range // 4)::INT AS y, (range % 4)::INT AS x, ({EXAMPLE})[range + 1]::INT AS v, '{EXAMPLE_STREAM}' AS stream FROM range(16)",
        "jpegls_golden_images": f"WITH {golds} SELECT name, count(*) AS n, sum(v * (x + 1))::BIGINT AS weighted, 0::BIGINT AS wrong FROM s GROUP BY name",
        "spiff_headers": "SELECT 'ls' AS file, 0::BIGINT AS profile, 1::BIGINT AS components, 16::BIGINT AS height, 16::BIGINT AS width, 8::BIGINT AS colour_space, 8::BIGINT AS bits, 6::BIGINT AS compression, 1::BIGINT AS resolution_units, 96::BIGINT AS vertical, 96::BIGINT AS horizontal, true AS valid, true AS fits",
        "preset_parameters": f"SELECT 'ls' AS file, {', '.join(f'{v}::BIGINT AS {n}' for n, v in zip(('top', 't1', 't2', 't3', 'reset'), PRESETS, strict=True))}",
        "tile_parts": "SELECT 'tiled' AS file, range::BIGINT AS tile, 0::BIGINT AS part, 1::BIGINT AS parts FROM range(4) UNION ALL SELECT 'boxed', 0, 0, 1",
        "codestream_markers": "SELECT file, marker, n::BIGINT AS n FROM (VALUES ('tiled', 'SOT', 4), ('tiled', 'SOD', 4), ('boxed', 'SOT', 1), ('boxed', 'SOD', 1), ('capable', 'CAP', 1), ('capable', 'RGN', 1)) t(file, marker, n) UNION ALL SELECT file, marker, 1 FROM (VALUES ('tiled'), ('boxed'), ('capable'), ('profiled')) f(file), (VALUES ('SOC'), ('SIZ'), ('COD'), ('QCD'), ('EOC')) m(marker)",
        "wavelet_styles": """SELECT file, tiles::BIGINT AS tiles, levels::BIGINT AS levels, reversible, quantisation::BIGINT AS quantisation, 2::BIGINT AS guard_bits, (3 * levels + 1)::BIGINT AS steps, colour::BIGINT AS colour_transform, high AS high_throughput, shift::BIGINT AS shift
FROM (VALUES ('tiled', 4, 2, true, 0, 0, false, 0), ('boxed', 1, 1, false, 2, 0, false, 0), ('capable', 1, 5, true, 0, 1, true, 7), ('profiled', 1, 5, true, 0, 1, false, 0)) t(file, tiles, levels, reversible, quantisation, colour, high, shift)""",
        "icc_profiles": "SELECT 'profiled' AS file, 'profile' AS profile",
        "codec_listing": "SELECT codec, true AS encode, true AS decode FROM (VALUES ('jpeg'), ('jpegls'), ('j2k'), ('jp2')) t(codec)",
        "idct_fixed_point": f"""WITH {level}, {cosine}, given AS (SELECT vec_id, pos // 8 AS y, pos % 8 AS u, (level * ({fixed.LUMINANCE})[pos + 1])::BIGINT * 256 AS i FROM levels),
one AS (SELECT vec_id, y AS k, x, sum({fall.format(v="i")})::BIGINT AS i FROM given JOIN cosine USING (u) GROUP BY ALL),
two AS (SELECT vec_id, o.x AS x, c.x AS y, sum({fall.format(v="i")})::BIGINT AS i FROM one o JOIN cosine c ON c.u = o.k GROUP BY ALL)
SELECT vec_id, (y * 8 + x)::INT AS pos, i / 1024.0::DOUBLE AS v FROM two""",
        "ycbcr_to_rgb_truncated": "SELECT id, " + ", ".join(f"floor(greatest(0, least(255, {e})))::INT AS {n}" for n, e in (("red", "r + 1.402::DOUBLE * (b - 128)"), ("green", "r - 0.344136::DOUBLE * (g - 128) - 0.714136::DOUBLE * (b - 128)"), ("blue", "r + 1.772::DOUBLE * (g - 128)"))) + f" FROM ({px})",
        "j2k_finalise": f"SELECT v::INT AS v, bits::INT AS bits, greatest(0, least(255, floor((v + pow(2, bits - 1)) / pow(2, greatest(0, bits - 8)) + 0.5)))::INT AS sample FROM (VALUES {rows(SHIFTS)}) t(v, bits)",
        "stepsize_decode": "SELECT range AS id, pow(2.0, 10 - range // 64 % 32) * (1 + (range * 37 % 2048) / 2048.0::DOUBLE) AS step FROM range(2048)",
        "derived_steps": "SELECT n::INT AS levels, k::INT AS level, (13 - n + k)::INT AS exponent FROM range(1, 7) t(n), range(1, 7) s(k) WHERE k <= n",
        "preset_validation": "SELECT (i - 1)::INT AS i, ok AS valid FROM (SELECT unnest(range(1, 10)) AS i, unnest([true, false, false, false, false, false, true, true, false]) AS ok)",
        "decoder_status_diff": "SELECT file, status_a, status_b, status_a = status_b AS agree FROM (VALUES ('a', 'OK', 'OK'), ('b', 'OK', 'OK'), ('c', 'ERROR', 'OK'), ('d', 'ERROR', 'OK'), ('e', 'ERROR', 'ERROR'), ('f', 'ERROR', 'ERROR'), ('g', 'ERROR', 'ERROR')) t(file, status_a, status_b)",
        "success_rate": "SELECT format, n::BIGINT AS n, ok::BIGINT AS n_ok, ok / n AS rate FROM (VALUES ('jpeg', 3, 2), ('j2k', 1, 0), ('jp2', 1, 0), ('unknown', 2, 0)) t(format, n, ok)",
        "compression_ratio": f"SELECT name, count(*) AS raw_bytes, any_value(b)::BIGINT AS coded_bytes, round(count(*) / any_value(b), 6) AS ratio, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean FROM ({images._made(1, 8)}) JOIN (VALUES {rows(CODED_BYTES.items())}) t(name, b) USING (name) GROUP BY name",
        "psnr_of_equal_images": "SELECT name, name = 'ramp' AS infinite FROM (VALUES ('ramp'), ('rough')) t(name)",
        "raw_scan": f"SELECT id::BIGINT AS id, CASE WHEN id < 3 THEN '{bytes(range(24)).hex().upper()}' END AS pixels, id < 3 AS ok FROM range(1, 6) t(id)",
        "file_sinks": f"SELECT name, b::BIGINT AS bytes, true AS decoded, true AS raw FROM (VALUES {rows(stats.items())}) t(name, b)",
        "ppm_export_rgb": f"SELECT 'rgb' AS name, hex(encode('P6' || chr(10) || '16 4' || chr(10) || '255' || chr(10))) || string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY id) AS file_hex FROM ({px}) WHERE id < 64",
        "mr_context": f"""WITH {img}, n AS (SELECT i.name, i.y, i.x, any_value(i.v) AS v, sum({hit.format(64).replace("v", "j.v")}) AS s FROM img i JOIN img j ON j.name = i.name AND abs(j.y - i.y) <= 1 AND abs(j.x - i.x) <= 1 AND (j.y <> i.y OR j.x <> i.x) GROUP BY ALL)
SELECT name, y, x, CASE WHEN abs(v - 128) >= 96 THEN 16 WHEN s > 0 THEN 15 ELSE 14 END AS context FROM n WHERE abs(v - 128) >= 64""",
        "ht_quad_context": f"""WITH {img}, q AS (SELECT name, (y // 2)::BIGINT AS qy, (x // 2)::BIGINT AS qx, sum({hit.format(100)} << (x % 2 + y % 2 * 2))::INT AS rho FROM img GROUP BY ALL)
SELECT q.name, q.qy, q.qx, q.rho, (coalesce(sum(o.rho), 0) > 0)::INT AS context FROM q LEFT JOIN q o ON o.name = q.name AND ((o.qy = q.qy AND o.qx = q.qx - 1) OR (o.qy = q.qy - 1 AND abs(o.qx - q.qx) <= 1)) GROUP BY ALL""",
        "ht_block_roundtrip": f"WITH {level} SELECT vec_id, pos, level::BIGINT AS level FROM levels",
        "mel_runs": "SELECT * FROM (VALUES (0, 0, 1), (1, 0, 2), (2, 0, 2), (3, 1, 1)) t(i, symbol, state)",
        "golomb_codes": """WITH z AS (SELECT k, b, CASE WHEN b = 0 THEN 8 ELSE 8 - length(bin(b)) END AS q FROM range(4) t(k), range(256) s(b)), l AS (SELECT *, q + 1 + k AS n FROM z)
SELECT k::INT AS k, b::INT AS byte, (CASE WHEN n <= 8 THEN q * (1 << k) + (b // (1 << greatest(0, 8 - n))) % (1 << k) ELSE 0 END)::INT AS value, (CASE WHEN n <= 8 THEN n ELSE 0 END)::INT AS bits FROM l""",
        "arithmetic_sequence": f"SELECT '{CODED}' AS coded, '{SEQUENCE}' AS sequence",
        "dwt53_2d_inverse": f"WITH {img} SELECT name, y, x, v::BIGINT AS v FROM img",
        "dwt97_2d_inverse": f"WITH {img} SELECT name, y, x, v::DOUBLE AS v FROM img",
        "dwt53_pyramid": f"{pyramid} SELECT name, level, band, count(*) AS n, sum(v)::BIGINT AS total, sum(abs(v))::BIGINT AS size FROM every GROUP BY ALL",
        "dwt53_pyramid_inverse": f"WITH {img} SELECT name, y, x, v::BIGINT AS v FROM img",
        "ac_symbols": f"WITH {level} SELECT vec_id, k, (run // 16)::INT AS zrl, (run % 16 * 16 + ssss)::INT AS symbol FROM runs UNION ALL SELECT vec_id, 64, 0, 0 FROM scan WHERE k = 63 AND level = 0",
        "standard_code_tables": f"SELECT name, idx::INT AS idx, symbol::INT AS symbol, bits::INT AS bits, (coalesce(sum(pow(2.0, -bits)) OVER (PARTITION BY name ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * pow(2.0, bits))::BIGINT AS code FROM (VALUES {tables}) t(name, idx, symbol, bits)",
        "jpegls_run_modes": f"{modes} SELECT name, y, x, mode FROM walk",
        "jpeg_standard_tables": f"SELECT name, count(*) AS n, 0::BIGINT AS different FROM ({images._made(3, 8)}) GROUP BY name",
        "marker_segments_sql": "SELECT file, seq::INT AS seq, marker FROM (VALUES ('a', 0, 'SOI'), ('a', 1, 'SOF55'), ('a', 2, 'SOS'), ('a', 3, 'EOI'), ('b', 0, 'SOI'), ('b', 1, 'DQT'), ('b', 2, 'SOF0'), ('b', 3, 'DHT'), ('b', 4, 'DHT'), ('b', 5, 'SOS'), ('b', 6, 'EOI')) t(file, seq, marker)",
        "image_functions_sql": f"SELECT name, w::BIGINT AS width, h::BIGINT AS height, 8::BIGINT AS bits, true AS equal FROM (VALUES {rows(shapes)}) t(name, w, h)",
        "stripe_scan_order": f"WITH {img} SELECT name, y, x, (y // 4 * 4 * 32 + x * 4 + y % 4)::INT AS place FROM img",
        "packet_orders": "SELECT p AS progression, l::INT AS layer, r::INT AS resolution, c::INT AS component, (CASE p WHEN 'LRCP' THEN l * 9 + r * 3 + c WHEN 'RLCP' THEN r * 6 + l * 3 + c ELSE c * 6 + r * 2 + l END)::INT AS place FROM range(2) a(l), range(3) b(r), range(3) d(c), (VALUES ('LRCP'), ('RLCP'), ('CPRL')) t(p)",
        "subband_recomposition": f"{pyramid} SELECT name, y, x, v AS w FROM p1",
        "failing_only_in_decoding": "SELECT * FROM (VALUES ('c'), ('d')) t(file)",
        "idct_values": "SELECT vec_id, p::INT AS pos, round(v, 3) + 0 AS v FROM (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding)::DOUBLE * 100 AS v FROM embeddings)",
        "dwt53_inverse": f"WITH {signal} SELECT user_id, i, v AS back FROM s",
        "dwt97_inverse": f"WITH {signal} SELECT user_id, i, v::DOUBLE AS back FROM s",
        "golden_fixtures": f"WITH {golds} SELECT name, comp::INT AS comp, count(*) AS n, min(v)::INT AS least, max(v)::INT AS most, sum(v * (y * 3 + x + 1))::BIGINT AS weighted FROM s GROUP BY ALL",
        "rgb_opposed_ramps": "SELECT (range // 128)::INT AS y, (range % 128)::INT AS x, (range % 128 * 255 // 127)::INT AS r, 255 - (range % 128 * 255 // 127)::INT AS g, 128 AS b FROM range(512)",
    }
