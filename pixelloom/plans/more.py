"""Queries on wavelets, contexts, geometry and sample arithmetic, and their equivalents; the catalogue registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from pixelloom.codecs import jpegls
from pixelloom.functions import color, fixed
from pixelloom.operators import bands, blocks, planes, signals

QUALITIES = (10, 50, 90)
DEPTH = 10
TOPS, NEARS = [3, 15, 127, 255, 1023, 4095, 65535], [0, 1, 3]
RANGE = 256
SIZES, TILE = [(512, 512), (300, 200), (129, 1)], 128
#: Lengths of the codes of the standard's luminance tables: DC by category (those beyond the table are escapes of 16 bits), AC by symbol.
DC_LENGTHS = [*fixed.lengths(fixed.DC_COUNTS), 16, 16, 16, 16]
AC_LENGTHS = dict(zip(fixed.ac_symbols(), fixed.lengths(fixed.AC_COUNTS), strict=True))


def build(embedded: Callable, levels: Callable, raster: Callable, rgb: Callable, signal: Callable) -> dict[str, Callable]:
    """The queries over the catalogue's inputs."""

    def jpeg_recon_mae_by_quality(spark, sf_dir):
        source = embedded(spark, sf_dir)
        coef = blocks.coefficients(source, "vec_id", "block")
        table = spark.createDataFrame([(q, p, v) for q in QUALITIES for p, v in enumerate(fixed.scaled(q))], "quality int, pos int, q int")
        c = coef.join(F.broadcast(table), "pos")
        back = F.signum("coef") * F.floor(F.abs("coef") / F.col("q") + 0.5) * F.col("q")
        whole = F.transform(F.array_sort(F.collect_list(F.struct("pos", back.alias("c")))), lambda s: s["c"])
        flat = c.groupBy("vec_id", "quality").agg(whole.alias("c")).select((F.col("vec_id") * 128 + F.col("quality")).alias("key"), "c")
        got = blocks.coefficients(flat, "key", "c", True).select(F.floor(F.col("key") / 128).alias("vec_id"), (F.col("key") % 128).cast("int").alias("quality"), "pos", "coef")
        was = source.select("vec_id", F.posexplode("block").alias("pos", "v"))
        return got.join(was, ["vec_id", "pos"]).groupBy("quality").agg(F.round(F.avg(F.abs(F.col("v") - F.col("coef"))), 4).alias("mae"))

    def ict_inverse(spark, sf_dir):
        u, v = F.col("g") - 128, F.col("b") - 128
        out = {n: F.round(F.col("r") + u * a + v * c, 6).alias(n) for n, (a, c) in zip(("red", "green", "blue"), fixed.YCBCR_TO_RGB, strict=True)}
        return rgb(spark).select("id", *out.values())

    def chroma_upsample(spark, sf_dir):
        return bands.upsampled(signals.gradient(spark, "half", 9, 5).select("y", "x", "v"), 17, 10, 2, 2)

    def deinterleave_planes(spark, sf_dir):
        return rgb(spark).select("id", F.posexplode(F.array("r", "g", "b")).alias("comp", "v"))

    def interleave_pixels(spark, sf_dir):
        one = deinterleave_planes(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("comp", "v"))).alias("s"))
        return one.select("id", F.array_join(F.transform("s", lambda s: s["v"].cast("string")), ",").alias("pixel"))

    def jpegls_error_mapping(spark, sf_dir):
        e = (F.col("id") - 256).cast("int")
        return spark.range(513).select(e.alias("e"), color.mapped_error(e).cast("int").alias("mapped"))

    def modulo_reduction(spark, sf_dir):
        e = (F.col("id") - 255).cast("int")
        m = F.pmod(e, F.lit(RANGE))
        return spark.range(511).select(e.alias("e"), F.when(m >= (RANGE + 1) // 2, m - RANGE).otherwise(m).cast("int").alias("reduced"))

    def jpegls_default_thresholds(spark, sf_dir):
        rows = [(t, n, *jpegls.thresholds(t, n)) for t in TOPS for n in NEARS if n <= t // 2]
        return spark.createDataFrame(rows, "top int, near int, t1 int, t2 int, t3 int")

    def dwt97_forward(spark, sf_dir):
        return bands.lifted_97(signal(spark, sf_dir), "user_id", "i", "v").select("user_id", "i", F.round("w", 4).alias("w"))

    def dwt97_roundtrip(spark, sf_dir):
        back = bands.unlifted_97(bands.lifted_97(signal(spark, sf_dir), "user_id", "i", "v"), "user_id", "i")
        return back.groupBy("user_id").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("back") - F.col("v"))) < 1e-4).alias("exact"))

    def dwt53_2d_one_level(spark, sf_dir):
        return bands.plane_53(raster(spark)).select("name", "y", "x", "w", "band")

    def subband_rollup(spark, sf_dir):
        nonzero = F.count(F.when(F.col("w") != 0, 1)).alias("nonzero")
        return bands.plane_53(raster(spark)).rollup("name", "band").agg(F.count("*").alias("n"), nonzero)

    def stepsize_encode(spark, sf_dir):
        """The step that each event's value asks for, coded."""
        e, m = bands.step_code(F.col("step"), DEPTH)
        return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.abs("value") + 0.3).alias("step")).select("event_id", e.alias("exponent"), m.alias("mantissa"))

    def significance(spark):
        return raster(spark).withColumn("s", (F.abs(F.col("v") - 128) >= 64).cast("int"))

    def significance_neighbors(spark, sf_dir):
        return bands.around(significance(spark), "s").select("name", "y", "x", "h", "v2", "d")

    def zc_context(spark, sf_dir):
        n = bands.around(significance(spark), "s")
        return n.select("name", "y", "x", *(bands.zero_context(F.col("h"), F.col("v2"), F.col("d"), b).cast("int").alias(b.lower()) for b in ("LL", "HL", "HH")))

    def sign_context(spark, sf_dir):
        signed = significance(spark).withColumn("s", F.col("s") * F.when(F.col("v") < 128, -1).otherwise(1))
        ctx, flip = bands.sign_context(F.col("h"), F.col("v2"))
        return bands.around(signed, "s").select("name", "y", "x", ctx.cast("int").alias("context"), flip.alias("flip"))

    def tile_grid_geometry(spark, sf_dir):
        s = spark.createDataFrame(SIZES, "w int, h int")
        n = lambda c: F.explode(F.sequence(F.lit(0), F.ceil(F.col(c) / TILE).cast("int") - 1))
        t = s.select("*", n("w").alias("tx")).select("*", n("h").alias("ty"))
        side = lambda c, k: F.least(F.lit(TILE), F.col(c) - F.col(k) * TILE).cast("int")
        return t.select("w", "h", "tx", "ty", side("w", "tx").alias("width"), side("h", "ty").alias("height"))

    def lossless_flag(spark, sf_dir):
        pairs = raster(spark).withColumn("w", F.when(F.col("name") == "ramp", F.col("v")).otherwise(F.col("v") - F.col("v") % 4))
        return signals.compared(pairs, "name", "v", "w", 255).select("name", "lossless")

    def rgb_stripes_fixture(spark, sf_dir):
        band = F.least(F.floor(F.col("id") % 256 / (256 // 3)), F.lit(2))
        one = spark.range(256 * 4).select(F.floor(F.col("id") / 256).cast("int").alias("y"), (F.col("id") % 256).cast("int").alias("x"), band.alias("band"))
        return one.select("y", "x", *(F.when(F.col("band") == i, 255).otherwise(0).alias(c) for i, c in enumerate("rgb")))

    def ff_stuffing_count(spark, sf_dir):
        """What a coded scan of each document's digest (bytes of every value, unlike UTF-8) grows by."""
        digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
        return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planes.stuffed(digest).cast("long").alias("stuffed"))

    def huffman_bit_budget(spark, sf_dir):
        """Bits of each image's coded levels with the standard's luminance tables: DC differences and AC symbols."""
        image = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label").alias("image"))
        own = levels(spark, sf_dir).join(image, "vec_id")
        d = planes.differences(own.where("pos = 0").select("image", "vec_id", F.col("level").alias("dc")), "image", "vec_id", "dc")
        of = lambda table: F.create_map(*(F.lit(x) for item in table for x in item))
        size = color.category(F.col("diff"))
        dc = d.select("image", F.lit("dc").alias("kind"), (F.try_element_at(of(enumerate(DC_LENGTHS)), size) + size).alias("bits"))
        # Symbols beyond the table's sizes (over 10 bits) count as escapes of 16.
        bits = F.coalesce(F.try_element_at(of(AC_LENGTHS.items()), F.col("symbol")), F.lit(16)) + F.col("symbol") % 16 + F.col("zrl") * AC_LENGTHS[0xF0]
        ac = blocks.run_symbols(blocks.scanned(own), "vec_id").join(image, "vec_id").select("image", F.lit("ac").alias("kind"), bits.alias("bits"))
        return dc.unionByName(ac).groupBy("image", "kind").agg(F.sum("bits").cast("long").alias("bits"))

    own = (
        jpeg_recon_mae_by_quality, ict_inverse, chroma_upsample, deinterleave_planes, interleave_pixels, jpegls_error_mapping, modulo_reduction, jpegls_default_thresholds,
        dwt97_forward, dwt97_roundtrip, dwt53_2d_one_level, subband_rollup, stepsize_encode, significance_neighbors, zc_context, sign_context, tile_grid_geometry,
        lossless_flag, rgb_stripes_fixture, ff_stuffing_count, huffman_bit_budget,
    )
    return {f.__name__: f for f in own}


def oracles(coef: str, level: str, img: str, px: str, signal: str) -> dict[str, str]:
    """SQL over the catalogue's common parts: coefficients, levels, the raster, the pixels and the signals."""
    tables = ", ".join(f"({q}, {fixed.scaled(q)})" for q in QUALITIES)
    a, b, c, d = bands.STEPS_97
    both = "coalesce(lag({0}) OVER w, lead({0}) OVER w) + coalesce(lead({0}) OVER w, lag({0}) OVER w)"
    chain, was = "", "v::DOUBLE"
    for n, (weight, odd) in enumerate(((a, 1), (b, 0), (c, 1), (d, 0))):
        chain += f", l{n} AS (SELECT user_id, i, v, n, CASE WHEN i % 2 = {odd} THEN {was} + coalesce(({both.format(was)}) * {weight}, 0) ELSE {was} END AS w{n} FROM {'s' if not n else f'l{n - 1}'} WINDOW w AS (PARTITION BY user_id ORDER BY i))"
        was = f"w{n}"
    lift = lambda src, k, at, v: f"""h_{at} AS (SELECT o.*, CASE WHEN o.{at} % 2 = 1 THEN o.{v} - floor((l.{v} + coalesce(r.{v}, l.{v})) / 2)::BIGINT END AS d FROM {src} o
  LEFT JOIN {src} l ON l.name = o.name AND l.{k} = o.{k} AND l.{at} = o.{at} - 1 LEFT JOIN {src} r ON r.name = o.name AND r.{k} = o.{k} AND r.{at} = o.{at} + 1),
t_{at} AS (SELECT o.name, o.y, o.x, coalesce(o.d, o.{v} + floor((coalesce(l.d, r.d) + coalesce(r.d, l.d) + 2) / 4)::BIGINT) AS w FROM h_{at} o
  LEFT JOIN h_{at} l ON l.name = o.name AND l.{k} = o.{k} AND l.{at} = o.{at} - 1 LEFT JOIN h_{at} r ON r.name = o.name AND r.{k} = o.{k} AND r.{at} = o.{at} + 1)"""  # noqa: E731
    plane = f"""{img}, base AS (SELECT name, y, x, v::BIGINT AS v FROM img), {lift("base", "x", "y", "v")}, {lift("t_y", "y", "x", "w")},
bands AS (SELECT *, CASE WHEN x % 2 = 0 THEN CASE WHEN y % 2 = 0 THEN 'LL' ELSE 'LH' END ELSE CASE WHEN y % 2 = 0 THEN 'HL' ELSE 'HH' END END AS band FROM t_x)"""
    sums = lambda s: f"""{img}, sig AS (SELECT *, {s} AS s FROM img),
n AS (SELECT i.name, i.y, i.x, sum(CASE WHEN j.y = i.y THEN s ELSE 0 END)::INT AS h, sum(CASE WHEN j.x = i.x THEN s ELSE 0 END)::INT AS v2, sum(CASE WHEN j.y <> i.y AND j.x <> i.x THEN s ELSE 0 END)::INT AS d
  FROM img i JOIN sig j ON j.name = i.name AND abs(j.y - i.y) <= 1 AND abs(j.x - i.x) <= 1 AND (j.y <> i.y OR j.x <> i.x) GROUP BY ALL)"""  # noqa: E731
    hit = "(abs(v - 128) >= 64)::INT"
    low = "CASE WHEN {h} = 2 THEN 8 WHEN {h} = 1 THEN CASE WHEN {v} >= 1 THEN 7 WHEN d >= 1 THEN 6 ELSE 5 END WHEN {v} > 0 THEN {v} + 2 ELSE least(d, 2) END"
    limit = "CASE WHEN {w} BETWEEN {f} AND top THEN {w} ELSE {f} END"
    deep = "top >= 128"
    f1, f2 = "(least(top, 4095) + 128) // 256", "256 // (top + 1)"
    want = [f"CASE WHEN {deep} THEN {f1} * ({x} - {y}) + {y} + {z} * near ELSE greatest({y}, {x} // ({f2}) + {z} * near) END" for x, y, z in ((3, 2, 3), (7, 3, 5), (21, 4, 7))]
    return {
        "jpeg_recon_mae_by_quality": f"""WITH {coef}, q AS (SELECT * FROM (VALUES {tables}) t(quality, t)),
deq AS (SELECT vec_id, quality, pos, sign(coef) * floor(abs(coef) / t[pos + 1] + 0.5) * t[pos + 1] AS c FROM coef, q),
cols AS (SELECT vec_id, quality, pos // 8 AS u, x, sum(c * w) AS v FROM deq JOIN basis ON u = pos % 8 GROUP BY ALL),
back AS (SELECT vec_id, quality, b.x * 8 + c.x AS p, sum(v * w) AS v FROM cols c JOIN basis b ON b.u = c.u GROUP BY ALL)
SELECT quality::INT AS quality, round(avg(abs(px.v - back.v)), 4) AS mae FROM back JOIN px USING (vec_id, p) GROUP BY quality""",
        "ict_inverse": f"SELECT id, round(r + 1.402::DOUBLE * (b - 128), 6) AS red, round(r - 0.344136::DOUBLE * (g - 128) - 0.714136::DOUBLE * (b - 128), 6) AS green, round(r + 1.772::DOUBLE * (g - 128), 6) AS blue FROM ({px})",
        "chroma_upsample": "SELECT (range // 17)::INT AS y, (range % 17)::INT AS x, ((range // 17 // 2 * 9 + range % 17 // 2) * 255 // 44)::INT AS v FROM range(170)",
        "deinterleave_planes": f"SELECT id, comp::INT AS comp, (CASE comp WHEN 0 THEN r WHEN 1 THEN g ELSE b END)::INT AS v FROM ({px}), range(3) t(comp)",
        "interleave_pixels": f"SELECT id, concat(r, ',', g, ',', b) AS pixel FROM ({px})",
        "jpegls_error_mapping": "SELECT (range - 256)::INT AS e, (CASE WHEN range >= 256 THEN 2 * (range - 256) ELSE 511 - 2 * range END)::INT AS mapped FROM range(513)",
        "modulo_reduction": "SELECT (range - 255)::INT AS e, ((range - 255 + 128 + 256) % 256 - 128)::INT AS reduced FROM range(511)",
        "jpegls_default_thresholds": f"""WITH a AS (SELECT top::INT AS top, near::INT AS near, {want[0]} AS w1, {want[1]} AS w2, {want[2]} AS w3 FROM (SELECT unnest({TOPS}) AS top), (SELECT unnest({NEARS}) AS near) WHERE near <= top // 2),
b AS (SELECT *, {limit.format(w="w1", f="(near + 1)")} AS t1 FROM a), c AS (SELECT *, {limit.format(w="w2", f="t1")} AS t2 FROM b)
SELECT top, near, t1::INT AS t1, t2::INT AS t2, ({limit.format(w="w3", f="t2")})::INT AS t3 FROM c""",
        "dwt97_forward": f"WITH {signal}{chain} SELECT user_id, i, round(CASE WHEN n = 1 THEN w3 WHEN i % 2 = 1 THEN w3 * {bands.SCALE_97} ELSE w3 / {bands.SCALE_97} END, 4) AS w FROM l3",
        "dwt97_roundtrip": f"WITH {signal} SELECT user_id, count(*) AS n, true AS exact FROM s GROUP BY user_id",
        "dwt53_2d_one_level": f"WITH {plane} SELECT name, y, x, w, band FROM bands",
        "subband_rollup": f"WITH {plane} SELECT name, band, count(*) AS n, count(*) FILTER (w <> 0) AS nonzero FROM bands GROUP BY ROLLUP (name, band)",
        "stepsize_encode": f"SELECT event_id, ({DEPTH} - floor(log2(step)))::INT AS exponent, floor((step / pow(2.0, floor(log2(step))) - 1) * 2048)::INT AS mantissa FROM (SELECT event_id, abs(value)::DOUBLE + 0.3::DOUBLE AS step FROM events)",
        "significance_neighbors": f"WITH {sums(hit)} SELECT name, y, x, h, v2, d FROM n",
        "zc_context": f"""WITH {sums(hit)} SELECT name, y, x, ({low.format(h="h", v="v2")})::INT AS ll, ({low.format(h="v2", v="h")})::INT AS hl,
(CASE WHEN d >= 3 THEN 8 WHEN d = 2 THEN CASE WHEN h + v2 >= 1 THEN 7 ELSE 6 END ELSE 3 * d + least(h + v2, 2) END)::INT AS hh FROM n""",
        "sign_context": f"""WITH {sums(f"{hit} * CASE WHEN v < 128 THEN -1 ELSE 1 END")}, c AS (SELECT name, y, x, greatest(-1, least(1, h)) AS a, greatest(-1, least(1, v2)) AS b FROM n)
SELECT name, y, x, context::INT AS context, flip::INT AS flip FROM c JOIN (VALUES (1, 1, 13, 0), (1, 0, 12, 0), (1, -1, 11, 0), (0, 1, 10, 0), (0, 0, 9, 0), (0, -1, 10, 1), (-1, 1, 11, 1), (-1, 0, 12, 1), (-1, -1, 13, 1)) t(a, b, context, flip) USING (a, b)""",
        "tile_grid_geometry": f"""SELECT w::INT AS w, h::INT AS h, tx::INT AS tx, ty::INT AS ty, least({TILE}, w - tx * {TILE})::INT AS width, least({TILE}, h - ty * {TILE})::INT AS height
FROM (VALUES {", ".join(map(str, SIZES))}) s(w, h), range(8) t(tx), range(8) u(ty) WHERE tx * {TILE} < w AND ty * {TILE} < h""",
        "lossless_flag": f"WITH {img} SELECT name, bool_and(name = 'ramp' OR v % 4 = 0) AS lossless FROM img GROUP BY name",
        "rgb_stripes_fixture": "SELECT (range // 256)::INT AS y, (range % 256)::INT AS x, (CASE WHEN range % 256 < 85 THEN 255 ELSE 0 END)::INT AS r, (CASE WHEN range % 256 BETWEEN 85 AND 169 THEN 255 ELSE 0 END)::INT AS g, (CASE WHEN range % 256 >= 170 THEN 255 ELSE 0 END)::INT AS b FROM range(1024)",
        "ff_stuffing_count": "SELECT doc_id, len(list_filter(regexp_extract_all(sha256(coalesce(text, '')), '..'), lambda b: b = 'ff'))::BIGINT AS stuffed FROM documents",
        "huffman_bit_budget": f"""WITH {level}, d AS (SELECT e.label AS image, l.level - lag(l.level, 1, 0) OVER (PARTITION BY e.label ORDER BY vec_id) AS diff FROM levels l JOIN embeddings e USING (vec_id) WHERE pos = 0),
k AS (SELECT image, CASE WHEN diff = 0 THEN 0 ELSE length(bin(abs(diff))) END AS ssss FROM d),
t(symbol, size) AS (VALUES {", ".join(map(str, AC_LENGTHS.items()))}),
a AS (SELECT e.label AS image, run // 16 AS zrl, run % 16 * 16 + ssss AS symbol FROM runs JOIN embeddings e USING (vec_id) UNION ALL SELECT e.label, 0, 0 FROM scan JOIN embeddings e USING (vec_id) WHERE k = 63 AND level = 0)
SELECT image, 'dc' AS kind, sum({DC_LENGTHS}[ssss + 1] + ssss)::BIGINT AS bits FROM k GROUP BY image
UNION ALL SELECT image, 'ac', sum(coalesce(size, 16) + symbol % 16 + zrl * {AC_LENGTHS[0xF0]})::BIGINT FROM a LEFT JOIN t USING (symbol) GROUP BY image""",
    }
