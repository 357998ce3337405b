"""Queries on rasters, levels and bytes, and their equivalents; the catalogue registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import color
from pixelloom.operators import planes, signals

RESTART, PLANES, TREE_LEVELS = 4, 8, 6
WIDTH, HEIGHT = 20, 13
SIZES = [512, 511, 13, 1]
#: The number of codes of each length from 1 to 16 of the standard's luminance DC table; its symbols are 0 to 11.
DC_LUMINANCE_BITS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]


def build(levels: Callable, raster: Callable, rgb: Callable) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries over the catalogue's inputs: levels(spark, sf_dir) of blocks, raster(spark) and rgb(spark)."""

    def dc(spark, sf_dir):
        image = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label").alias("image"))
        return levels(spark, sf_dir).where("pos = 0").select("vec_id", F.col("level").alias("dc")).join(image, "vec_id")

    def deadzone_quantize(spark, sf_dir):
        q, back = planes.dead_zone(F.col("value"), 2.0)
        return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", q.alias("level"), back.alias("recon"))

    def dc_differential(spark, sf_dir):
        return planes.differences(dc(spark, sf_dir), "image", "vec_id", "dc").select("image", "vec_id", "mcu", "diff")

    def dc_restart_groups(spark, sf_dir):
        return planes.differences(dc(spark, sf_dir), "image", "vec_id", "dc", RESTART).select("image", "vec_id", "restart", "diff")

    def bitplane_census(spark, sf_dir):
        return planes.bit_planes(levels(spark, sf_dir), PLANES)

    def msb_per_codeblock(spark, sf_dir):
        return planes.top_bits(levels(spark, sf_dir), "vec_id")

    def tag_tree_levels(spark, sf_dir):
        return planes.tag_tree(raster(spark), TREE_LEVELS)

    def jpegls_gradient_context(spark, sf_dir):
        return planes.contexts(raster(spark)).select("name", "y", "x", "context")

    def jpegls_context_histogram(spark, sf_dir):
        return jpegls_gradient_context(spark, sf_dir).groupBy("name", "context").agg(F.count("*").alias("n"))

    def jpegls_run_segments(spark, sf_dir):
        return planes.segments(raster(spark).withColumn("v", F.floor(F.col("v") / 64)))

    def block_tiling(spark, sf_dir):
        return planes.tiled(signals.gradient(spark, "odd", WIDTH, HEIGHT)).select("name", "by", "bx", F.posexplode("block").alias("pos", "v"))

    def block_reassembly(spark, sf_dir):
        return planes.untiled(planes.tiled(signals.gradient(spark, "odd", WIDTH, HEIGHT)), WIDTH, HEIGHT)

    def huffman_canonical_codes(spark, sf_dir):
        bits = [n + 1 for n, many in enumerate(DC_LUMINANCE_BITS) for _ in range(many)]
        return planes.canonical_codes(spark.createDataFrame([("dc", i, i, b) for i, b in enumerate(bits)], "name string, idx int, symbol int, bits int"))

    def first_mismatch(spark, sf_dir):
        pairs = raster(spark).withColumn("w", F.floor(F.col("v") / 4) * 4)
        return planes.first_difference(pairs, "name", F.col("y") * 32 + F.col("x"), "w", "v")

    def byte_histogram(spark, sf_dir):
        return planes.byte_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")

    def ppm_export(spark, sf_dir):
        return planes.graymap(raster(spark)).select("name", F.hex("file").alias("file_hex"))

    def rct_inverse(spark, sf_dir):
        r, g, b = color.rct_inverse(F.col("r"), F.col("g") - 128, F.col("b") - 128)
        return rgb(spark).select("id", r.alias("red"), g.alias("green"), b.alias("blue"))

    def checker_fixture(spark, sf_dir):
        i = F.col("id")
        at = spark.range(64).select(F.floor(i / 8).cast("int").alias("y"), (i % 8).cast("int").alias("x"))
        return at.withColumn("v", F.when(F.col("y") % 2 == F.col("x") % 2, 255).otherwise(0))

    def subband_geometry(spark, sf_dir):
        n = spark.createDataFrame([(s,) for s in SIZES], "n long").select("n", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("level"))
        low = lambda k: F.ceil(F.col("n") / F.pow(F.lit(2.0), k))
        return n.select("n", "level", low(F.col("level")).alias("low"), (low(F.col("level") - 1) - low(F.col("level"))).alias("high"))

    every = (
        deadzone_quantize, dc_differential, dc_restart_groups, bitplane_census, msb_per_codeblock, tag_tree_levels, jpegls_gradient_context, jpegls_context_histogram,
        jpegls_run_segments, block_tiling, block_reassembly, huffman_canonical_codes, first_mismatch, byte_histogram, ppm_export, rct_inverse, checker_fixture, subband_geometry,
    )
    return {f.__name__: f for f in every}


def oracles(levels: str, image: str, px: str) -> dict[str, str]:
    """The same in SQL, with the catalogue's common table expressions of its inputs."""
    dc = f"WITH {levels}, dc AS (SELECT label AS image, vec_id, level AS dc, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS mcu FROM levels JOIN embeddings USING (vec_id) WHERE pos = 0)"
    side = "CASE WHEN abs({0}) = 0 THEN 0 WHEN abs({0}) < 3 THEN 1 WHEN abs({0}) < 7 THEN 2 WHEN abs({0}) < 21 THEN 3 ELSE 4 END * sign({0})"
    q = [side.format(f"({g})") for g in ("d - b", "b - c", "c - a")]
    context = f"""WITH {image}, e AS (SELECT i.name, i.y, i.x, coalesce(u.v, 0) AS b, coalesce(l.v, u.v, 0) AS a, CASE WHEN i.x > 0 THEN coalesce(ul.v, 0) ELSE coalesce(uu.v, 0) END AS c, coalesce(ur.v, u.v, 0) AS d FROM img i
LEFT JOIN img u ON u.name = i.name AND u.y = i.y - 1 AND u.x = i.x LEFT JOIN img l ON l.name = i.name AND l.y = i.y AND l.x = i.x - 1
LEFT JOIN img ul ON ul.name = i.name AND ul.y = i.y - 1 AND ul.x = i.x - 1 LEFT JOIN img uu ON uu.name = i.name AND uu.y = i.y - 2 AND uu.x = i.x
LEFT JOIN img ur ON ur.name = i.name AND ur.y = i.y - 1 AND ur.x = i.x + 1),
ctx AS (SELECT name, y, x, abs((({q[0]}) * 9 + ({q[1]})) * 9 + ({q[2]}))::BIGINT AS context FROM e)"""
    odd = f"odd AS (SELECT (range // {WIDTH})::BIGINT AS y, (range % {WIDTH})::BIGINT AS x, (range * 255 // {WIDTH * HEIGHT - 1})::INT AS v FROM range({WIDTH * HEIGHT}))"
    return {
        "deadzone_quantize": "SELECT event_id, q AS level, (sign(q) * (abs(q) + 0.5) * 2)::DOUBLE AS recon FROM (SELECT event_id, (sign(value) * floor(abs(value) / 2))::BIGINT AS q FROM events)",
        "dc_differential": f"{dc} SELECT image, vec_id, mcu, dc - lag(dc, 1, 0) OVER (PARTITION BY image ORDER BY mcu) AS diff FROM dc",
        "dc_restart_groups": f"{dc} SELECT image, vec_id, (mcu // {RESTART})::BIGINT AS restart, dc - lag(dc, 1, 0) OVER (PARTITION BY image, mcu // {RESTART} ORDER BY mcu) AS diff FROM dc",
        "bitplane_census": f"WITH {levels} SELECT plane::INT AS plane, sum((abs(level) >> plane::INT) & 1)::BIGINT AS ones FROM levels, range({PLANES}) t(plane) GROUP BY plane",
        "msb_per_codeblock": f"WITH {levels} SELECT vec_id, max(abs(level)) AS top, (CASE WHEN max(abs(level)) = 0 THEN 0 ELSE length(bin(max(abs(level)))) END)::INT AS planes FROM levels GROUP BY vec_id",
        "tag_tree_levels": f"WITH {image} SELECT name, l::INT AS level, (y >> l::INT)::INT AS ny, (x >> l::INT)::INT AS nx, min(v) AS v FROM img, range({TREE_LEVELS}) t(l) GROUP BY ALL",
        "jpegls_gradient_context": f"{context} SELECT name, y, x, context FROM ctx",
        "jpegls_context_histogram": f"{context} SELECT name, context, count(*) AS n FROM ctx GROUP BY ALL",
        "jpegls_run_segments": f"""WITH {image}, s AS (SELECT name, y, x, (v // 64)::BIGINT AS v FROM img), g AS (SELECT *, x - row_number() OVER (PARTITION BY name, y, v ORDER BY x) AS run FROM s)
SELECT name, y, min(x) AS start, count(*) AS length, v FROM g GROUP BY name, y, v, run""",
        "block_tiling": f"""WITH {odd} SELECT 'odd' AS name, "by", bx, p::INT AS pos, coalesce(v, 0) AS v FROM range({-(-HEIGHT // 8)}) t("by"), range({-(-WIDTH // 8)}) s(bx), range(64) r(p) LEFT JOIN odd ON y = "by" * 8 + p // 8 AND x = bx * 8 + p % 8""",
        "block_reassembly": f"WITH {odd} SELECT 'odd' AS name, y, x, v FROM odd",
        "huffman_canonical_codes": f"""WITH b AS (SELECT unnest(range(1, 17))::INT AS bits, unnest({DC_LUMINANCE_BITS}) AS many), e AS (SELECT bits, unnest(range(many)) AS k FROM b),
s AS (SELECT (row_number() OVER (ORDER BY bits, k) - 1)::INT AS idx, bits FROM e)
SELECT 'dc' AS name, idx, idx AS symbol, bits, (coalesce(sum(pow(2.0, -bits)) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * pow(2.0, bits))::BIGINT AS code FROM s""",
        "first_mismatch": f"WITH {image}, m AS (SELECT name, y * 32 + x AS pos, (v // 4 * 4)::BIGINT AS got, v AS expected FROM img WHERE v % 4 <> 0) SELECT name, min(pos) AS pos, arg_min(got, pos) AS got, arg_min(expected, pos) AS expected FROM m GROUP BY name",
        "byte_histogram": "SELECT byte, count(*) AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents) GROUP BY byte",
        "ppm_export": f"WITH {image} SELECT name, hex(encode('P5' || chr(10) || '32 24' || chr(10) || '255' || chr(10))) || string_agg(printf('%02X', v), '' ORDER BY y, x) AS file_hex FROM img GROUP BY name",
        "rct_inverse": f"SELECT id, (b - 128 + t)::INT AS red, t::INT AS green, (g - 128 + t)::INT AS blue FROM (SELECT *, r - floor((g + b - 256) / 4)::INT AS t FROM ({px}))",
        "checker_fixture": "SELECT (range // 8)::INT AS y, (range % 8)::INT AS x, CASE WHEN (range // 8) % 2 = range % 8 % 2 THEN 255 ELSE 0 END AS v FROM range(64)",
        "subband_geometry": f"SELECT n, l::INT AS level, ceil(n / pow(2.0, l))::BIGINT AS low, (ceil(n / pow(2.0, l - 1)) - ceil(n / pow(2.0, l)))::BIGINT AS high FROM (SELECT unnest({SIZES})::BIGINT AS n), range(1, 6) t(l)",
    }
