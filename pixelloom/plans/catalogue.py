"""The registered queries of the library and, where SQL can express them, their equivalents for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import color, fixed
from pixelloom.operators import blocks, signals

from . import formats, images, more, planes

QUALITIES = (10, 50, 90)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of `embeddings` as blocks of samples."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 100).alias("block"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("vec_id", F.posexplode("block").alias("pos", "v"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.quantised(blocks.coefficients(_blocks(spark, sf_dir), "vec_id", "block"), fixed.LUMINANCE)


def _raster(spark: SparkSession) -> DataFrame:
    """Two images whose samples follow from their places."""
    i = F.col("id")
    rough = spark.range(32 * 24).select(F.lit("rough").alias("name"), F.floor(i / 32).cast("int").alias("y"), (i % 32).cast("int").alias("x"), ((i * i * 7 + i * 13) % 256).cast("int").alias("v"))
    return signals.gradient(spark, "ramp", 32, 24).unionByName(rough)


def _rgb(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(4096).select("id", (i * 37 % 256).cast("int").alias("r"), (i * 91 % 256).cast("int").alias("g"), (i * 7 % 256).cast("int").alias("b"))


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each user's events in order of time, as whole numbers."""
    order = F.row_number().over(signals.Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", order.alias("i"), F.floor(F.col("value") * 10).cast("long").alias("v"))


def dct8x8_coeffs(spark, sf_dir):
    return blocks.coefficients(_blocks(spark, sf_dir), "vec_id", "block").select("vec_id", "pos", F.round("coef", 4).alias("coef"))


def dct8x8_energy(spark, sf_dir):
    c = blocks.coefficients(_blocks(spark, sf_dir), "vec_id", "block")
    return c.groupBy("pos").agg(F.round(F.sum(F.col("coef") * F.col("coef")), 2).alias("energy"))


def idct_roundtrip_error(spark, sf_dir):
    c = blocks.coefficients(_blocks(spark, sf_dir), "vec_id", "block")
    whole = F.transform(F.sort_array(F.collect_list(F.struct("pos", "coef"))), lambda s: s["coef"])
    back = blocks.coefficients(c.groupBy("vec_id").agg(whole.alias("c")), "vec_id", "c", True)
    error = F.max(F.abs(F.col("v") - F.col("coef")))
    return back.join(_samples(spark, sf_dir), ["vec_id", "pos"]).groupBy("vec_id").agg((error < 1e-6).alias("exact"))


def quantize_q50(spark, sf_dir):
    return _levels(spark, sf_dir).select("vec_id", "pos", "level")


def zigzag_scan(spark, sf_dir):
    return blocks.scanned(_levels(spark, sf_dir)).select("vec_id", "k", "level")


def ac_zero_runs(spark, sf_dir):
    return blocks.zero_runs(blocks.scanned(_levels(spark, sf_dir)), "vec_id")


def ssss_histogram(spark, sf_dir):
    return ac_zero_runs(spark, sf_dir).groupBy("run", "ssss").agg(F.count("*").alias("n"))


def quality_scaled_tables(spark, sf_dir):
    rows = [(q, p, v) for q in QUALITIES for p, v in enumerate(fixed.scaled(q))]
    return spark.createDataFrame(rows, "quality int, pos int, q int")


def rgb_to_ycbcr(spark, sf_dir):
    y, cb, cr = color.rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return _rgb(spark).select("id", y.alias("y"), cb.alias("cb"), cr.alias("cr"))


def ycbcr_to_rgb(spark, sf_dir):
    r, g, b = color.ycbcr_to_rgb(F.col("r"), F.col("g"), F.col("b"))
    return _rgb(spark).select("id", r.alias("red"), g.alias("green"), b.alias("blue"))


def rct_roundtrip(spark, sf_dir):
    y, u, v = color.rct_forward(F.col("r"), F.col("g"), F.col("b"))
    one = _rgb(spark).select("*", y.alias("y"), u.alias("u"), v.alias("v"))
    r, g, b = color.rct_inverse(F.col("y"), F.col("u"), F.col("v"))
    return one.select("id", "y", "u", "v", ((r == F.col("r")) & (g == F.col("g")) & (b == F.col("b"))).alias("exact"))


def med_predictor_residuals(spark, sf_dir):
    return signals.residuals(_raster(spark))


def lossless_predictors_1_7(spark, sf_dir):
    guessed = signals.predicted(_raster(spark), 128)
    return guessed.groupBy("name").agg(*(F.sum(F.abs(F.col("v") - F.col(f"p{k}"))).cast("long").alias(f"error{k}") for k in range(8)))


def dwt53_forward(spark, sf_dir):
    return signals.lifted_53(_signal(spark, sf_dir), "user_id", "i", "v").select("user_id", "i", "w")


def dwt53_roundtrip(spark, sf_dir):
    back = signals.unlifted_53(signals.lifted_53(_signal(spark, sf_dir), "user_id", "i", "v"), "user_id", "i")
    return back.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("back") == F.col("v"), 0).otherwise(1)).alias("wrong"))


def image_quality_metrics(spark, sf_dir):
    pairs = _raster(spark).withColumn("w", F.floor(F.col("v") / 4) * 4)
    m = signals.compared(pairs, "name", "v", "w", 255)
    return m.select("name", F.round("mae", 6).alias("mae"), "max_diff", F.round("psnr", 6).alias("psnr"), "lossless")


def gradient_fixture(spark, sf_dir):
    return signals.gradient(spark, "ramp", 64, 64)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        dct8x8_coeffs, dct8x8_energy, idct_roundtrip_error, quantize_q50, zigzag_scan, ac_zero_runs, ssss_histogram, quality_scaled_tables, rgb_to_ycbcr,
        ycbcr_to_rgb, rct_roundtrip, med_predictor_residuals, lossless_predictors_1_7, dwt53_forward, dwt53_roundtrip, image_quality_metrics, gradient_fixture,
    )
} | planes.build(_levels, _raster, _rgb) | more.build(_blocks, _levels, _raster, _rgb, _signal) | images.QUERIES | formats.build(_blocks, _levels, _raster, _rgb, _signal)

FLAGSHIP = dct8x8_energy

_B = "SELECT u, x, CASE WHEN u = 0 THEN sqrt(0.125) ELSE 0.5 END * cos((2 * x + 1) * u * pi() / 16) AS w FROM range(8) t(u), range(8) s(x)"
_COEF = f"""
basis AS ({_B}),
px AS (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding)::DOUBLE * 100 AS v FROM embeddings),
rows_ AS (SELECT vec_id, p // 8 AS y, u, sum(v * w) AS v FROM px JOIN basis ON x = p % 8 GROUP BY ALL),
coef AS (SELECT vec_id, (b.u * 8 + r.u)::INT AS pos, sum(v * w) AS coef FROM rows_ r JOIN basis b ON b.x = y GROUP BY ALL)"""
_LEVEL = f"""{_COEF},
levels AS (SELECT vec_id, pos, (sign(coef) * floor(abs(coef) / ({fixed.LUMINANCE})[pos + 1] + 0.5))::INT AS level FROM coef),
scan AS (SELECT vec_id, (list_position({fixed.zigzag()}, pos) - 1)::INT AS k, level FROM levels),
runs AS (SELECT vec_id, k, level, (k - lag(k, 1, 0) OVER (PARTITION BY vec_id ORDER BY k) - 1)::INT AS run, length(bin(abs(level)))::INT AS ssss FROM scan WHERE k > 0 AND level <> 0)"""
_PX = "SELECT range AS id, range * 37 % 256 AS r, range * 91 % 256 AS g, range * 7 % 256 AS b FROM range(4096)"
_IMG = """img AS (
  SELECT 'ramp' AS name, (range // 32)::INT AS y, (range % 32)::INT AS x, (range * 255 // 767)::INT AS v FROM range(768)
  UNION ALL SELECT 'rough', (range // 32)::INT, (range % 32)::INT, ((range * range * 7 + range * 13) % 256)::INT FROM range(768)),
side AS (SELECT i.*, l.v AS l, u.v AS u, d.v AS d, t.v AS t FROM img i
  LEFT JOIN img l ON l.name = i.name AND l.y = i.y AND l.x = i.x - 1 LEFT JOIN img u ON u.name = i.name AND u.y = i.y - 1 AND u.x = i.x
  LEFT JOIN img d ON d.name = i.name AND d.y = i.y - 1 AND d.x = i.x - 1 LEFT JOIN img t ON t.name = i.name AND t.y = i.y - 2 AND t.x = i.x),
near AS (SELECT name, y, x, v, coalesce(CASE WHEN x = 0 THEN u ELSE l END, 0) AS a, coalesce(u, 0) AS b, coalesce(CASE WHEN x = 0 THEN t ELSE d END, 0) AS c FROM side),
edge AS (SELECT name, y, x, v, l AS a, u AS b, d AS c, CASE WHEN y = 0 AND x = 0 THEN 128 WHEN y = 0 THEN l WHEN x = 0 THEN u END AS e FROM side)"""
_DWT = """s0 AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, floor(value * 10)::BIGINT AS v, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT * FROM s0),
h AS (SELECT o.user_id, o.i, o.v - floor((l.v + coalesce(r.v, l.v)) / 2)::BIGINT AS d FROM s o JOIN s l ON l.user_id = o.user_id AND l.i = o.i - 1 LEFT JOIN s r ON r.user_id = o.user_id AND r.i = o.i + 1 WHERE o.i % 2 = 1),
w AS (SELECT user_id, i, d AS w FROM h UNION ALL
  SELECT e.user_id, e.i, e.v + coalesce(floor((coalesce(l.d, r.d) + coalesce(r.d, l.d) + 2) / 4)::BIGINT, 0) FROM s e LEFT JOIN h l ON l.user_id = e.user_id AND l.i = e.i - 1 LEFT JOIN h r ON r.user_id = e.user_id AND r.i = e.i + 1 WHERE e.i % 2 = 0)"""
_CLAMP = "greatest(0, least(255, floor({} + 0.5)))::INT"

ORACLES: dict[str, str] = {
    "dct8x8_coeffs": f"WITH {_COEF} SELECT vec_id, pos, round(coef, 4) AS coef FROM coef",
    "dct8x8_energy": f"WITH {_COEF} SELECT pos, round(sum(coef * coef), 2) AS energy FROM coef GROUP BY pos",
    "idct_roundtrip_error": "SELECT vec_id, true AS exact FROM embeddings",
    "quantize_q50": f"WITH {_LEVEL} SELECT vec_id, pos, level FROM levels",
    "zigzag_scan": f"WITH {_LEVEL} SELECT vec_id, k, level FROM scan",
    "ac_zero_runs": f"WITH {_LEVEL} SELECT vec_id, k, level, run, ssss FROM runs",
    "ssss_histogram": f"WITH {_LEVEL} SELECT run, ssss, count(*) AS n FROM runs GROUP BY ALL",
    "quality_scaled_tables": f"""SELECT quality::INT AS quality, (p - 1)::INT AS pos, greatest(1, least(255, (({fixed.LUMINANCE})[p] * (CASE WHEN quality < 50 THEN 5000 // quality ELSE 200 - 2 * quality END) + 50) // 100))::INT AS q
FROM (SELECT unnest({list(QUALITIES)}) AS quality), range(1, 65) t(p)""",
    "rgb_to_ycbcr": f"SELECT id, {_CLAMP.format('0.299 * r + 0.587 * g + 0.114 * b')} AS y, {_CLAMP.format('-0.168736 * r - 0.331264 * g + 0.5 * b + 128')} AS cb, {_CLAMP.format('0.5 * r - 0.418688 * g - 0.081312 * b + 128')} AS cr FROM ({_PX})",
    "ycbcr_to_rgb": f"SELECT id, {_CLAMP.format('r + 1.402 * (b - 128)')} AS red, {_CLAMP.format('r - 0.344136 * (g - 128) - 0.714136 * (b - 128)')} AS green, {_CLAMP.format('r + 1.772 * (g - 128)')} AS blue FROM ({_PX})",
    "rct_roundtrip": f"SELECT id, ((r + 2 * g + b) // 4)::INT AS y, (b - g)::INT AS u, (r - g)::INT AS v, true AS exact FROM ({_PX})",
    "med_predictor_residuals": f"""WITH {_IMG}, e AS (SELECT name, y, x, v - CASE WHEN c >= greatest(a, b) THEN least(a, b) WHEN c <= least(a, b) THEN greatest(a, b) ELSE a + b - c END AS residual FROM near)
SELECT name, y, x, residual::INT AS residual, (CASE WHEN residual >= 0 THEN 2 * residual ELSE -2 * residual - 1 END)::INT AS mapped FROM e""",
    "lossless_predictors_1_7": f"""WITH {_IMG} SELECT name, {", ".join(f"sum(abs(v - coalesce(e, {p})))::BIGINT AS error{k}" for k, p in enumerate(("0", "a", "b", "c", "a + b - c", "a + floor((b - c) / 2)", "b + floor((a - c) / 2)", "floor((a + b) / 2)")))} FROM edge GROUP BY name""",
    "dwt53_forward": f"WITH {_DWT} SELECT user_id, i, w FROM w",
    "dwt53_roundtrip": f"WITH {_DWT} SELECT user_id, count(*) AS n, 0::BIGINT AS wrong FROM s GROUP BY user_id",
    "image_quality_metrics": f"""WITH {_IMG}, d AS (SELECT name, v - v // 4 * 4 AS d FROM img)
SELECT name, round(avg(d), 6) AS mae, max(d)::BIGINT AS max_diff, round(10 * log10(65025.0 / avg(d * d)), 6) AS psnr, max(d) = 0 AS lossless FROM d GROUP BY name""",
    "gradient_fixture": "SELECT 'ramp' AS name, (range // 64)::INT AS y, (range % 64)::INT AS x, (range * 255 // 4095)::INT AS v FROM range(4096)",
} | planes.oracles(_LEVEL, _IMG, _PX) | more.oracles(_COEF, _LEVEL, _IMG, _PX, _DWT) | images.ORACLES | formats.oracles(_COEF, _LEVEL, _IMG, _PX, _DWT)
