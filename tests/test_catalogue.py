"""The library's own operators on small fixtures."""

import importlib
import sys

from pyspark.sql import functions as F

from pixelloom.functions import color, fixed
from pixelloom.operators import bands, planes, signals
from pixelloom.plans import catalogue


def test_zigzag_starts_and_ends_as_the_standard_has_it():
    order = fixed.zigzag()
    assert order[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and order[-1] == 63 and sorted(order) == list(range(64))


def test_quality_tables():
    assert fixed.scaled(50) == fixed.LUMINANCE and max(fixed.scaled(100)) == 1 and max(fixed.scaled(1)) == 255


def test_lossless_predictors(spark):
    row = spark.range(1).select(*(c.alias(f"p{k}") for k, c in color.predictors(F.lit(100), F.lit(200), F.lit(50)).items())).first()
    assert (row["p1"], row["p2"], row["p3"], row["p4"], row["p7"]) == (100, 200, 50, 250, 150)


def test_wavelet_round_trip(spark):
    rows = [(k, i, (i * i * 31 + k) % 97) for k in range(6) for i in range(2 + k)]
    s = spark.createDataFrame(rows, "k long, i long, v long")
    back = signals.unlifted_53(signals.lifted_53(s, "k", "i", "v"), "k", "i")
    assert back.where("back <> v OR back IS NULL").count() == 0


def test_dead_zone(spark):
    level, back = planes.dead_zone(F.lit(10.5), 2.0)
    assert tuple(spark.range(1).select(level, back).first()) == (5, 11.0)


def test_tiles_round_trip(spark):
    image = signals.gradient(spark, "odd", 11, 9)
    tiles = planes.tiled(image)
    assert tiles.count() == 4 and tiles.where("size(block) = 64").count() == 4
    assert planes.untiled(tiles, 11, 9).select("name", "y", "x", "v").exceptAll(image).count() == 0
    assert planes.untiled(tiles, 11, 9).count() == 99


def test_canonical_codes_are_free_of_prefixes(spark):
    rows = [("t", i, i, b) for i, b in enumerate([2, 3, 3, 3, 3, 3, 4, 5])]
    got = planes.canonical_codes(spark.createDataFrame(rows, "name string, idx int, symbol int, bits int")).collect()
    codes = [format(r["code"], f"0{r['bits']}b") for r in got]
    assert all(a == b or not b.startswith(a) for a in codes for b in codes)


def test_run_segments_cover_each_line(spark):
    rows = [("a", 0, x, v) for x, v in enumerate([5, 5, 1, 5, 5, 5])] + [("a", 1, 0, 5)]
    got = {(r["y"], r["start"], r["length"], r["v"]) for r in planes.segments(spark.createDataFrame(rows, "name string, y int, x int, v int")).collect()}
    assert got == {(0, 0, 2, 5), (0, 2, 1, 1), (0, 3, 3, 5), (1, 0, 1, 5)}


def test_tree_has_the_minimum_at_its_root(spark):
    image = signals.gradient(spark, "odd", 11, 9).withColumn("v", F.col("v") + 3)
    assert [r["v"] for r in planes.tag_tree(image, 5).where("level = 4").collect()] == [3]


def test_portable_graymap(spark):
    image = spark.createDataFrame([("a", 0, 1, 255), ("a", 0, 0, 7)], "name string, y int, x int, v int")
    assert bytes(planes.graymap(image).first()["file"]) == b"P5\n2 1\n255\n\x07\xff"


def test_entry_without_the_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "pixelloom.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert "dct8x8_energy" in entry.queries() and not any(k.startswith("op") for k in entry.queries())


def test_irreversible_wavelet_round_trip(spark):
    rows = [(k, i, (i * i * 31 + k) % 97) for k in range(4) for i in range(2 + k)] + [(9, i, 10 * (i + 1)) for i in range(8)]
    s = spark.createDataFrame(rows, "k long, i long, v long")
    waves = bands.lifted_97(s, "k", "i", "v")
    assert bands.unlifted_97(waves, "k", "i").where("abs(back - v) > 1e-6 OR back IS NULL").count() == 0
    flat = bands.lifted_97(spark.createDataFrame([(0, i, 50) for i in range(9)], "k long, i long, v long"), "k", "i", "v")
    assert flat.where("i % 2 = 1 AND abs(w) > 1e-6").count() == 0


def test_signals_of_one_sample(spark, tmp_path):
    """A user's only event is its own low sample, in all four queries."""
    rows = [(1, 7, 0, 2.5), (2, 5, 0, -1.3), (3, 5, 1, 4.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, value double").write.parquet(str(tmp_path / "events.parquet"))
    of = lambda name: sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect()))
    assert [x for x in of("dwt53_forward") if x[0] == 7] == [(7, 0, 25)]
    assert [x for x in of("dwt97_forward") if x[0] == 7] == [(7, 0, 25.0)]
    assert of("dwt53_roundtrip") == [(5, 2, 0), (7, 1, 0)] and of("dwt97_roundtrip") == [(5, 2, True), (7, 1, True)]


def test_contexts_at_their_ends(spark):
    of = lambda h, v, d, band: bands.zero_context(F.lit(h), F.lit(v), F.lit(d), band)
    want = {("LL", 2, 0, 0): 8, ("LL", 1, 0, 1): 6, ("LL", 0, 2, 4): 4, ("LL", 0, 0, 4): 2, ("HL", 0, 2, 0): 8, ("HH", 0, 0, 3): 8, ("HH", 1, 1, 1): 5, ("HH", 0, 0, 0): 0}
    got = spark.range(1).select(*(of(h, v, d, b).alias(str(i)) for i, (b, h, v, d) in enumerate(want))).first()
    assert list(got) == list(want.values())
    assert [tuple(spark.range(1).select(*bands.sign_context(F.lit(h), F.lit(v))).first()) for h, v in ((2, 1), (0, 0), (0, -2), (-1, -1))] == [(13, 0), (9, 0), (10, 1), (13, 1)]
