"""Codecs, streams and the operators on whole images."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelloom.codecs import jpeg, jpegls, segments
from pixelloom.operators import codec
from pixelloom.sources import streams
from pixelloom.streaming import arrivals


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(1, 9), st.integers(1, 3), st.integers(2, 16), st.integers(0, 3), st.sampled_from(["none", "line", "sample"]), st.integers(0, 2**31), st.booleans())
def test_lossless_round_trip(w, h, n, bits, near, layout, seed, smooth):
    near = min(near, (1 << bits) // 2 - 1)
    p = np.random.default_rng(seed).integers(0, 2 if smooth else 1 << bits, (h, w, n))
    got, deep = jpegls.decode(jpegls.encode(p, bits, near, layout))
    assert deep == bits and np.abs(got.astype(int) - p).max() <= near


def test_default_thresholds():
    assert jpegls.thresholds(255, 0) == (3, 7, 21) and jpegls.thresholds(4095, 0) == (18, 67, 276) and jpegls.thresholds(65535, 0) == (18, 67, 276)


@pytest.mark.parametrize("planar", [False, True])
@pytest.mark.parametrize("restart", [0, 3])
@pytest.mark.parametrize("n", [1, 3])
def test_another_decoder_reads_what_is_written(spark, n, restart, planar):
    y, x = np.mgrid[:19, :29]
    p = np.stack([(3 * x + 5 * y) % 256, 255 - 4 * x, 9 * y][:n], axis=2).astype(np.uint8)
    coded = jpeg.encode(p, 95, restart, planar)
    jvm = spark._jvm
    raster = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(coded)).getRaster()
    theirs = np.array([[[raster.getSample(b, a, c) for c in range(n)] for b in range(29)] for a in range(19)])
    own = jpeg.decode(coded)[0].astype(int)
    assert np.abs(own - theirs).max() <= 3 and np.abs(own - p).mean() < 4


def test_every_code_table_is_free_of_prefixes_and_short():
    r = np.random.default_rng(3)
    for many in (1, 2, 5, 200, 256):
        counts = np.zeros(256, int)
        counts[:many] = np.maximum(1, (2.0 ** r.uniform(0, 30, many)).astype(int))
        _, code, size = jpeg.table_of(counts)
        words = sorted(format(c, f"0{s}b") for c, s in zip(code[:many], size[:many], strict=True))
        assert max(map(len, words)) <= 16 and all(not b.startswith(a) for a, b in zip(words, words[1:], strict=False)) and all("0" in w for w in words)


def test_headers():
    bare = segments.wavelet_header_bytes(300, 200, 3, 12, 5, True, 128)
    head = segments.wavelet_header(bare)
    assert (head["width"], head["tiles"], head["levels"], head["reversible"], len(head["steps"])) == (300, 6, 5, True, 16)
    file = segments.JP2_SIGNATURE + segments.box("jp2h", segments.box("colr", b"\2\0\0icc")) + segments.box("jp2c", bare)
    assert segments.profile(file) == b"icc" and segments.codestream(file) == bare and segments.kind(file) == "jp2"
    assert segments.name_of(0xC2) == "SOF2" and segments.name_of(0xD3) == "RST3" and segments.name_of(0xE8) == "APP8"


def test_broken_bytes_stay_as_rows_with_errors(spark):
    good = jpegls.encode(np.arange(64).reshape(8, 8, 1))
    rows = [(0, good), (1, good[:-9]), (2, b""), (3, None), (4, b"\xff\xd8\xff\xc9\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00\xff\xd9")]
    df = spark.createDataFrame(rows, "id long, content binary").selectExpr("id", "content", "'x' AS error", "7 AS width")
    got = {r["id"]: r for r in codec.decode(df).collect()}
    assert got[0]["error"] is None and got[0]["width"] == 8 and bytes(got[0]["pixels"]) == bytes(range(64))
    assert all(got[i]["error"] and got[i]["pixels"] is None for i in range(1, 5)) and "SOF9" in got[4]["error"]
    assert codec.decode(df.where("id < 0")).count() == 0 and streams.image_info(df).where("error IS NULL").count() == 3
    assert streams.marker_segments(df, "id").where("error IS NOT NULL").count() == 3
    copies = {r["id"]: r for r in codec.transcode(df, "jpeg").collect()}
    assert copies[0]["error"] is None and copies[1]["content"] is None


def test_wrong_geometry_is_an_error(spark):
    df = spark.createDataFrame([(3, 2, 1, 8, b"12345"), (5, 1, 1, 8, b"12345"), (1, 1, 1, 8, None)], "width long, height long, components long, bits long, pixels binary")
    assert [r["error"] is None for r in codec.encode(df, "jpegls").collect()] == [False, True, False]


def test_files_that_arrive_are_decoded_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: arrivals.decode_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    for name, more in (("a.jls", 1), ("b.jls", 2)):
        (tmp_path / "in" / name).write_bytes(jpegls.encode(np.full((2, more, 1), 9)))
        run()
    assert sorted(r["width"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
