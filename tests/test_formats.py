"""Wavelet, progressive and lossless coding, headers, sinks and wavelet planes."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelloom import __main__ as cli
from pixelloom.codecs import arithmetic, codeblocks, jpeg, jpegls, lifting, lossless, quads, segments, wavelet
from pixelloom.functions import fixed
from pixelloom.operators import bands, blocks, codec, planes, signals
from pixelloom.plans import formats
from pixelloom.sources import extension, sinks, streams


def picture(h, w, n, bits=8, seed=0):
    y, x = np.mgrid[:h, :w]
    top = (1 << bits) - 1
    noise = np.random.default_rng(seed).integers(0, top // 8 + 1, (h, w))
    base = [x * top // max(1, w - 1), y * top // max(1, h - 1), (x // 3 + y // 5) % 2 * (top // 2) + noise]
    return np.stack([base[i % 3] for i in range(n)], axis=2)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**31), st.integers(0, 300))
def test_arithmetic_round_trip(seed, n):
    r = random.Random(seed)
    contexts, odds = [r.randrange(5) for _ in range(n)], [r.random() for _ in range(5)]
    bits = [int(r.random() < odds[c]) for c in contexts]
    coder = arithmetic.Encoder([0, 4, 3, 46, 0])
    for c, b in zip(contexts, bits):
        coder.code(c, b)
    data = coder.done()
    reader = arithmetic.Decoder([0, 4, 3, 46, 0], data)
    assert [reader.code(c) for c in contexts] == bits and b"\xff\x90" not in data


def test_code_block_of_the_standards_example():
    """The vertical high band of the worked example of T.800: four samples from its three bytes."""
    got, _ = codeblocks.decode(bytes.fromhex("0FB176"), 1, 4, codeblocks.LH, 3, 7)
    assert got.ravel().tolist() == [1, 5, 1, 0]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 21), st.integers(1, 21), st.integers(0, 3), st.sampled_from([0.3, 3, 400]), st.integers(0, 2**31))
def test_code_blocks_round_trip(h, w, band, spread, seed):
    v = np.random.default_rng(seed).laplace(0, spread, (h, w)).astype(int)
    data, n, many = codeblocks.encode(v, band)
    if n:
        got, last = codeblocks.decode(data, w, h, band, n, many)
        assert (got == v).all() and last == 0
        part, last = codeblocks.decode(data, w, h, band, n, many - min(many - 1, 4))  # fewer passes: what is left is near
        assert (np.abs(part - v) < 1 << last + 1).all()
    streams_ = quads.encode(v)
    assert (quads.decode(streams_, h, w) == v).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.integers(1, 20), st.integers(0, 9), st.integers(0, 9), st.integers(0, 4), st.booleans())
def test_lifting_round_trip(h, w, y0, x0, n, reversible):
    p = np.random.default_rng(h * w).integers(-99, 99, (h, w))
    assert np.allclose(lifting.unlevels(*lifting.levels(p, y0, x0, n, reversible), y0, x0, reversible), p, atol=1e-8)


def test_tag_tree():
    r = random.Random(3)
    assert sum(h * w for h, w in wavelet.TagTree(3, 3).shapes) == 14
    for h, w in ((1, 1), (2, 2), (3, 5), (7, 2)):
        values = [r.randrange(6) for _ in range(h * w)]
        out, asked = wavelet.HeaderWriter(), [(r.randrange(h * w), r.randint(1, 7)) for _ in range(60)]
        tree = wavelet.TagTree(h, w, values)
        said = [tree.code(i, t, out) for i, t in asked]
        out.put(0, 7)
        reader, back = wavelet.HeaderReader(out.done(), 0), wavelet.TagTree(h, w)
        assert said == [values[i] < t for i, t in asked] == [back.code(i, t, reader) for i, t in asked]


def test_numbers_of_passes():
    for n in range(1, 165):
        out = wavelet.HeaderWriter()
        wavelet.put_passes(out, n)
        out.put(0, 7)
        assert wavelet.read_passes(wavelet.HeaderReader(out.done(), 0)) == n


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.sampled_from([1, 2, 3]), st.integers(1, 16), st.integers(0, 5), st.sampled_from([0, 7, 16]), st.sampled_from(wavelet.PROGRESSIONS), st.sampled_from([(6, 15), (2, 3), (3, 4)]), st.booleans())
def test_wavelet_images_round_trip(h, w, n, bits, levels, tile, progression, sides, boxed):
    p = picture(h, w, n, bits, h)
    got, deep = wavelet.decode(wavelet.encode(p, bits, levels, tile=tile, progression=progression, block=sides[0], precinct=sides[1], boxed=boxed))
    assert deep == bits and (got == p).all()


def test_lossy_wavelet_images_are_near():
    p = picture(50, 61, 3)
    sizes = []
    for step, most, mean in ((1 / 32, 0, 0), (0.5, 2, 0.5), (8, 48, 10)):
        data = wavelet.encode(p, reversible=False, step=step)
        sizes.append(len(data))
        gap = np.abs(wavelet.decode(data)[0].astype(int) - p)
        assert gap.max() <= most and gap.mean() <= mean
    assert sizes == sorted(sizes, reverse=True)


def _segments_between(data, first, more):
    """The stream with segments put in before its first tile part."""
    at = data.index(first)
    return data[:at] + more + data[at:]


def test_wavelet_regions_markers_and_broken_streams():
    p = picture(16, 16, 1)
    data = wavelet.encode(p, levels=1)
    # A packet may be announced by a marker, and an empty one tells nothing.
    main, parts = wavelet.tile_parts(data)
    tile = wavelet.Tile(parts[0][3], 0)
    body, at, marked = parts[0][4], 0, b""
    for k, (layer, precinct) in enumerate(tile.packets()):
        end = wavelet.read_packet(body, at, layer, precinct, 0)
        marked += b"\xff\x91\x00\x04" + k.to_bytes(2, "big") + body[at:end]
        at = end
    head = data[: data.index(b"\xff\x90")]
    whole = head + segments.segment(0x90, (0).to_bytes(2, "big") + (14 + len(marked)).to_bytes(4, "big") + b"\0\1") + b"\xff\x93" + marked + b"\xff\xd9"
    assert (wavelet.decode(whole)[0] == p).all()
    # Two tile parts, the second without a size.
    half = wavelet.read_packet(body, 0, 0, next(iter(wavelet.Tile(parts[0][3], 0).packets()))[1], 0)
    part = lambda k, b, size: segments.segment(0x90, (0).to_bytes(2, "big") + size.to_bytes(4, "big") + bytes([k, 2])) + b"\xff\x93" + b
    assert (wavelet.decode(head + part(0, body[:half], 14 + half) + part(1, body[half:], 0) + b"\xff\xd9")[0] == p).all()
    assert [t[1:4] for t in segments.tile_parts(head + part(0, body[:half], 14 + half) + part(1, body[half:], 0) + b"\xff\xd9")] == [(0, 0, 2), (0, 1, 2)]
    for bad in (data[:-20], data[:30], data.replace(b"\xff\x5c", b"\xff\x63"), _segments_between(data, b"\xff\x90", segments.segment(0x5F, b"1234567"))):
        with pytest.raises(ValueError):
            wavelet.decode(bad)


def test_region_shift():
    """All coefficients moved up by the shift that the header says, so that all belong to the region."""
    p = picture(12, 12, 1)
    plain = wavelet.encode(p, levels=1)
    head = wavelet.Head()
    for code, body in ((c, b) for c, b in _main(plain)):
        head.take(code, body)
    head.shifts[0] = 3
    tile = wavelet.Tile(head, 0)
    style = head.style(0)
    low, details = lifting.levels(p[..., 0].astype(int) - 128, 0, 0, 1, True)
    for (bands_, precincts), values in zip(tile.resolutions[0], [(low,), *details]):
        for b, v in zip(bands_, values):
            b.values = v << 3
        for precinct in precincts:
            for _, _, pieces in precinct.groups:
                for q in pieces:
                    b = q.band
                    q.data, q.planes, q.passes = codeblocks.encode(b.values[q.y0 - b.y0 : q.y1 - b.y0, q.x0 - b.x0 : q.x1 - b.x0], b.kind)
                    q.zero = style.guard + style.step(b.number)[0] - 1 + 3 - q.planes
    body = b"".join(wavelet.write_packet(q) for _, q in tile.packets())
    start = plain.index(b"\xff\x90")
    data = plain[:start] + segments.segment(0x5E, bytes([0, 0, 3])) + segments.segment(0x90, (0).to_bytes(2, "big") + (14 + len(body)).to_bytes(4, "big") + b"\0\1") + b"\xff\x93" + body + b"\xff\xd9"
    assert (wavelet.decode(data)[0] == p).all()


def _main(data):
    at = 2
    while data[at + 1] != 0x90:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        yield data[at + 1], data[at + 4 : at + 2 + size]
        at += 2 + size


@pytest.mark.parametrize("n", [1, 3])
def test_progressive_streams_of_others_and_for_others(spark, n):
    jvm = spark._jvm
    p = picture(37, 29, n).astype(np.uint8)
    coded = jpeg.encode(p, 85, progressive=True)
    assert (jpeg.decode(coded)[0] == jpeg.decode(jpeg.encode(p, 85))[0]).all()
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(coded))
    raster = image.getRaster()
    theirs = np.array([[[raster.getSample(b, a, c) for c in range(n)] for b in range(29)] for a in range(37)])
    assert np.abs(jpeg.decode(coded)[0].astype(int) - theirs).max() <= 3
    # Written by the other library (subsampled, where there are colours): its progressive and its baseline stream have equal levels.
    streams_ = [written_by_java(jvm, image, p) for p in (True, False)]
    assert [any(c == 0xC2 for _, c, _ in segments.walk(d)) for d in streams_] == [True, False]
    ours = [jpeg.decode(d)[0].astype(int) for d in streams_]
    assert (ours[0] == ours[1]).all()
    if n == 1:
        raster = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(streams_[0])).getRaster()
        theirs = np.array([[[raster.getSample(b, a, c) for c in range(n)] for b in range(29)] for a in range(37)])
        assert np.abs(ours[0] - theirs).max() <= 3


def written_by_java(jvm, image, progressive):
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    options = writer.getDefaultWriteParam()
    if progressive:
        options.setProgressiveMode(jvm.javax.imageio.ImageWriteParam.MODE_DEFAULT)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), options)
    stream.flush()
    return bytes(out.toByteArray())


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(1, 4), st.integers(2, 16), st.integers(1, 7), st.integers(0, 1), st.integers(0, 3), st.integers(0, 2**31))
def test_lossless_frames_round_trip(h, w, n, bits, predictor, shift, lines, seed):
    p = np.random.default_rng(seed).integers(0, 1 << bits, (h, w, n))
    got, deep = jpeg.decode(lossless.encode(p, bits, predictor, shift, lines))
    assert deep == bits and (got == (p >> shift << shift)).all()


def test_standard_code_tables(spark):
    """The stated tables against those of another library."""
    tables = spark._jvm.javax.imageio.plugins.jpeg.JPEGHuffmanTable
    for theirs, counts, symbols in ((tables.StdDCLuminance, fixed.DC_COUNTS, list(range(12))), (tables.StdACLuminance, fixed.AC_COUNTS, fixed.ac_symbols())):
        assert list(theirs.getLengths()) == counts[: len(list(theirs.getLengths()))] and [v & 255 for v in theirs.getValues()] == symbols


def test_presets_and_spiff():
    p = np.minimum(picture(9, 13, 3), 200)
    for given_, near, layout in (((200,), 0, "none"), ((255, 9, 20, 40), 2, "line"), ((255, 0, 0, 0, 16), 0, "sample")):
        data = jpegls.encode(p, 8, near, layout, given_, spiff=True)
        assert np.abs(jpegls.decode(data)[0].astype(int) - p).max() <= near and segments.kind(data) == "jpegls"
        head = segments.spiff_header(data)
        assert head["valid"] and head["fits"] and (head["width"], head["height"], head["components"]) == (13, 9, 3)
    other = segments.segment(segments.APP8, segments.spiff_bytes(14, 9, 3, 8, 5))
    wrong = segments.spiff_header(b"\xff\xd8" + other + jpegls.encode(p)[2:])
    assert not wrong["valid"] and not wrong["fits"] and segments.spiff_header(jpegls.encode(p)) is None
    with pytest.raises(ValueError):
        jpegls.encode(p, given=(100,))  # samples over the largest one
    assert jpegls.encode(np.array(formats.EXAMPLE).reshape(4, 4, 1)).hex().upper() == formats.EXAMPLE_STREAM


def test_golomb_table_reads_what_is_written():
    for k in range(4):
        for value, size in [(v, n) for v, n in jpegls.golomb_table(k) if n]:
            out = jpegls.Writer()
            out.golomb(k, 32, 8, value)
            out.put(0, 8)
            assert jpegls.golomb_table(k)[out.done()[0]] == (value, size)


def test_pyramid_round_trip_and_sizes(spark):
    image = signals.gradient(spark, "odd", 11, 9)
    waves = bands.pyramid(image, 2)
    sizes = {(r["level"], r["band"]): r["count"] for r in waves.groupBy("level", "band").count().collect()}
    assert sizes == {(1, "HL"): 25, (1, "LH"): 24, (1, "HH"): 20, (2, "LL"): 9, (2, "HL"): 9, (2, "LH"): 6, (2, "HH"): 6}
    back = bands.unpyramid(waves, 2)
    assert back.join(image.withColumnRenamed("v", "w"), ["name", "y", "x"]).where("v = w").count() == 99
    low, details = lifting.levels(np.array([r["v"] for r in image.orderBy("y", "x").collect()]).reshape(9, 11), 0, 0, 2, True)
    got = {(r["y"], r["x"]): r["w"] for r in waves.where("level = 2 AND band = 'LL'").collect()}
    assert got == {(y, x): low[y, x] for y in range(3) for x in range(3)}


def test_neighbours_by_both_standards(spark):
    image = spark.createDataFrame([("a", y, x, 10 * y + x + 1) for y in range(3) for x in range(3)], "name string, y int, x int, v int")
    near = {(r["y"], r["x"]): (r["a"], r["b"], r["c"], r["d"]) for r in signals.neighbours(image).collect()}
    assert near[0, 0] == (0, 0, 0, 0) and near[0, 1] == (1, 0, 0, 0) and near[1, 0] == (1, 1, 0, 2) and near[2, 0] == (11, 11, 1, 12) and near[2, 2] == (22, 13, 12, 13)
    p = {(r["y"], r["x"]): r for r in signals.predicted(image, 128).collect()}
    assert [p[0, 0][f"p{k}"] for k in range(8)] == [128] * 8 and [p[0, 2][f"p{k}"] for k in range(8)] == [2] * 8 and [p[2, 0][f"p{k}"] for k in range(8)] == [11] * 8
    assert [p[1, 1][f"p{k}"] for k in range(8)] == [0, 11, 2, 1, 12, 11, 7, 6]


def test_run_modes_of_a_line(spark):
    rows = [("a", 0, x, v) for x, v in enumerate([0, 0, 0, 5, 5, 5, 0, 0])]
    got = [r["mode"] for r in planes.run_modes(spark.createDataFrame(rows, "name string, y int, x int, v int")).orderBy("x").collect()]
    assert got == ["run", "run", "run", "interruption", "regular", "regular", "regular", "run"]


def test_fixed_point_inverse(spark):
    block = [8.0 * (k % 5) - 11 if k < 20 else 0.0 for k in range(64)]
    df = spark.createDataFrame([(1, block), (2, None)], "id long, block array<double>")
    got = {r["pos"]: r["v"] for r in blocks.fixed_point_inverse(df, "id", "block").collect()}
    exact = {r["pos"]: r["coef"] for r in blocks.coefficients(df, "id", "block", True).collect()}
    assert len(got) == 64 and max(abs(got[k] - exact[k]) for k in range(64)) < 0.1


def test_sinks_write_whole_files_only(spark, tmp_path):
    df = spark.createDataFrame([("a.bin", b"one"), ("b.bin", b""), ("c.bin", None)], "name string, content binary")
    assert sorted(map(tuple, sinks.write_files(df, f"{tmp_path}/out", "name", "content").collect())) == [("a.bin", 3), ("b.bin", 0)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.bin", "b.bin"]
    back = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in streams.files(spark, f"{tmp_path}/out").collect()}
    assert back == {"a.bin": b"one"}  # Spark's reader passes over empty files


def test_bytes_of_texts_in_many_partitions(spark):
    df = spark.createDataFrame([("aÄ",), (None,), ("",)], "text string").repartition(8)
    assert {(r["byte"], r["n"]) for r in planes.byte_counts(df, "text").collect()} == {("61", 1), ("C3", 1), ("84", 1)}
    assert planes.byte_counts(df.where("text = 'x'"), "text").count() == 0


def test_raw_images(spark):
    df = spark.createDataFrame([(1, bytes(range(6))), (2, b"\0"), (3, None)], "id long, content binary")
    got = {r["id"]: r for r in streams.raw_images(df, 3, 1, 1, 16).collect()}
    assert bytes(got[1]["pixels"]) == bytes(range(6)) and got[2]["pixels"] is None and "needed" in got[2]["error"] and got[3]["error"] == "no bytes"
    assert [r["v"] for r in codec.samples(streams.raw_images(df, 3, 1, 1, 16), "id").orderBy("x").collect()] == [256, 770, 1284]


def test_reports_and_rates(spark):
    a = spark.createDataFrame([("x", "OK"), ("y", "ERROR")], "file string, status string")
    b = spark.createDataFrame([("x", "OK"), ("z", "OK")], "file string, status string")
    got = {r["file"]: (r["status_a"], r["status_b"], r["agree"]) for r in codec.status_differences(a, b, "file").collect()}
    assert got == {"x": ("OK", "OK", True), "y": ("ERROR", None, False), "z": (None, "OK", False)}
    assert codec.success_rates(a.selectExpr("'k' AS kind", "status"), "kind").first()["rate"] == 0.5


def test_sql_functions_and_source(spark, tmp_path):
    extension.register(spark)
    p = picture(9, 7, 3).astype(np.uint8)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    files = {"a.j2c": wavelet.encode(p), "b.jls": jpegls.encode(p), "deep/c.jpg": lossless.encode(p), "d.txt": b"no image", "deep/e.j2c": wavelet.encode(p)[:40]}
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r for r in extension.images(spark, f"{tmp_path}/in").collect()}
    assert {k: r["error"] is None for k, r in got.items()} == {"a.j2c": True, "b.jls": True, "c.jpg": True, "d.txt": False, "e.j2c": False}
    assert all(bytes(r["pixels"]) == p.tobytes() and (r["width"], r["height"]) == (7, 9) for r in got.values() if r["error"] is None)
    assert extension.images(spark, f"{tmp_path}/in", (".jls", ".jpg")).count() == 2
    assert spark.sql("SELECT image_decode(CAST(NULL AS BINARY)).error AS e, image_encode(X'00', 1, 2, 1, 8, 'jpeg') AS c, image_encode(X'00', 1, NULL, 1, 8, 'jpeg') AS n").first()[:] == ("no bytes", None, None)
    assert spark.sql("SELECT count(*) FROM (SELECT X'FFD8' AS c), LATERAL jp2_boxes(c)").first()[0] == 0
    # Files in subfolders are found by the plain reader, too, unless it is told not to.
    assert streams.files(spark, f"{tmp_path}/in").count() == 5 and streams.files(spark, f"{tmp_path}/in", recursive=False).count() == 3


def test_command_line(spark, tmp_path, capsys):
    p = picture(6, 5, 3).astype(np.uint8)
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "one.raw").write_bytes(p.tobytes())
    geometry = ["--width", "5", "--height", "6", "--components", "3"]
    assert cli.main(["encode", f"{tmp_path}/raw", f"{tmp_path}/jls", "--codec", "jpegls", *geometry], spark) == 0
    assert cli.main(["transcode", f"{tmp_path}/jls", f"{tmp_path}/jp2", "--codec", "jp2"], spark) == 0
    assert cli.main(["decode", f"{tmp_path}/jp2", f"{tmp_path}/back"], spark) == 0
    assert (tmp_path / "back" / "one.raw").read_bytes() == p.tobytes()
    assert cli.main(["decode", f"{tmp_path}/jp2", f"{tmp_path}/ppm", "--format", "ppm"], spark) == 0
    assert (tmp_path / "ppm" / "one.ppm").read_bytes() == b"P6\n5 6\n255\n" + p.tobytes()
    assert cli.main(["info", f"{tmp_path}/jls"], spark) == 0 and cli.main(["list"], spark) == 0 and "jpegls" in capsys.readouterr().out
    (tmp_path / "raw" / "short.raw").write_bytes(b"xx")
    assert cli.main(["encode", f"{tmp_path}/raw", f"{tmp_path}/jpg", *geometry], spark) == 1
    assert [f.name for f in (tmp_path / "jpg").iterdir() if not f.name.startswith(".")] == ["one.jpg"] and "short.raw" in capsys.readouterr().out
