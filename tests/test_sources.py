"""Files: tag directories in both byte orders, faults, decoding, profiles, parameter files, ingest."""

import struct

import numpy as np
import pytest

from argentum.plans import file_queries
from argentum.sources import presets, profiles, tagfiles
from argentum.streaming import ingest

TEXT = [b"Maker\0"]


def one(found, tag, ifd=0):
    return found[ifd][1][tag]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("magic", [0x2A, 0x55])
def test_all_types_in_both_orders(order, magic):
    values = [(100 + k, k, v) for k, v in {1: [7], 2: [b"ab\0"], 3: [1, 2, 3], 4: [70000], 5: [(1, 3), (4, 0)], 6: [-5], 7: [b"raw bytes"], 8: [-300], 9: [-70000, 5], 10: [(-1, 3)], 11: [0.5], 12: [0.25, 2.0]}.items()]
    names, got_magic, found = tagfiles.parse(tagfiles.build([values], [b""], order, magic))
    assert (names, got_magic) == ("LE" if order == "<" else "BE", magic)
    v = {k: one(found, 100 + k)[2] for k in range(1, 13)}
    assert v[1]["ints"] == [7] and v[2]["s"] == "ab" and v[3]["ints"] == [1, 2, 3] and v[4]["ints"] == [70000]
    assert v[5]["rats"] == [{"n": 1, "d": 3}, {"n": 4, "d": 0}] and v[6]["ints"] == [-5] and v[7]["bytes"] == b"raw bytes"
    assert v[8]["ints"] == [-300] and v[9]["ints"] == [-70000, 5] and v[10]["rats"] == [{"n": -1, "d": 3}] and v[11]["floats"] == [0.5] and v[12]["floats"] == [0.25, 2.0]


def test_faults():
    for data in (b"", b"II*\0", b"XX*\0\x08\0\0\0", struct.pack("<2sHI", b"II", 43, 8)):
        with pytest.raises(tagfiles.TagError):
            tagfiles.parse(data)
    with pytest.raises(tagfiles.TagError):
        tagfiles.parse(struct.pack("<2sHIH", b"II", 42, 8, 1001) + bytes(20000))
    # a value outside the file and an unknown type are left out; of a tag's two entries the last stands
    head = struct.pack("<2sHIH", b"II", 42, 8, 4)
    rows = [struct.pack("<HHII", 1, 4, 100, 5000), struct.pack("<HHII", 2, 99, 1, 5), struct.pack("<HHII", 3, 3, 1, 5), struct.pack("<HHII", 3, 3, 1, 6)]
    _, _, found = tagfiles.parse(head + b"".join(rows))
    assert list(found[0][1]) == [3] and one(found, 3)[2]["ints"] == [6]


def test_chains_end_and_sub_directories_are_read():
    loop = struct.pack("<2sHIH", b"II", 42, 8, 0) + struct.pack("<I", 8)
    assert len(tagfiles.parse(loop)[2]) == 21
    base = tagfiles.build([[(0x010F, 2, TEXT)]], [b""])
    sub_at = len(base) + len(base) % 2
    sub = struct.pack("<HHHII", 1, 0x0110, 3, 1, 9) + bytes(4)
    note = b"SOMEMAKERS\0\0" + struct.pack("<HHHII", 1, 5, 3, 1, 2) + bytes(4)
    file = tagfiles.build([[(tagfiles.SUB, 4, [0]), (tagfiles.EXIF, 4, [0])]], [b""])
    at = len(file)
    exif = struct.pack("<H", 1) + struct.pack("<HHII", tagfiles.NOTE, 7, len(note), at + len(sub) + 18) + bytes(4)
    patched = bytearray(file + sub + exif + note)
    place = {struct.unpack_from("<H", patched, p)[0]: p for p in (10, 22)}
    struct.pack_into("<I", patched, place[tagfiles.SUB] + 8, at)
    struct.pack_into("<I", patched, place[tagfiles.EXIF] + 8, at + len(sub))
    names = [n for n, _ in tagfiles.parse(bytes(patched))[2]]
    assert names == ["IFD#0", "IFD#0:Sub#0", "EXIF", "MakerNote"] and sub_at


def test_tag_columns(spark):
    found = tagfiles.tags(file_queries.sample_files(spark))
    errors = {r.path: r.error for r in found.filter("error IS NOT NULL").collect()}
    assert set(errors) == {"/scans/roll1/short.tif", "/scans/roll1/other.tif"}
    shown = {(r.ifd_name, r.name): r.shown for r in tagfiles.all_tags(found).filter("path LIKE '%scan3.tif'").collect()}
    assert shown["IFD#0", "Model"] == "Model 3" and shown["IFD#0", "XResolution"] == "300" and shown["IFD#0", "YResolution"] == "0"
    assert shown["IFD#0", "ExposureTime"] == "1/63" and shown["IFD#0", "BitsPerSample"] == "[16, 16, 16]"
    assert {r.shown for r in tagfiles.all_tags(found).filter("name = 'Unknown'").collect()} == {"[-1, -2]", "0.5000"}
    facts = {r.key: r.value for r in tagfiles.summary(found).filter("path LIKE '%scan3.tif'").collect()}
    assert facts["Dimensions"] == "4 × 3" and facts["FNumber"] == "f/5.6" and facts["ISO"] == "300" and facts["Orientation"] == "Flip Vertical" and facts["XResolution"] == "300" and facts["IFD Count"] == "2"


def test_pixels_of_the_largest_and_of_the_thumbnail(spark):
    files = file_queries.sample_files(spark)
    rgb = tagfiles.rgb_directories(tagfiles.tags(files))
    full = tagfiles.pixels(files).collect()
    assert {(r.path, r.ifd_idx) for r in full} == {(r.path, r.ifd_idx) for r in tagfiles.choose(rgb, False).collect()}
    for r in full:
        n = int(r.path[-5])
        i = (r.y * 4 + r.x) * 3
        assert (r.r, r.g, r.b) == tuple((k * 1000 + n) % 65536 for k in (i, i + 1, i + 2))
    thumb = tagfiles.pixels(files, thumbnail=True).collect()
    assert len(thumb) == 8 * 4 and all((r.r, r.g, r.b) == tuple(range((r.y * 2 + r.x) * 3, (r.y * 2 + r.x) * 3 + 3)) for r in thumb)
    assert {(r.path, r.ifd_idx) for r in thumb} == {(r.path, r.ifd_idx) for r in tagfiles.choose(rgb, True).collect()}
    assert tagfiles.pixels(files, factor=2).count() == 8 * 4
    from argentum.operators import tiles

    tiled = tiles.rgb_pixels(tagfiles.image_tiles(files, size=3, halo=0)).collect()
    assert {(r.image_id, r.y, r.x, r.r, r.g, r.b) for r in tiled} == {(r.path, r.y, r.x, r.r, r.g, r.b) for r in full} and len(tiled) == len(full)


def rgb_entries(w, h, bits, kind):
    return [(0x00FE, 4, [kind]), (0x0100, 4, [w]), (0x0101, 4, [h]), (0x0102, 3, [bits] * 3), (0x0103, 3, [1]), (0x0106, 3, [2]), (0x0115, 3, [3])]


def test_pairs_of_thumbnail_and_preview(spark):
    def made(*images):
        strips = [np.arange(w * h * 3, dtype="<u2" if bits == 16 else np.uint8).tobytes() for w, h, bits, _ in images]
        return bytearray(tagfiles.build([rgb_entries(*i) for i in images], strips))

    big, thumb, preview = (9, 9, 16, 0), (3, 2, 8, 1), (3, 2, 16, 0)
    rows = [("both", made(big, thumb, preview)), ("other size", made(big, thumb, (2, 3, 16, 0))), ("largest", made(thumb, preview)), ("marked", made(big, thumb, (3, 2, 16, 1))), ("none", made(big)), ("broken", bytearray(b"x"))]
    got = tagfiles.pixel_pairs(spark.createDataFrame(rows, "path string, content binary")).orderBy("y", "x").collect()
    assert {r.path for r in got} == {"both"} and len(got) == 6
    assert all((r.r, r.g, r.b) == (r.r16, r.g16, r.b16) == tuple(range((r.y * 3 + r.x) * 3, (r.y * 3 + r.x) * 3 + 3)) for r in got)


def test_scans_read_directories_only(spark, tmp_path):
    import io

    strip = bytes(6_000_000)
    raw = tagfiles.build([[*rgb_entries(1000, 2000, 8, 0), (0x010F, 2, TEXT)], rgb_entries(2, 2, 8, 1)], [strip, bytes(12)])
    ranges = tagfiles.Ranges(io.BytesIO(raw), len(raw))
    assert tagfiles.parse(ranges) == tagfiles.parse(raw) and ranges.read <= 4 * 16384 < len(raw) / 50
    (tmp_path / "a.tif").write_bytes(raw)
    (tmp_path / "b.tif").write_bytes(b"II")
    paths = tagfiles.list_files(spark, str(tmp_path), ["tif"])
    order = ["path", "ifd_idx", "tag"]
    assert tagfiles.scan_tags(paths).orderBy(*order).collect() == tagfiles.tags(paths).orderBy(*order).collect()


def test_bytes_are_numbers_too():
    values = list(range(200))
    assert one(tagfiles.parse(tagfiles.build([[(9, 1, values)]], [b""]))[2], 9)[2]["ints"] == values


def test_history_is_searched_for_without_its_tag(spark):
    xml = b"<?xml version='1.0'?><plist>\xc3\xa9</plist>"
    tagged = tagfiles.build([[(0xC519, 7, [struct.pack(">I", 8) + b"<plist/>" + b"rest"])]], [b""]) + xml
    rows = [("tag", tagged), ("scan", tagfiles.build([[(0x010F, 2, TEXT)]], [b""]) + b"junk" + xml + b"more</plist>"), ("not a file", b"??" + xml), ("open", b"<?xml and no end"), ("bytes", xml.replace(b"\xc3\xa9", b"\xff")), ("none", b"")]
    got = {r.path: (r.xml, r.scanned) for r in tagfiles.history(spark.createDataFrame([(n, bytearray(d)) for n, d in rows], "path string, content binary")).collect()}
    assert got == {"tag": ("<plist/>", False), "scan": (xml.decode(), True), "not a file": (xml.decode(), True)}


def test_folders_with_odd_and_repeated_names(spark, tmp_path):
    root = tmp_path / "a+b (1)" / "x"
    for name in ("one.tif", "x/two.tif", "x/x/three.tif", ".hidden/four.tif", "x/.h/five.tif"):
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"II")
    names = lambda depth: sorted(r.path.rsplit("/", 1)[1] for r in tagfiles.list_files(spark, str(root), ["TIF"], depth).select("path").collect())
    assert (names(None), names(0), names(1)) == (["one.tif", "three.tif", "two.tif"], ["one.tif"], ["one.tif", "two.tif"])


def test_embedded_texts_profiles_and_jpegs(spark):
    xml = b"<plist/>"
    profile = b"\0" * 36 + b"acsp" + b"\0" * 10
    raw = tagfiles.build([[(0xC519, 7, [struct.pack(">I", len(xml)) + xml + b"rest"]), (0x8773, 7, [b"no" * 30]), (0xC51A, 7, [profile])]], [b""])
    found = tagfiles.tags(spark.createDataFrame([("a", bytearray(raw))], "path string, content binary"))
    assert tagfiles.settings_text(found).collect()[0].xml == "<plist/>"
    assert bytes(tagfiles.embedded_profile(found).collect()[0].profile) == profile
    small, large = b"\xff\xd8\xff\xe0ab\xff\xd9", b"\xff\xd8\xff\xdbabcdef\xff\xd9"
    assert tagfiles.largest_jpeg(b"xx" + small + b"yy" + large + b"\xff\xd8\xff\x00zz" + small) == large
    assert tagfiles.largest_jpeg(b"nothing") is None


def test_listing(spark, tmp_path):
    for p in ("a.tif", "b.TIFF", "c.txt", "sub/d.tif", "sub/.hid/e.tif", ".hid/f.tif", "sub/deep/g.tif"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    name = lambda df: sorted(r.path.split("/")[-1] for r in df.select("path").collect())
    assert name(tagfiles.list_files(spark, str(tmp_path), ["tif", "tiff"])) == ["a.tif", "b.TIFF", "d.tif", "g.tif"]
    assert name(tagfiles.list_files(spark, str(tmp_path), ["tif", "tiff"], depth=0)) == ["a.tif", "b.TIFF"]
    assert name(tagfiles.list_files(spark, str(tmp_path), ["tif", "tiff"], depth=1)) == ["a.tif", "b.TIFF", "d.tif"]


def test_profiles(spark):
    rows = profiles.catalogue(file_queries.sample_profiles(spark)).collect()
    assert [r.name for r in rows] == [f"Profile {k}" for k in range(4, 10)] + ["bare name"]
    assert {r["class"] for r in rows} == {"scnr", "mntr", "prtr"} and {r.color_space for r in rows} == {"RGB"}
    d = {r.path: r for r in profiles.details(file_queries.sample_profiles(spark)).collect()}
    assert len(d) == 6
    r = d["/icc/p0.icc"]
    assert (r.version, r.class_name, r.pcs, r.date_time, r.intent, r.description) == ("4.2.1", "Scanner", "Lab", "2001-02-03 04:05:06", "Relative Colorimetric", "Profile 9")
    assert r.illuminant == "X=0.9642 Y=1.0000 Z=0.8249" and [(t.sig, t.off) for t in r.tags] == [("desc", 144)]


def test_parameter_parser_is_lenient():
    node = presets.parse("<plist><dict><key>a</key><true/><key>b</key><string> x &amp;lt; </string><key>c</key></dict></plist>").find("dict")
    assert [(k, v.value()) for k, v in node.pairs()] == [("a", "true"), ("b", "x <")]
    assert presets.parse("<a><b>text</a><c/>").find("a").children[0].text is None
    assert presets.parse("<a><b></c>").find("b") is not None and presets.parse("").children == [] and presets.parse("<a").children == []
    assert [c.name for c in presets.parse("<a></a></x><b></b>").children] == ["a"]


def test_corrections(spark):
    params = presets.parameters(file_queries.sample_presets(spark))
    r = {x.path: x for x in presets.corrections(params).collect()}
    x = r["/presets/kind1/p3.xml"]
    assert (x.name, x.Contrast, x.Gamma, x.EV, x.Saturation, x.ApplyCC, x.ApplyUSM) == ("Preset 3", 3, 1.3, 1.0, 0, True, False)
    assert x.Shadow == [3, 7, 0, 0] and x.ColorCorr == [] and x.InputProfile == "In <3>"
    assert [[tuple(p) for p in c] for c in x.Gradations] == [[(0, 3, 1), (255, 0, 1)]]
    assert r["/presets/broken.xml"].Contrast == 7 and "/presets/empty.xml" not in r
    rows = presets.catalogue(file_queries.sample_presets(spark), "/presets").collect()
    assert [(c.category, c.name) for c in rows][:3] == [("", "broken"), ("", "empty"), ("kind0", "p0")]


def test_file_defaults_and_clean_settings(spark):
    wrap = "<plist><dict><key>ImageSetting</key><dict><key>ImageCorrection</key><dict>{}</dict></dict></dict></plist>"
    number = lambda k, v: f"<key>{k}</key><integer>{v}</integer>"
    array = lambda k, v: f"<key>{k}</key><array>" + "".join(f"<integer>{x}</integer>" for x in v) + "</array>"
    texts = {
        "/p/CMYK plain.xml": "",
        "/p/bw.xml": number("FilmCurve", 2) + number("Contrast", 5),
        "/p/contrast.xml": "<key>ApplySliders</key><true/>" + number("Contrast", 5),
        "/p/dots.xml": array("DotColor", [0, 0, 0, 9, 9, 9, 9, 255, 255, 255, 9, 9, 9, 9]),
        "/p/dots off.xml": array("DotColor", [0, 0, 1, 9, 9, 9, 9, 255, 255, 255, 9, 9, 9, 9]),
        "/p/matrix.xml": "<key>ApplyCC</key><true/>" + array("ColorCorr", [0, 0, 3]),
    }
    found = presets.corrections(presets.parameters(spark.createDataFrame([(k, wrap.format(number("Tint", 0) + v)) for k, v in texts.items()], "path string, xml string")))
    r = {x.path: (x.FilmCurve, x.ColorModel) for x in presets.with_file_defaults(found).collect()}
    assert r["/p/CMYK plain.xml"] == (4, 1) and r["/p/bw.xml"] == (2, 2) and r["/p/dots.xml"] == (4, 0)
    assert {x.path for x in presets.clean(found).collect()} == {"/p/CMYK plain.xml", "/p/bw.xml", "/p/dots.xml"}


def test_histories():
    setting = "<dict><key>Name</key><string>{}</string><key>ImageCorrection</key><dict><key>Contrast</key><integer>{}</integer></dict></dict>"
    xml = f"<plist><dict><key>CurrentIx</key><integer>9</integer><key>ImageSettings</key><array>{setting.format('a', 1)}{setting.format('b', 2)}</array></dict></plist>"
    rows = presets.rows_of("p", xml)
    assert [(r["setting"], r["name"], r["value"], r["is_current"]) for r in rows] == [(0, "a", "1", False), (1, "b", "2", True)]


def test_ingest_takes_each_file_once(spark, tmp_path):
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"s{i}.tif").write_bytes(file_queries.sample_bytes("<", i + 1))
    for expected in (2, 3):
        ingest.ingest(spark, folder, target, checkpoint, "*.tif").awaitTermination(60)
        assert spark.read.parquet(target).select("path").distinct().count() == expected
        (tmp_path / "in" / "late.tif").write_bytes(file_queries.sample_bytes(">", 5))


def test_export_is_read_back(spark):
    samples = [int(x) for x in np.random.default_rng(1).integers(0, 65536, 5 * 4 * 3)]
    files = tagfiles.export(spark.createDataFrame([("x", 5, 4, samples)], "path string, width int, height int, samples array<int>"))
    px = tagfiles.pixels(files).orderBy("y", "x").collect()
    assert [v for r in px for v in (r.r, r.g, r.b)] == samples
