"""Overlay store, manifests, baselines, working spaces, text patches."""

import numpy as np
import pytest

from argentum.functions import colour, text
from argentum.sources import manifests, overlays


def test_one_overlay_for_a_key_and_few_snapshots(spark, tmp_path):
    store = overlays.OverlayStore(spark, str(tmp_path / "o"), "contrast int, curve string")
    schema = "path_key bigint, contrast int, curve string"
    for i in range(5):
        store.save(spark.createDataFrame([(1, i, "a"), (1, i, "b"), (i, None, None)] if i > 1 else [(1, i, "a")], schema))
    got = sorted((r.path_key, r.contrast, r.curve) for r in store.load().collect())
    assert got == [(1, 4, "b"), (2, None, None), (3, None, None), (4, None, None)]
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["v3", "v4", "v5"]


def test_overlay_store(spark, tmp_path):
    store = overlays.OverlayStore(spark, str(tmp_path / "overlays"), "contrast int, curve string")
    assert store.load().count() == 0
    rows = lambda df: sorted((r.path_key, r.contrast, r.curve) for r in df.collect())
    new = lambda *r: spark.createDataFrame(list(r), "path_key bigint, contrast int, curve string")
    store.save(new((1, 5, None), (2, None, "s")))
    store.save(new((2, 7, None), (3, 1, "x")))
    assert rows(store.load()) == [(1, 5, None), (2, 7, None), (3, 1, "x")]
    store.delete(spark.createDataFrame([(3,), (99,)], "path_key bigint"))
    assert rows(store.load()) == [(1, 5, None), (2, 7, None)]
    (tmp_path / "overlays" / "v9").mkdir()  # an unfinished snapshot isn't read
    assert rows(store.load()) == [(1, 5, None), (2, 7, None)]


MANIFEST = """
data_dir = "images"
[[case]]
name = "one"
raw = "a.tif"
ref = "/abs/a.tif"
[[case]]
name = "two"
raw = "b.tif"
ref = "b_ref.tif"
source = "external_xml"
preset = "p.xml"
"""


def test_manifest(spark):
    rows = [tuple(r) for r in manifests.cases(spark, MANIFEST, "/m", "raw").collect()]
    assert rows == [("one", "/m/images/a.tif", "/abs/a.tif", "embedded_current", None), ("two", "/m/images/b.tif", "/m/images/b_ref.tif", "external_xml", "/m/p.xml")]
    for bad in ("x = 1", MANIFEST.replace('name = "one"', ""), MANIFEST.replace('preset = "p.xml"', ""), MANIFEST.replace("external_xml", "elsewhere")):
        with pytest.raises(ValueError):
            manifests.cases(spark, bad, "/m", "raw")


def test_baseline_round_trip(spark, tmp_path):
    stats = spark.sql("SELECT 'c' AS case, 'T1' AS id, 'n' AS name, 1.5D AS mae_16, 0D AS mean_signed, 1L AS p50_16, 2L AS p95_16, 3L AS p99_16, 4L AS p999_16, 5L AS max_16, 0D AS mae_shadow, 0D AS mae_mid, 0D AS mae_high, 'PASS' AS grade")
    path = str(tmp_path / "b")
    manifests.write_baseline(stats, path)
    (tmp_path / "b" / "more.json").write_text("not json\n")
    assert [tuple(r) for r in manifests.read_baseline(spark, path).collect()] == [("c", "T1", 1.5)]
    manifests.write_summary(stats.select("case", "id"), str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ["case\tid", "c\tT1"]


def test_working_spaces(spark):
    for name in colour.SPACES:
        assert np.allclose(colour.space_to_space("srgb", name) @ np.ones(3), 1, atol=1e-6)
    assert np.allclose(colour.space_to_xyz("srgb"), colour.TO_XYZ, atol=3e-4)  # the two take the white to another digit
    df = spark.createDataFrame([(65535, 65535, 65535), (0, 0, 0), (30000, 30000, 30000), (65535, 0, 0)], "r bigint, g bigint, b bigint")
    white, black, grey, red = [tuple(r) for r in colour.convert(df, "srgb", "adobe").select("r", "g", "b").collect()]
    assert white == (65535,) * 3 and black == (0,) * 3 and max(grey) - min(grey) <= 2 and 56000 < red[0] < 57000 and red[1] == 0
    back = colour.convert(colour.convert(df, "srgb", "prophoto"), "prophoto", "srgb").select("r", "g", "b").collect()
    assert all(abs(a - b) <= 40 for r, want in zip(back, df.collect()) for a, b in zip(r, want))


def test_text_functions(spark):
    df = spark.createDataFrame([("<key>A</key><real>1.5</real><key>A</key><real>2</real>", "1, x,3 ,,-4")], "xml string, list string")
    r = df.select(text.patch_scalar(df.xml, "A", "9").alias("a"), text.patch_scalar(df.xml, "B", "9").alias("b"), text.ints_of(df.list).alias("i"), text.insert_after(df.xml, "A", "C", "7").alias("c")).first()
    assert r.a == "<key>A</key><real>9</real><key>A</key><real>2</real>" and r.b == df.first().xml and r.i == [1, 3, -4]
    assert r.c == "<key>A</key><real>1.5</real><key>C</key><integer>7</integer><key>A</key><real>2</real>"
    empty = spark.createDataFrame([("abc",)], "s string")
    assert empty.filter(text.subsequence(empty.s, "")).count() == 1 and empty.filter(text.subsequence(empty.s, "ca")).count() == 0
