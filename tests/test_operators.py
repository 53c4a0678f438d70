"""Operators that SQL can't check, against plain loops; and every query against DuckDB on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from argentum import registry
from argentum.functions import colour
from argentum.operators import neighbourhood, point, tiles

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: "%.9g" % x if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    rows = got.collect()
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(rows, got.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_entry(spark, monkeypatch):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def slow_display(v, c, p):
    f = np.float32
    unit = lambda x: min(max(x, f(0)), f(1))
    x = f(v) / f(65535)
    lo, hi = f(p.out_low[c]) / f(255), f(p.out_high[c]) / f(255)
    x = lo + x * max(hi - lo, f(0.001))
    x = (x + f(p.shift[c]) / f(255)) * f(2) ** f(p.exposure)
    warm, tint = f(p.temperature) / f(100), f(p.tint) / f(100)
    x = unit(x * [f(1) + warm * f(0.15), f(1) - tint * f(0.15), f(1) - warm * f(0.15)][c])
    x = unit(x + f(p.shadows) / f(100) * (f(1) - x) * (f(1) - x) * f(0.5))
    x = unit(x + f(p.highlights) / f(100) * x * x * f(0.5))
    k = f(p.contrast) / f(100)
    x = unit((x - f(0.5)) * (f(1) + k * f(2)) + f(0.5))
    x = unit(x + f(p.brightness) / f(100) * f(0.5))
    x = unit(x ** (f(1) / (f(1) + f(p.depth) / f(100))))
    return int(unit(x ** (f(1) / f(p.midtone))) * f(65535))


def test_display_tables():
    from argentum.plans.pixel_queries import STEPS

    tables = point.display_tables(STEPS)
    for c in range(3):
        for v in range(0, 65536, 1021):
            assert abs(int(tables[c][v]) - slow_display(v, c, STEPS)) <= 1


def test_neutral_display_adds_nothing(spark):
    df = spark.createDataFrame([(1, 2, 3)], "r bigint, g bigint, b bigint")
    assert point.display(df, point.Display()) is df and point.saturate(df, 0.05) is df


def test_tables_are_joined_by_broadcast(spark):
    df = spark.range(1000).selectExpr("id AS r", "id AS g", "id AS b")
    plan = point.look_up(df, np.array([np.arange(65536)] * 3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan


def test_curves():
    assert (point.bezier_table([]) == np.arange(256)).all() and (point.bezier_table([(0, 0), (255, 255)]) == np.arange(256)).all()
    # three points: the curve of x = 2t(1-t)*128 + 255 t^2
    t = np.linspace(0, 1, 200_001)
    x, y = 2 * t * (1 - t) * 128 + 255 * t * t, 2 * t * (1 - t) * 200 + 255 * t * t
    want = np.interp(np.arange(256), x, y)
    assert np.abs(point.bezier_table([(255, 255), (0, 0), (128, 200), (128.3, 9)]) - want).max() <= 0.6
    table = np.array([min(255, i * i // 200) for i in range(256)])
    inverse = point.invert_table(table)
    assert all(abs(table[inverse[o]] - o) == np.abs(table - o).min() and inverse[o] == np.abs(table - o).argmin() for o in range(256))


def test_levels_follow_a_film_curve():
    film = np.array([np.linspace(1, 0, 65536)] * 3)
    t = point.level_tables((0, 0, 0), (255, 255, 255), (1, 1, 1), film=film)
    assert t[0][0] == 65535 and t[0][65535] == 0 and abs(int(t[1][32768]) - 32767) <= 2


# Published test pairs of the formula (Sharma, Wu, Dalal 2005).
PAIRS = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
    (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0000),
    (50.0, 2.5, 0.0, 50.0, 0.0, -2.5, 4.3065),
    (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
    (50.0, 2.5, 0.0, 58.0, 24.0, 15.0, 19.4535),
    (2.0776, 0.0795, -1.1350, 0.9033, -0.0636, -0.5514, 0.9082),
    (50.0, 0.0, 0.0, 50.0, 0.0, 0.0, 0.0),
]


def test_colour_difference(spark):
    df = spark.createDataFrame(PAIRS, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    for r in colour.ciede2000(df, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "de").collect():
        assert math.isclose(r.de, r.want, abs_tol=1e-4)


def tiled(spark, image, size=None, halo=0):
    h, w = image.shape
    df = tiles.whole(spark.createDataFrame([(1, h, w, [float(v) for v in image.ravel()])], "image_id bigint, height int, width int, px array<double>"))
    return df if size is None else tiles.split(df, size, halo)


@pytest.mark.parametrize("size,halo", [(None, 0), (3, 1), (5, 2)])
def test_rotated_crop_by_loop(spark, size, halo):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 16384, (8, 8))
    df = tiled(spark, image, size, halo)
    cx, cy, w, h, angle = 0.5, 0.45, 0.9, 0.5, 0.3
    rows = tiles.crop_rotated(df, cx, cy, w, h, angle).collect()
    got = {(r.y, r.x): r.v for r in rows}
    ow, oh = math.floor(w * 8 + 0.5), round(h * 8)
    assert len(got) == len(rows) == ow * oh
    for (y, x), v in got.items():
        dx, dy = x + 0.5 - ow / 2, y + 0.5 - oh / 2
        sx, sy = cx * 8 + dx * math.cos(angle) - dy * math.sin(angle) - 0.5, cy * 8 + dx * math.sin(angle) + dy * math.cos(angle) - 0.5
        if not (0 <= sx <= 7 and 0 <= sy <= 7):
            assert v == 0
            continue
        x0, y0 = int(sx), int(sy)
        x1, y1 = min(x0 + 1, 7), min(y0 + 1, 7)
        fx, fy = sx - x0, sy - y0
        want = (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
        assert abs(v - want) <= 0.5 + 1e-6
    straight = {(r.y, r.x): r.v for r in tiles.crop_rotated(df, 0.5, 0.5, 0.5, 0.5, 0.0).collect()}
    assert straight == {(y, x): int(image[y + 2, x + 2]) for y in range(4) for x in range(4)}


def slow_soft(u, sigma):
    k = np.array(neighbourhood.gaussian(sigma))
    half = len(k) // 2
    pad = np.pad(u, ((0, 0), (half, half)), "edge")
    soft = sum(w * pad[:, i : i + u.shape[1]] for i, w in enumerate(k))
    pad = np.pad(soft, ((half, half), (0, 0)), "edge")
    return sum(w * pad[i : i + u.shape[0]] for i, w in enumerate(k))


@pytest.mark.parametrize("size,halo", [(None, 0), (2, 3), (4, 5)])
def test_sharpening_by_loop(spark, size, halo):
    image = np.random.default_rng(3).integers(0, 65536, (6, 7))
    df = tiled(spark, image, size, halo)
    u = image / 65535
    high = u - slow_soft(u, 1.0)
    high = high * np.clip((np.abs(high) - 3 / 255) / (3 / 255), 0, 1)
    t = np.clip(u / (100 / 255), 0, 1)
    want = np.floor(np.clip(u + 150 / 50 * t * t * (3 - 2 * t) * high, 0, 1) * 65535 + 0.5)
    made = tiles.with_core(df, "out", tiles.sharpened(150.0, 20.0, 100.0, 3.0))
    got = {(r.y, r.x): r.v for r in tiles.pixels(made, "out").collect()}
    assert len(got) == 42 and all(abs(got[y, x] - want[y, x]) <= 1 for y in range(6) for x in range(7))
    same = tiles.with_core(tiles.with_core(df, "a", tiles.sharpened(0.0, 20.0)), "b", tiles.blurred(0.05))
    assert {(r.y, r.x): r.v for r in tiles.pixels(same, "a").collect()} == {(r.y, r.x): r.v for r in tiles.pixels(same, "b").collect()} == {(y, x): image[y, x] for y in range(6) for x in range(7)}


def test_sharpening_of_colours_by_loop(spark):
    rng = np.random.default_rng(4)
    r, g, b = (rng.integers(0, 65536, (5, 6)) for _ in range(3))
    df = spark.createDataFrame([("i", 5, 6, 0, 0, 5, 6, 0, *[[float(v) for v in c.ravel()] for c in (r, g, b)])], "image_id string, height int, width int, y0 int, x0 int, h int, w int, halo int, r array<double>, g array<double>, b array<double>")
    light = (0.299 * r + 0.587 * g + 0.114 * b) / 65535
    more = 80 / 50 * (light - slow_soft(light, 0.8))
    got = {(x.y, x.x): (x.r, x.g, x.b) for x in tiles.rgb_pixels(tiles.sharpen_rgb(df, 80.0, 16.0, factors=(100.0, 50.0, 0.0))).collect()}
    for y in range(5):
        for x in range(6):
            want = [math.floor(min(max(c[y, x] / 65535 + k * more[y, x], 0), 1) * 65535 + 0.5) for c, k in zip((r, g, b), (1, 0.5, 0))]
            assert all(abs(v - w) <= 1 for v, w in zip(got[y, x], want)) and got[y, x][2] == b[y, x]


def test_narrow_halos_are_refused(spark):
    df = tiled(spark, np.zeros((9, 9)), 3, 1)
    with pytest.raises(Exception, match="too narrow"):
        tiles.with_core(df, "out", tiles.blurred(2.0)).collect()


@pytest.mark.parametrize("name", ["conv_h", "conv_v", "blur", "usm", "usm_limits", "crop_rotated", "image_round_trip", "thumbnail_pixels"])
def test_neighbours_need_no_shuffle(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_images_of_another_shape_have_no_pairs(spark):
    image = np.arange(8)
    a, b, c = (tiled(spark, image.reshape(s)) for s in ((2, 4), (4, 2), (2, 4)))
    assert tiles.pair(a, b).count() == 0
    assert [(r.y, r.x, r.v, r.ref) for r in tiles.pair_pixels(tiles.pair(a, c)).orderBy("y", "x").collect()] == [(i // 4, i % 4, i, i) for i in range(8)]


def test_nested_arrays_are_replaced_whole(spark):
    from pyspark.sql import functions as F

    from argentum.functions import text

    body = "<array><array><dict/></array><array></array></array>"
    rows = [f"<dict><key>A</key><array>1</array><key>Gradations</key> {body}<key>B</key>{body}</dict>", "<dict><key>B</key></dict>", "<key>Gradations</key><array><array></array>", "<key>Gradations</key>none"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    got = [r.x for r in df.select("i", text.patch_nested_array(F.col("x"), "Gradations", "<new/>").alias("x")).orderBy("i").collect()]
    assert got == [rows[0].replace(f"</key> {body}", "</key> <new/>"), *rows[1:]]


def test_the_whole_processing_by_its_stages(spark):
    from argentum.operators import develop

    rng = np.random.default_rng(6)
    r, g, b = (rng.integers(0, 65536, (7, 9)) for _ in range(3))
    a = develop.from_correction(develop.TEMPLATE | {"Contrast": 10, "ApplyUSM": True, "USMAmount": 60, "USMRadius": 16, "ApplyCurves": True, "Gradations": [[(0, 0), (128, 150), (255, 255)], *[[(0, 0), (255, 255)]] * 6]})
    place = (7, 9, 0, 0, 7, 9, 0)
    df = spark.createDataFrame([("i", *place, *[[float(v) for v in c.ravel()] for c in (r, g, b)])], "image_id string, height int, width int, y0 int, x0 int, h int, w int, halo int, r array<double>, g array<double>, b array<double>")
    got = {(x.y, x.x): (x.r, x.g, x.b) for x in tiles.rgb_pixels(develop.developed(df, a)).collect()}
    levels = point.level_tables(a.black, a.white, a.gamma, a.master_gamma)
    v = [t[c] for t, c in zip(levels, (r, g, b))]
    v = [t[c] for t, c in zip(point.curve_tables(list(a.curves)), v)]
    light = (0.299 * v[0] + 0.587 * v[1] + 0.114 * v[2]) / 65535
    more = 60 / 50 * (light - slow_soft(light, 0.8))
    v = [np.floor(np.clip(c / 65535 + more, 0, 1) * 65535 + 0.5).astype(int) for c in v]
    v = [t[c] for t, c in zip(point.display_tables(a.display), v)]
    assert all(abs(x - c[y, k]) <= 3 for (y, k), three in got.items() for x, c in zip(three, v)) and len(got) == 63
    same = develop.Adjust()
    assert {(x.y, x.x): (x.r, x.g, x.b) for x in tiles.rgb_pixels(develop.developed(df, same)).collect()} == {(y, x): (r[y, x], g[y, x], b[y, x]) for y in range(7) for x in range(9)}
    steps = develop.trace(df, a, 2, 3).orderBy("ord").collect()
    assert [s.stage for s in steps][0] == "input" and (steps[0].r, steps[-1].r) == (r[2, 3], got[2, 3][0]) and develop.trace(df, a, 9, 9).count() == 0


def test_negative_calibration(spark):
    df = spark.createDataFrame([(10000, 20000, 65535)], "r bigint, g bigint, b bigint")
    assert point.calibrate_negative(df, 0, "x") is df
    r = point.calibrate_negative(df, 1, " ").first()
    assert tuple(r) == (math.floor(10000 * 1.01 - 3.07 * 257), math.floor(20000 * 1.05 - 16.64 * 257), math.floor(min(65535.0, 65535 * 0.96 + 8.66 * 257)))
    assert point.calibrate_negative(df, 1, "in.icc").first().b == 65535
