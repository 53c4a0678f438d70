"""Queries of the comparison harness and of calibration, over the pixel relations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from argentum.functions import colour, text
from argentum.operators import neighbourhood as near
from argentum.operators import ordered, point, tiles
from argentum.operators import relations as rel
from argentum.plans.file_queries import preset_text, sample_presets
from argentum.sources import pixels

QUERIES, SQL = {}, {}
PX, LONG, TILE = pixels.POINTS_SQL, pixels.LONG_SQL, pixels.TILES_SQL
K = ", ".join(pixels.KEY)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BINS = 1024
FILLED = (
    f"bm AS (SELECT ch, v * {BINS} // 65536 AS bin, sum(ref) / count(*)::DOUBLE / 65535 AS m FROM long GROUP BY 1, 2), g AS (SELECT c.ch, r.bin, m FROM (VALUES ('R'), ('G'), ('B')) c(ch) CROSS JOIN (SELECT unnest(range(0, {BINS})) AS bin) r LEFT JOIN bm ON bm.ch = c.ch AND bm.bin = r.bin), "
    "e AS (SELECT *, last_value(CASE WHEN m IS NOT NULL THEN bin END IGNORE NULLS) OVER a AS lx, last_value(m IGNORE NULLS) OVER a AS ly, first_value(CASE WHEN m IS NOT NULL THEN bin END IGNORE NULLS) OVER z AS rx, first_value(m IGNORE NULLS) OVER z AS ry FROM g "
    "WINDOW a AS (PARTITION BY ch ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY ch ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), "
    "f AS (SELECT ch, bin, coalesce(m, CASE WHEN lx IS NULL THEN ry WHEN rx IS NULL THEN ly ELSE ly * (1 - (bin - lx) / nullif(rx - lx, 0)::DOUBLE) + ry * ((bin - lx) / nullif(rx - lx, 0)::DOUBLE) END, 0::DOUBLE) AS m FROM e), "
    "mo AS (SELECT ch, bin, max(m) OVER (PARTITION BY ch ORDER BY bin) AS m FROM f)"
)


@query(
    f"WITH {PX}, {LONG}, {FILLED}, o AS (SELECT c.ch, i.range AS i, least(floor(i.range * 1023::DOUBLE / 65535)::BIGINT, 1022) AS k FROM (VALUES ('R'), ('G'), ('B')) c(ch) CROSS JOIN range(65536) i) "
    "SELECT o.ch, o.i, round(x.m * (1 - (o.i * 1023::DOUBLE / 65535 - o.k)) + y.m * (o.i * 1023::DOUBLE / 65535 - o.k), 6) AS v FROM o JOIN mo x ON x.ch = o.ch AND x.bin = o.k JOIN mo y ON y.ch = o.ch AND y.bin = o.k + 1"
)
def film_curve_extract(spark, sf_dir):
    """A film curve from raw and reference pixels: binned means, gaps filled, monotone, read at 65 536 places."""
    long = pixels.long(pixels.points(spark, sf_dir))
    means = long.groupBy("ch", F.expr(f"v * {BINS} div 65536").alias("bin")).agg((F.sum("ref") / F.count("*") / 65535).alias("m"))
    grid = spark.range(BINS).select(F.col("id").alias("bin"), F.explode(F.array(*map(F.lit, "RGB"))).alias("ch"))
    filled = ordered.fill_gaps(grid.join(means, ["ch", "bin"], "left"), ["ch"], "bin", "m", "v")
    curve = ordered.monotone(filled, ["ch"], "bin", "v", "v").select("ch", "bin", "v")
    return ordered.resample(curve, ["ch"], "bin", "v", BINS, 65536).select("ch", "i", F.round("v", 6).alias("v"))


@query("WITH t AS (SELECT i.range AS i, c.c, abs(least(1, i.range / 65535::DOUBLE + c.k * 0.002::DOUBLE * sin(i.range)) - i.range / 65535::DOUBLE) AS d FROM range(0, 65536, 256) i CROSS JOIN (VALUES (0, 0), (1, 1), (2, 20)) c(c, k)) SELECT c AS lut, sqrt(avg(d * d)) < 0.004 AND max(d) < 0.015 AS near_identity FROM t GROUP BY 1")
def near_identity(spark, sf_dir):
    """Is a table close to the identity? Every 256th entry: root mean square under 0.004 and none over 0.015."""
    t = spark.range(0, 65536, 256).select("id", F.inline(F.array(*[F.struct(F.lit(c).alias("lut"), F.lit(k).alias("k")) for c, k in ((0, 0), (1, 1), (2, 20))])))
    d = F.abs(F.least(F.lit(1.0), F.col("id") / 65535.0 + F.col("k") * 0.002 * F.sin("id")) - F.col("id") / 65535.0)
    return t.withColumn("d", d).groupBy("lut").agg(((F.sqrt(F.avg(F.col("d") * F.col("d"))) < 0.004) & (F.max("d") < 0.015)).alias("near_identity"))


@query("WITH p AS (SELECT page_id, (page_id % 10) / 10::DOUBLE AS px, (page_id % 7) / 7::DOUBLE AS py, (page_id % 12) / 4::DOUBLE AS a FROM pages) SELECT page_id, abs((px - 0.5::DOUBLE) * cos(a) + (py - 0.45::DOUBLE) * sin(a)) <= 0.3::DOUBLE AND abs(-(px - 0.5::DOUBLE) * sin(a) + (py - 0.45::DOUBLE) * cos(a)) <= 0.2::DOUBLE AS inside FROM p")
def point_in_region(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", "(page_id % 10) / 10D AS px", "(page_id % 7) / 7D AS py", "(page_id % 12) / 4D AS a")
    return p.selectExpr("page_id", "abs((px - 0.5D) * cos(a) + (py - 0.45D) * sin(a)) <= 0.3D AND abs(-(px - 0.5D) * sin(a) + (py - 0.45D) * cos(a)) <= 0.2D AS inside")


def _blurred(sigma: float, name: str) -> str:
    kernel = near.gaussian(sigma)
    half = len(kernel) // 2

    def conv(source: str, along: str) -> str:
        across = "y" if along == "x" else "x"
        w = f"(PARTITION BY image_id, {across} ORDER BY {along}"
        at = lambda i: "v" if i == 0 else f"coalesce({'lag' if i < 0 else 'lead'}(v, {abs(i)}) OVER {w}), {'first' if i < 0 else 'last'}_value(v) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
        return f"SELECT image_id, y, x, {' + '.join(f'{at(i)} * {k!r}::DOUBLE' for i, k in zip(range(-half, half + 1), kernel))} AS v FROM {source}"

    return f"{name}_h AS ({conv('tile', 'x')}), {name} AS ({conv(f'{name}_h', 'y')})"


SIGMAS = [0.5, 0.8, 1.2]
FIT = ", ".join(_blurred(s, f"s{i}") for i, s in enumerate(SIGMAS))
EACH = " UNION ALL ".join(f"SELECT t.image_id, {s}::DOUBLE AS sigma, d.v - t.v AS d, t.v - s{i}.v AS h FROM tile t JOIN target d USING (image_id, y, x) JOIN s{i} USING (image_id, y, x)" for i, s in enumerate(SIGMAS))


@query(
    f"WITH {TILE}, {FIT}, target AS (SELECT tile.image_id, tile.y, tile.x, tile.v + 2.5::DOUBLE * (tile.v - s1.v) AS v FROM tile JOIN s1 USING (image_id, y, x)), p AS ({EACH}), "
    "f AS (SELECT image_id, sigma, sum(d * h) AS dh, sum(h * h) AS hh, sum(d * d) AS dd FROM p GROUP BY 1, 2), r AS (SELECT image_id, sigma, dh / hh AS k, dd - dh * dh / hh AS rss, dd FROM f) SELECT image_id, arg_min(sigma, rss) AS sigma, round(arg_min(k, rss), 6) AS k, round(1 - min(rss) / max(dd), 6) AS r2 FROM r GROUP BY 1"
)
def usm_fit(spark, sf_dir):
    """Which sigma and gain turn an image into its sharpened copy: least squares over a grid of sigmas."""
    target = lambda t: t.around(0, 0) + 2.5 * (t.around(0, 0) - tiles.blurred(SIGMAS[1])(t))
    both = tiles.with_core(tiles.whole(pixels.images(spark, sf_dir)), "target", target)
    found = tiles.fit_sharpening(both, "target", SIGMAS)
    return found.select("image_id", "sigma", F.round("k", 6).alias("k"), F.round("r2", 6).alias("r2"))


@query("SELECT i.range AS i, i.range % 64 AS x, i.range // 64 AS y, ((CASE WHEN i.range % 64 >= 32 THEN 63 - i.range % 64 ELSE i.range % 64 END) // 4 + 8 * ((CASE WHEN i.range // 64 >= 32 THEN 63 - i.range // 64 ELSE i.range // 64 END) // 4)) % 64 AS colour FROM range(4096) i")
def chart_pixels(spark, sf_dir):
    """A chart of 64 colours in four mirrored quadrants, 64 x 64 pixels."""
    fold = lambda c: f"(CASE WHEN {c} >= 32 THEN 63 - {c} ELSE {c} END)"
    return spark.range(4096).selectExpr("id AS i", "id % 64 AS x", "id div 64 AS y").withColumn("colour", F.expr(f"({fold('x')} div 4 + 8 * ({fold('y')} div 4)) % 64"))


@query("SELECT p_partkey AS id, greatest(0::DOUBLE, least(255::DOUBLE, p_size * 300 * 4 / 65535::DOUBLE * 255)) AS black, greatest(0::DOUBLE, least(255::DOUBLE, (p_size * 200 + 6000) * 4 / 65535::DOUBLE * 255)) AS white, greatest(0.01::DOUBLE, least(3::DOUBLE, p_size / 10::DOUBLE - 1)) AS gamma, floor(greatest(0::DOUBLE, least(255::DOUBLE, p_size * 6::DOUBLE)) / 255 * 16383 + 0.5::DOUBLE)::BIGINT AS boundary FROM part")
def load_levels(spark, sf_dir):
    """14-bit shadows and highlights as levels from 0 to 255, the master gamma, and a level back as 14 bits."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    level = lambda e: f"greatest(0D, least(255D, ({e}) * 4 / 65535D * 255))"
    return part.selectExpr("p_partkey AS id", f"{level('p_size * 300')} AS black", f"{level('p_size * 200 + 6000')} AS white", "greatest(0.01D, least(3D, p_size / 10D - 1)) AS gamma", "CAST(floor(greatest(0D, least(255D, p_size * 6D)) / 255 * 16383 + 0.5D) AS BIGINT) AS boundary")


@query(f"WITH {PX} SELECT {K}, floor(power((power(r / 65535::DOUBLE, 2.2::DOUBLE) + power(g / 65535::DOUBLE, 2.2::DOUBLE) + power(b / 65535::DOUBLE, 2.2::DOUBLE)) / 3, 1 / 2.2::DOUBLE) * 65535 + 0.5::DOUBLE)::BIGINT AS grey FROM px")
def bw_gamma(spark, sf_dir):
    """Grey as the mean of linear light (gamma 2.2)."""
    light = " + ".join(f"pow({c} / 65535D, 2.2D)" for c in "rgb")
    return pixels.points(spark, sf_dir).selectExpr(*pixels.KEY, f"CAST(floor(pow(({light}) / 3, 1 / 2.2D) * 65535 + 0.5D) AS BIGINT) AS grey")


def _spaces_sql() -> str:
    lin = {c: f"CASE WHEN {c} / 65535::DOUBLE <= 0.04045::DOUBLE THEN {c} / 65535::DOUBLE / 12.92::DOUBLE ELSE power(({c} / 65535::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END AS l{c}" for c in "rgb"}
    parts = []
    for space in ("adobe", "prophoto", "display_p3"):
        gamma = 1 / colour.SPACES[space][4]
        rows = []
        for c, row in zip("rgb", colour.space_to_space("srgb", space)):
            total = "0::DOUBLE" + "".join(f" + {float(w)!r}::DOUBLE * l{x}" for w, x in zip(row, "rgb"))
            rows.append(f"floor(power(greatest(least({total}, 1::DOUBLE), 0::DOUBLE), {gamma!r}::DOUBLE) * 65535 + 0.5::DOUBLE)::BIGINT AS {c}")
        parts.append(f"SELECT {K}, {', '.join(rows)}, '{space}' AS space FROM l")
    return f"WITH {PX}, l AS (SELECT {K}, {', '.join(lin.values())} FROM px) {' UNION ALL '.join(parts)}"


@query(_spaces_sql())
def working_spaces(spark, sf_dir):
    """Pixels from sRGB in three other working spaces."""
    px = pixels.points(spark, sf_dir).select(*pixels.KEY, "r", "g", "b")
    return reduce(lambda a, b: a.unionByName(b), [colour.convert(px, "srgb", s).withColumn("space", F.lit(s)) for s in ("adobe", "prophoto", "display_p3")])


def _presets_sql() -> str:
    rows = ", ".join(f"('/presets/kind{i % 2}/p{i}.xml', '{preset_text(i)}')" for i in range(6))
    return f"p(path, xml) AS (VALUES {rows})"


@query(
    f"WITH {_presets_sql()} SELECT path, md5(regexp_replace(xml, '^(.*?<key>Contrast</key>\\s*<(?:integer|real)>)[^<]*(</.*)$', '\\1-35\\2', 's')) AS scalar, md5(regexp_replace(xml, '^(.*?<key>Shadow</key>.*?<array>).*?(</array>.*)$', '\\1<integer>1</integer><integer>2</integer>\\2', 's')) AS array_, "
    "md5(regexp_replace(xml, '^(.*?<key>Contrast</key>\\s*<(?:integer|real)>[^<]*</(?:integer|real)>)(.*)$', '\\1<key>EV</key><real>1.5</real>\\2', 's')) AS inserted FROM p"
)
def xml_patch(spark, sf_dir):
    """Parameter files with one number, one array, or one more key changed."""
    p = sample_presets(spark).filter("path LIKE '%/kind%'")
    x = F.col("xml")
    return p.select("path", F.md5(text.patch_scalar(x, "Contrast", "-35")).alias("scalar"), F.md5(text.patch_array(x, "Shadow", [1, 2])).alias("array_"), F.md5(text.insert_after(x, "Contrast", "EV", "1.5", "real")).alias("inserted"))


@query("SELECT p_partkey AS id, CASE WHEN regexp_matches(n, '^(contrast|brightness|lightness|gamma|ev)') THEN 'tone' WHEN regexp_matches(n, '^(saturation|temperature|tint)') THEN 'color' ELSE 'adv' END AS kind FROM (SELECT p_partkey, ['contrast_p20', 'tint_n50', 'curve_s', 'ev_15', 'saturation_25', 'hist_gray'][p_partkey % 6 + 1] AS n FROM part)")
def preset_kind(spark, sf_dir):
    names = F.array(*map(F.lit, ["contrast_p20", "tint_n50", "curve_s", "ev_15", "saturation_25", "hist_gray"]))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), text.classify_preset(F.get(names, (F.col("p_partkey") % 6).cast("int"))).alias("kind"))


@query(f"WITH {PX}, e AS (SELECT {K}, least(greatest(abs(r - r_ref), abs(g - g_ref), abs(b - b_ref)) / 2000::DOUBLE, 1::DOUBLE) AS t FROM px) SELECT {K}, floor(least(greatest(CASE WHEN t < 0.5 THEN 0 WHEN t < 0.75 THEN (t - 0.5::DOUBLE) / 0.25::DOUBLE ELSE 1 END, 0), 1) * 255)::INT AS mr, floor(least(greatest(CASE WHEN t < 0.25 THEN t / 0.25::DOUBLE WHEN t < 0.75 THEN 1 ELSE 1 - (t - 0.75::DOUBLE) / 0.25::DOUBLE END, 0), 1) * 255)::INT AS mg, floor(least(greatest(CASE WHEN t < 0.25 THEN 1 WHEN t < 0.5 THEN 1 - (t - 0.25::DOUBLE) / 0.25::DOUBLE ELSE 0 END, 0), 1) * 255)::INT AS mb FROM e")
def error_map(spark, sf_dir):
    """The largest difference of each pixel as a colour; 2000 and more is the end of the ramp."""
    px = pixels.points(spark, sf_dir)
    t = F.greatest(*[F.abs(F.col(c) - F.col(f"{c}_ref")) for c in "rgb"]) / 2000.0
    r, g, b = colour.ramp(t)
    return px.select(*pixels.KEY, r.alias("mr"), g.alias("mg"), b.alias("mb"))


@query(f"WITH {PX} SELECT {K}, r >> 8 AS r, g >> 8 AS g, b >> 8 AS b, 255 AS a FROM px")
def rgba_display(spark, sf_dir):
    return pixels.points(spark, sf_dir).select(*pixels.KEY, *[F.shiftright(c, 8).alias(c) for c in "rgb"], F.lit(255).alias("a"))


@query(f"WITH {PX}, t AS (SELECT {K}, r * 255 / 65535::DOUBLE AS x, least(r * 255 // 65535, 254) AS lo FROM px) SELECT {K}, round(((lo * lo // 255) * (1 - (x - lo)) + ((lo + 1) * (lo + 1) // 255) * (x - lo)) * 257, 6) AS v FROM t")
def table_256_interpolated(spark, sf_dir):
    """A 256-entry table read between its entries for 16-bit values; the table is an array of fixed length."""
    table = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(255).cast("bigint")), lambda i: F.floor(i * i / 255.0))
    t = pixels.points(spark, sf_dir).select(*pixels.KEY, (F.col("r") * 255 / 65535.0).alias("x"), F.least(F.expr("r * 255 div 65535"), F.lit(254)).cast("int").alias("lo"), table.alias("t"))
    part = F.col("x") - F.col("lo")
    return t.select(*pixels.KEY, F.round((F.get("t", F.col("lo")) * (1 - part) + F.get("t", F.col("lo") + 1) * part) * 257, 6).alias("v"))


# Small numbers around each step's threshold, by residues of the part's key and size; the same text in both engines.
PARAMS = {
    **{f"apply_{step}": f"p_partkey % {m} = 0" for step, m in zip(rel.NEUTRAL, (2, 97, 3, 5, 4, 7, 2, 6, 3, 2, 5, 4, 11))},
    **{name: f"(p_size % {m}) / {d}" for name, m, d in (("exposure", 3, 1500), ("brightness", 2, 15), ("lightness", 4, 20), ("contrast", 3, 15), ("highlights", 2, 9), ("shadows", 5, 30), ("saturation", 2, 12), ("r_shift", 3, 25), ("g_shift", 2, 30), ("b_shift", 4, 35), ("temperature", 3, 25), ("tint", 2, 9))},
    "midtone": "1 + (p_size % 4) / 250",
}
LISTS = {"black": ["p_size % 3 / 4", "0", "0"], "gamma": ["1", "1 + p_size % 5 / 300", "1"], "white": ["255 - p_size % 2 / 3", "255", "255"], "out_low": ["0", "p_size % 7 / 13", "0"], "out_high": ["255", "255", "255 - p_size % 3 / 5"], "matrix": ["0", "p_size % 2", "0"]}


def _neutral_sql() -> str:
    real = lambda e: e.replace(" / ", "::DOUBLE / ")
    columns = [f"{real(e)} AS {k}" for k, e in PARAMS.items()] + [f"[{', '.join(f'({real(e)})::DOUBLE' for e in es)}] AS {k}" for k, es in LISTS.items()]
    tests = {k: re.sub(r"forall\((\w+), v -> (.*?)\)(?= AND|$)", r"len(list_filter(\1, lambda v: NOT (\2))) = 0", t) for k, t in rel.NEUTRAL.items()}
    return f"SELECT id, {' AND '.join(f'(NOT apply_{k} OR ({t}))' for k, t in tests.items())} AS neutral FROM (SELECT p_partkey AS id, {', '.join(columns)} FROM part)"


@query(_neutral_sql())
def identity_parameters(spark, sf_dir):
    """Do a set's parameters leave an image as it is? Thirteen steps, each switched off or near its neutral value."""
    real = lambda e: f"CAST({e} AS DOUBLE)"
    columns = [f"{e} AS {k}" for k, e in PARAMS.items()] + [f"array({', '.join(map(real, es))}) AS {k}" for k, es in LISTS.items()]
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS id", *columns).select("id", rel.neutral().alias("neutral"))


@query("SELECT p_partkey AS id, len(list_filter(m, lambda c: c <> -s)) > 0 AS custom, p_size % 3 = 0 AND len(list_filter(m, lambda c: c <> -s)) > 0 AS applies FROM (SELECT p_partkey, p_size, p_size % 4 AS s, [-(p_size % 4), -(p_size % 4), CASE WHEN p_partkey % 5 = 0 THEN 7 ELSE -(p_size % 4) END] AS m FROM part)")
def custom_matrix(spark, sf_dir):
    """Is any cell of a matrix other than minus the saturation? And does the matrix apply?"""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS id", "p_size", "p_size % 4 AS s", "array(-(p_size % 4), -(p_size % 4), CASE WHEN p_partkey % 5 = 0 THEN 7 ELSE -(p_size % 4) END) AS m")
    custom = F.exists("m", lambda c: c != -F.col("s"))
    return p.select("id", custom.alias("custom"), ((F.col("p_size") % 3 == 0) & custom).alias("applies"))


@query("SELECT DISTINCT regexp_extract(url, '^([^:]*://[^/?#]*)', 1) AS root FROM pages WHERE page_id % 2 = 0 UNION SELECT DISTINCT regexp_extract(url, '^([^:]*://[^/?#]*)', 1) FROM pages WHERE page_id % 3 = 0")
def distinct_roots(spark, sf_dir):
    roots = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", r"^([^:]*://[^/?#]*)", 1).alias("root"))
    return roots.filter("page_id % 2 = 0").select("root").unionByName(roots.filter("page_id % 3 = 0").select("root")).distinct()


@query(f"WITH {PX} SELECT {K}, " + ", ".join(f"trunc(greatest(0::FLOAT, least(65535::FLOAT, {c}::FLOAT * {g}::FLOAT + {o}::FLOAT * 257::FLOAT)))::BIGINT AS {c}" for c, g, o in zip("rgb", *point.NEGATIVE_CALIBRATION[True])) + " FROM px")
def negative_calibration(spark, sf_dir):
    """The calibration of colour negatives with an input profile, in 32-bit floats."""
    return point.calibrate_negative(pixels.points(spark, sf_dir), 1, "in.icc").select(*pixels.KEY, "r", "g", "b")
