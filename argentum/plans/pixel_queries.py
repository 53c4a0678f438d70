"""Queries over the pixel relations, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.operators import aggregates as agg
from argentum.operators import neighbourhood as near
from argentum.operators import ordered, point, tiles
from argentum.plans import steps_sql
from argentum.sources import pixels

QUERIES, SQL = {}, {}
KEY = pixels.KEY
K = ", ".join(KEY)
PX, LONG, TILE = pixels.POINTS_SQL, pixels.LONG_SQL, pixels.TILES_SQL


def query(sql: str | None = None):
    """Registers a query under its function's name; sql goes on after the WITH of the relations that it names."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            used = [r for name, r in (("px", PX), ("long", LONG), ("tile", TILE)) if f"{{{name}}}" in sql]
            body = sql.replace("{px}", "").replace("{long}", "").replace("{tile}", "").strip()
            SQL[f.__name__] = (f"WITH {', '.join(used)}{', ' if body.startswith('&') else ' '}{body.lstrip('&')}") if used else body
        return f

    return add


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.points(spark, sf_dir)


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.whole(pixels.images(spark, sf_dir))


def small(spark: SparkSession, sf_dir: str, halo: int) -> DataFrame:
    """The images in tiles of 5 x 5 with a halo."""
    return tiles.split(whole(spark, sf_dir), 5, halo)


def rounded(made: DataFrame) -> DataFrame:
    return tiles.pixels(made, "out").withColumn("v", F.round("v", 6))


def counted(made: DataFrame) -> DataFrame:
    return tiles.pixels(made, "out").withColumn("v", F.col("v").cast("bigint"))


def rgb(df: DataFrame) -> DataFrame:
    return df.select(*KEY, "r", "g", "b")


def each(e: str) -> str:
    """The SQL expression for each of the channels."""
    return ", ".join(f"{e.replace('@', c)} AS {c}" for c in "rgb")


@query(f"{{px}} SELECT {K}, r, g, b, r_ref, g_ref, b_ref FROM px")
def px_point(spark, sf_dir):
    return px(spark, sf_dir).select(*KEY, "r", "g", "b", "r_ref", "g_ref", "b_ref")


@query("{tile} SELECT image_id, y, x, v FROM tile")
def px_tile(spark, sf_dir):
    return pixels.tiles(spark, sf_dir)


@query(f"{{px}} SELECT {K}, {each('(@ >> 8) * 257')} FROM px")
def widen_8_16(spark, sf_dir):
    return px(spark, sf_dir).select(*KEY, *[F.expr(point.widen(point.narrow(c))).alias(c) for c in "rgb"])


@query(f"{{px}} SELECT {K}, {each('@ >> 8')} FROM px")
def narrow_16_8(spark, sf_dir):
    return px(spark, sf_dir).select(*KEY, *[F.expr(point.narrow(c)).alias(c) for c in "rgb"])


@query(f"{{px}} SELECT {K}, ((299 * (r >> 2) + 587 * (g >> 2) + 114 * (b >> 2)) // 1000) << 2 AS grey FROM px")
def bw_luma_int(spark, sf_dir):
    return px(spark, sf_dir).select(*KEY, F.expr(point.GREYS["luma_int"]).alias("grey"))


@query(f"{{px}} SELECT {K}, floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5::DOUBLE)::BIGINT AS grey FROM px")
def bw_luma_round(spark, sf_dir):
    return px(spark, sf_dir).select(*KEY, F.expr(point.GREYS["luma_round"]).alias("grey"))


@query(f"{{px}} SELECT {K}, (r + g + b) // 3 AS grey FROM px")
def bw_mean(spark, sf_dir):
    return px(spark, sf_dir).select(*KEY, F.expr(point.GREYS["mean"]).alias("grey"))


HIGH = (15000, 14000, 12000)


def _inv(c: str) -> str:
    return f"greatest({4 * HIGH['rgb'.index(c)]}::FLOAT - {c}::FLOAT, 0::FLOAT) * (65535::FLOAT / {4 * HIGH['rgb'.index(c)]}::FLOAT)"


@query(f"{{px}} SELECT {K}, {', '.join(f'trunc(greatest(least({_inv(c)}, 65535::FLOAT), 0::FLOAT))::BIGINT AS {c}' for c in 'rgb')} FROM px")
def film_invert(spark, sf_dir):
    return rgb(point.invert_negative(px(spark, sf_dir), HIGH))


@query(f"{{px}}, i AS (SELECT {K}, 0.299::FLOAT * ({_inv('r')}) + 0.587::FLOAT * ({_inv('g')}) + 0.114::FLOAT * ({_inv('b')}) AS l FROM px) SELECT {K}, {each('trunc(greatest(least(l, 65535::FLOAT), 0::FLOAT))::BIGINT')} FROM i".replace("{px}, i", "{px} &i"))
def film_invert_grey(spark, sf_dir):
    return rgb(point.invert_negative(px(spark, sf_dir), HIGH, grey=True))


@query(
    "{px} {long} &b AS (SELECT ch, least(255, CASE WHEN v >= h THEN 0 ELSE (h - v) * 255 // h END) AS bin, count(*) AS n FROM (SELECT ch, v, CASE ch WHEN 'R' THEN 60000 WHEN 'G' THEN 56000 ELSE 48000 END AS h FROM long) GROUP BY 1, 2) "
    "SELECT c.ch, r.bin::BIGINT AS bin, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('R'), ('G'), ('B')) c(ch) CROSS JOIN (SELECT unnest(range(0, 256)) AS bin) r LEFT JOIN b ON b.ch = c.ch AND b.bin = r.bin"
)
def neg_hist_bin(spark, sf_dir):
    long = pixels.long(px(spark, sf_dir))
    bin_ = F.when(F.col("ch") == "R", agg.negative_bin("v", HIGH[0])).when(F.col("ch") == "G", agg.negative_bin("v", HIGH[1])).otherwise(agg.negative_bin("v", HIGH[2]))
    return agg.histogram(long, ["ch"], bin_, 256)


@query(f"{{px}} SELECT {K}, floor(greatest(0::DOUBLE, least(65535::DOUBLE, r * 1.02::DOUBLE + -1.5::DOUBLE * 257::DOUBLE)))::BIGINT AS r, floor(greatest(0::DOUBLE, least(65535::DOUBLE, g * 0.98::DOUBLE + 2.0::DOUBLE * 257::DOUBLE)))::BIGINT AS g, floor(greatest(0::DOUBLE, least(65535::DOUBLE, b * 1.1::DOUBLE + 0.0::DOUBLE * 257::DOUBLE)))::BIGINT AS b FROM px")
def affine_calib(spark, sf_dir):
    return rgb(point.affine(px(spark, sf_dir), (1.02, 0.98, 1.1), (-1.5, 2.0, 0.0)))


@query(f"{{px}} SELECT {K}, " + ", ".join(f"greatest(0::DOUBLE, least(65535::DOUBLE, floor({c} * {f}::DOUBLE + 0.5::DOUBLE)))::BIGINT AS {c}" for c, f in zip("rgb", ("1.25", "0.5", "2.0"))) + " FROM px")
def channel_gains(spark, sf_dir):
    return rgb(point.gains(px(spark, sf_dir), (1.25, 0.5, 2.0)))


@query(f"{{px}} SELECT {K}, " + ", ".join(f"floor(greatest(0::DOUBLE, least(65535::DOUBLE, g0 + ({c} - g0) * 1.25::DOUBLE)))::BIGINT AS {c}" for c in "rgb") + " FROM (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS g0 FROM px)")
def saturation(spark, sf_dir):
    return rgb(point.saturate(px(spark, sf_dir), 25.0))


MATRIX = [[1.1, -0.1, 0.05], [0.02, 0.95, 0.0], [-0.2, 0.1, 1.3]]


@query(f"{{px}} SELECT {K}, " + ", ".join(f"floor(greatest(0::DOUBLE, least(65535::DOUBLE, {' + '.join(f'{w}::DOUBLE * {x}' for w, x in zip(row, 'rgb'))})))::BIGINT AS {c}" for c, row in zip("rgb", MATRIX)) + " FROM px")
def matrix3(spark, sf_dir):
    return rgb(point.matrix(px(spark, sf_dir), MATRIX))


CONTRAST = "trunc(least(greatest((@::FLOAT / 65535::FLOAT - 0.5::FLOAT) * (1::FLOAT + 0.2::FLOAT * 2::FLOAT) + 0.5::FLOAT, 0::FLOAT), 1::FLOAT) * 65535::FLOAT)::BIGINT"


@query(f"{{px}} SELECT {K}, {each(CONTRAST)} FROM px")
def display_contrast(spark, sf_dir):
    return rgb(point.display(px(spark, sf_dir), point.Display(contrast=20.0)))


STEPS = point.Display(out_low=(5.0, 0.0, 10.0), out_high=(250.0, 255.0, 240.0), shift=(3.0, -2.0, 0.0), exposure=0.5, temperature=20.0, tint=-10.0, shadows=15.0, highlights=-20.0, contrast=10.0, brightness=5.0, depth=12.0, midtone=1.2, saturation=20.0, matrix=((1.05, -0.05, 0.0), (0.0, 1.0, 0.0), (0.0, 0.02, 0.98)))


@query(f"{{px}} {steps_sql.chain(f'SELECT {K}, r, g, b FROM px', K, steps_sql.display(STEPS))}")
def display_adjust(spark, sf_dir):
    """All display steps."""
    return rgb(point.display(px(spark, sf_dir), STEPS))


LEVEL = "trunc(least(greatest((@::FLOAT / 65535::FLOAT - 12::FLOAT / 255::FLOAT) / greatest(240::FLOAT / 255::FLOAT - 12::FLOAT / 255::FLOAT, 0.001::FLOAT), 0::FLOAT), 1::FLOAT) * 65535::FLOAT)::BIGINT"


@query(f"{{px}} SELECT {K}, {each(LEVEL)} FROM px")
def scanner_levels(spark, sf_dir):
    return rgb(point.look_up(px(spark, sf_dir), point.level_tables((12, 12, 12), (240, 240, 240), (1, 1, 1))))


LEVELS = ((12, 8, 30), (240, 230, 250), (1.1, 0.9, 1.3), 1.4)


@query(f"{{px}} {steps_sql.chain(f'SELECT {K}, r, g, b FROM px', K, steps_sql.levels(*LEVELS))}")
def scanner_levels_gamma(spark, sf_dir):
    return rgb(point.look_up(px(spark, sf_dir), point.level_tables(*LEVELS)))


@query(f"{{px}} SELECT {K}, {each('least(65535, (@ >> 2) * 3)')} FROM px")
def lut_apply(spark, sf_dir):
    import numpy as np

    table = np.minimum(65535, (np.arange(65536) >> 2) * 3)
    return rgb(point.look_up(px(spark, sf_dir), np.array([table] * 3)))


@query("SELECT o.range AS o, (SELECT arg_min(x.range, abs(x.range * x.range // 255 - o.range) * 1000 + x.range) FROM range(256) x)::BIGINT AS x FROM range(256) o")
def lut_invert_256(spark, sf_dir):
    """The nearest input for each output of a table: by relation, with the smallest input on ties."""
    x = spark.range(256).selectExpr("id AS x", "id * id div 255 AS v")
    outputs = spark.range(256).withColumnRenamed("id", "o")
    return outputs.join(F.broadcast(x), F.lit(True)).groupBy("o").agg(F.min_by("x", F.struct(F.abs(F.col("o") - F.col("v")), F.col("x"))).alias("x"))  # two tables of 256 rows


# master; red, green, blue; cyan, magenta, yellow
CURVES = [[(0, 0), (64, 50), (192, 210), (255, 255)], [(0, 0), (128, 140), (255, 255)], [(0, 10), (255, 245)], [(0, 0), (255, 255)], [(0, 0), (100, 120), (255, 255)], [(0, 0), (255, 255)], [(0, 20), (90, 100), (255, 230)]]


@query(f"{{px}} {steps_sql.chain(f'SELECT {K}, r, g, b FROM px', K, steps_sql.curves(CURVES))}")
def gradation_curves(spark, sf_dir):
    return rgb(point.gradation(px(spark, sf_dir), CURVES))


HIST = "SELECT c.ch, r.bin::BIGINT AS bin, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('R'), ('G'), ('B')) c(ch) CROSS JOIN (SELECT unnest(range(0, 256)) AS bin) r LEFT JOIN (SELECT ch, v >> 8 AS bin, count(*) AS n FROM long GROUP BY 1, 2) b ON b.ch = c.ch AND b.bin = r.bin"


def _hist(spark, sf_dir):
    return agg.histogram(pixels.long(px(spark, sf_dir)), ["ch"], F.shiftright("v", 8), 256)


@query(f"{{px}} {{long}} {HIST}")
def hist_256(spark, sf_dir):
    return _hist(spark, sf_dir)


@query(f"{{px}} {{long}} &h AS ({HIST}) SELECT ch, bin, n FROM h UNION ALL SELECT 'max', bin, max(n) FROM h GROUP BY bin")
def hist_composite(spark, sf_dir):
    return agg.composite(_hist(spark, sf_dir))


@query("{px} {long} SELECT ch, v, count(*) AS n FROM long GROUP BY 1, 2")
def hist_65536(spark, sf_dir):
    return pixels.long(px(spark, sf_dir)).groupBy("ch", "v").agg(F.count("*").alias("n"))


@query("{px} {long} SELECT ch, v >> 4 AS bin, count(*) AS n FROM (SELECT ch, v >> 4 AS v FROM long) GROUP BY 1, 2")
def hist_12_bit(spark, sf_dir):
    return pixels.long(px(spark, sf_dir)).selectExpr("ch", "shiftright(shiftright(v, 4), 4) AS bin").groupBy("ch", "bin").agg(F.count("*").alias("n"))


@query("{px} {long} SELECT image_id, CASE WHEN max(v) <= 4095 THEN 12 WHEN max(v) <= 16383 THEN 14 ELSE 16 END AS bits FROM long GROUP BY 1")
def bit_depth(spark, sf_dir):
    return pixels.long(px(spark, sf_dir)).groupBy("image_id").agg(F.max("v").alias("top")).select("image_id", agg.bit_depth("top").alias("bits"))


@query("{px} {long} SELECT image_id, ch, min(v) AS low, max(v) AS high, avg(v) AS mean FROM long GROUP BY 1, 2")
def channel_stats(spark, sf_dir):
    return pixels.long(px(spark, sf_dir)).groupBy("image_id", "ch").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"))


@query("{px} SELECT image_id, avg(r) / 257 AS r, avg(g) / 257 AS g, avg(b) / 257 AS b FROM px GROUP BY 1")
def image_means(spark, sf_dir):
    return px(spark, sf_dir).groupBy("image_id").agg(*[(F.avg(c) / 257).alias(c) for c in "rgb"])


CLIP = (
    "h AS (SELECT ch, v, count(*) AS n FROM long GROUP BY 1, 2), u AS (SELECT *, sum(n) OVER (PARTITION BY ch ORDER BY v) AS up, sum(n) OVER (PARTITION BY ch ORDER BY v DESC) AS down, sum(n) OVER (PARTITION BY ch) AS t FROM h), "
    "l AS (SELECT ch, min(CASE WHEN up >= greatest(floor(t * 0.05::DOUBLE / 100), 1) THEN v END) * (255::DOUBLE / 65535) AS low, max(CASE WHEN down >= greatest(floor(t * 0.1::DOUBLE / 100), 1) THEN v END) * (255::DOUBLE / 65535) AS h1 FROM u GROUP BY 1)"
)


def _clip(spark, sf_dir):
    counts = pixels.long(px(spark, sf_dir)).groupBy("ch", F.col("v").alias("bin")).agg(F.count("*").alias("n"))
    return agg.clip_levels(counts, ["ch"], 65536, 0.05, 0.1)


@query(f"{{px}} {{long}} &{CLIP} SELECT ch, low, greatest(h1, low + 0.1::DOUBLE) AS high FROM l")
def auto_levels(spark, sf_dir):
    return _clip(spark, sf_dir)


@query(f"{{px}} {{long}} &{CLIP} SELECT min(low) AS low, max(greatest(h1, low + 0.1::DOUBLE)) AS high FROM l")
def master_levels(spark, sf_dir):
    return _clip(spark, sf_dir).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _errors(by: str) -> str:
    """Error metrics by a column (or over everything) in SQL, with exact ranks by percentile_disc's rule."""
    rank = lambda p: f"list_sort(list(abs(v - ref)))[greatest(ceil(count(*) * {p}::DOUBLE / 100)::BIGINT, 1)]"
    band = lambda c: f"coalesce(sum(abs(v - ref)) FILTER ({c}) / nullif(count(*) FILTER ({c}), 0)::DOUBLE, 0::DOUBLE)"
    return (
        f"SELECT *, least(p99_16 >> 8, 255) AS p99_8, CASE WHEN mse > 0 THEN 10 * log10(65025::DOUBLE / mse) ELSE 'inf'::DOUBLE END AS psnr_8, CASE WHEN mae_16 <= 100 AND p99_16 <= 500 THEN 'STRICT' WHEN mae_16 <= 400 AND p99_16 <= 2000 THEN 'PASS' WHEN mae_16 <= 1280 AND p99_16 <= 5000 THEN 'WARN' ELSE 'FAIL' END AS grade FROM ("
        f"SELECT {by + ', ' if by else ''}count(*) AS n, sum(abs(v - ref)) / count(*)::DOUBLE AS mae_16, sum(v - ref) / count(*)::DOUBLE AS mean_signed, max(abs(v - ref)) AS max_16, {band('WHERE ref < 13107')} AS mae_shadow, {band('WHERE ref >= 13107 AND ref < 52428')} AS mae_mid, {band('WHERE ref >= 52428')} AS mae_high, "
        f"sum(abs((v >> 8) - (ref >> 8))) / count(*)::DOUBLE AS mae_8, sum(power((v >> 8) - (ref >> 8), 2)) / count(*)::DOUBLE AS mse, {rank(50)} AS p50_16, {rank(95)} AS p95_16, {rank(99)} AS p99_16, {rank(99.9)} AS p999_16 FROM long{' GROUP BY ' + by if by else ''})"
    )


@query("{px} {long} SELECT * EXCLUDE (mse) REPLACE (round(psnr_8, 9) AS psnr_8) FROM (" + _errors("image_id, ch") + ")")
def err_stats(spark, sf_dir):
    return agg.error_stats(pixels.long(px(spark, sf_dir)), ["image_id", "ch"]).withColumn("psnr_8", F.round("psnr_8", 9))


@query("{px} {long} SELECT * EXCLUDE (mse) REPLACE (round(psnr_8, 9) AS psnr_8) FROM (" + _errors("") + ")")
def err_total(spark, sf_dir):
    return agg.error_stats(pixels.long(px(spark, sf_dir)), []).withColumn("psnr_8", F.round("psnr_8", 9))


CONTRAST_LONG = ", ".join(["c AS (SELECT image_id, " + each(CONTRAST) + ", r_ref, g_ref, b_ref FROM px)", "long AS (SELECT image_id, 'R' AS ch, r AS v, r_ref AS ref FROM c UNION ALL SELECT image_id, 'G', g, g_ref FROM c UNION ALL SELECT image_id, 'B', b, b_ref FROM c)"])


@query(f"{{px}} &{CONTRAST_LONG} SELECT * EXCLUDE (mse) REPLACE (round(psnr_8, 9) AS psnr_8) FROM (" + _errors("ch") + ")")
def graded_contrast(spark, sf_dir):
    """The flagship: source, table join, error metrics by channel, exact ranks, grade."""
    return agg.error_stats(pixels.long(point.display(px(spark, sf_dir), point.Display(contrast=20.0))), ["ch"]).withColumn("psnr_8", F.round("psnr_8", 9))


@query("{px} {long} SELECT grade, count(*) AS n FROM (" + _errors("image_id") + ") GROUP BY 1")
def grade_counts(spark, sf_dir):
    return agg.error_stats(pixels.long(px(spark, sf_dir)), ["image_id"]).groupBy("grade").agg(F.count("*").alias("n"))


@query("{px} {long} SELECT coalesce(image_id::VARCHAR, 'TOTAL') AS image, count(*) FILTER (WHERE grade = 'STRICT') AS strict, count(*) FILTER (WHERE grade = 'PASS') AS pass, count(*) FILTER (WHERE grade = 'WARN') AS warn, count(*) FILTER (WHERE grade = 'FAIL') AS fail, round(avg(mae_16), 9) AS mae FROM (" + _errors("image_id, ch") + ") GROUP BY ROLLUP (image_id)")
def grand_summary(spark, sf_dir):
    stats = agg.error_stats(pixels.long(px(spark, sf_dir)), ["image_id", "ch"])
    of = lambda g: F.count_if(F.col("grade") == g)
    return stats.rollup("image_id").agg(of("STRICT").alias("strict"), of("PASS").alias("pass"), of("WARN").alias("warn"), of("FAIL").alias("fail"), F.round(F.avg("mae_16"), 9).alias("mae")).select(F.coalesce(F.col("image_id").cast("string"), F.lit("TOTAL")).alias("image"), "strict", "pass", "warn", "fail", "mae")


@query("{px} {long} SELECT ch, quantile_disc(abs(v - ref), 0.5) AS p50, quantile_disc(abs(v - ref), 0.95) AS p95 FROM long GROUP BY 1")
def percentile_rank(spark, sf_dir):
    counts = pixels.long(px(spark, sf_dir)).selectExpr("ch", "abs(v - ref) AS d").groupBy("ch", "d").agg(F.count("*").alias("n"))
    return agg.nearest_rank(counts, ["ch"], "d", {"p50": 50.0, "p95": 95.0})


@query("{px} {long} SELECT ch, quantile_cont(abs(v - ref), 0.5) AS p50, quantile_cont(abs(v - ref), 0.9) AS p90 FROM long GROUP BY 1")
def percentile_linear(spark, sf_dir):
    d = pixels.long(px(spark, sf_dir)).selectExpr("ch", "abs(v - ref) AS d")
    return d.groupBy("ch").agg(F.percentile("d", 0.5).alias("p50"), F.percentile("d", 0.9).alias("p90"))


@query("{px} {long} &d AS (SELECT ch, abs((v >> 8) - (ref >> 8)) AS d FROM long) SELECT ch, avg(d) AS mae, max(d) AS top, CASE WHEN avg(d * d) > 0 THEN 10 * log10(65025::DOUBLE / avg(d * d)) ELSE 'inf'::DOUBLE END AS psnr, count(*) AS n, count(*) FILTER (WHERE d > 5) AS over_5, count(*) FILTER (WHERE d > 10) AS over_10 FROM d GROUP BY 1")
def channel_errors_8(spark, sf_dir):
    return agg.errors_8(pixels.long(px(spark, sf_dir)), ["ch"])


@query("{px} {long} &s AS (SELECT ch, count(*)::DOUBLE AS n, sum(v)::DOUBLE AS sx, sum(ref)::DOUBLE AS sy, sum(v * v)::DOUBLE AS sxx, sum(v * ref)::DOUBLE AS sxy FROM long GROUP BY 1), g AS (SELECT *, CASE WHEN n * sxx - sx * sx = 0 THEN 1::DOUBLE ELSE (n * sxy - sx * sy) / (n * sxx - sx * sx) END AS gain FROM s), o AS (SELECT ch, gain, (sy - gain * sx) / n AS \"offset\" FROM g) SELECT ch, gain, \"offset\", round(avg(abs(greatest(0::DOUBLE, least(65535::DOUBLE, gain * v + \"offset\")) - ref)), 6) AS mae FROM o JOIN long USING (ch) GROUP BY ALL")
def affine_fit(spark, sf_dir):
    """The least-squares line of each channel, and the mean error of what it gives."""
    long = pixels.long(px(spark, sf_dir))
    return agg.fitted_error(long, agg.affine_fit(long, ["ch"]), ["ch"], 65535.0).withColumn("mae", F.round("mae", 6))


@query("{px} {long} SELECT ch, v * 1024 // 65536 AS bin, sum(ref) / count(*)::DOUBLE AS mean, count(*) AS n FROM long GROUP BY 1, 2")
def binned_mean(spark, sf_dir):
    return pixels.long(px(spark, sf_dir)).groupBy("ch", F.expr("v * 1024 div 65536").alias("bin")).agg((F.sum("ref") / F.count("*")).alias("mean"), F.count("*").alias("n"))


@query("{px} {long} SELECT ch, bin, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, count(*) AS images FROM (SELECT image_id, ch, v >> 12 AS bin, sum(ref) / count(*)::DOUBLE AS m FROM long GROUP BY 1, 2, 3) GROUP BY 1, 2")
def bin_std(spark, sf_dir):
    one = pixels.long(px(spark, sf_dir)).groupBy("image_id", "ch", F.shiftright("v", 12).alias("bin")).agg((F.sum("ref") / F.count("*")).alias("m"))
    return one.groupBy("ch", "bin").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("std"), F.count("*").alias("images"))


@query("{px} {long} SELECT ch, v >> 12 AS bin, round(sqrt(var_pop(ref)), 6) AS std FROM long GROUP BY 1, 2")
def bin_spread(spark, sf_dir):
    return pixels.long(px(spark, sf_dir)).groupBy("ch", F.shiftright("v", 12).alias("bin")).agg(F.round(F.sqrt(F.var_pop("ref")), 6).alias("std"))


PLACE = ["k_part", "k_order", "k_line", "image_id", "k_price"]
WORST = 50


@query(
    f"{{px}} &d AS (SELECT {K}, greatest(abs(r - r_ref), abs(g - g_ref), abs(b - b_ref)) AS d_max FROM px), t AS (SELECT min(d_max) AS t FROM (SELECT d_max FROM d ORDER BY d_max DESC LIMIT {WORST})), e AS (SELECT d.* FROM d, t WHERE d_max >= t ORDER BY {K} LIMIT {WORST}), "
    f"o AS (SELECT d.* FROM d, t WHERE d_max > t), m AS (SELECT e.* FROM e, t WHERE d_max = t ORDER BY {', '.join(f'{c} DESC' for c in PLACE)} LIMIT {WORST}), n AS (SELECT count(*) AS n FROM o), "
    f"k AS (SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (ORDER BY {', '.join(f'{c} DESC' for c in PLACE)}) AS i FROM m) WHERE i <= {WORST} - (SELECT n FROM n)) SELECT * FROM o UNION ALL SELECT * FROM k"
)
def worst_n(spark, sf_dir):
    """What a scan keeps that lets in only larger differences than its smallest."""
    return agg.worst(px(spark, sf_dir), WORST, KEY, PLACE).select(*KEY, "d_max")


@query("{tile} SELECT image_id, sum(v) / count(*)::DOUBLE AS mean FROM tile WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY 1")
def tile_mean(spark, sf_dir):
    return pixels.tiles(spark, sf_dir).filter("y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5").groupBy("image_id").agg((F.sum("v") / F.count("*")).alias("mean"))


@query("{px} {long} SELECT ch, v >> 8 AS bin, count(*) AS n, sum(count(*)) OVER (PARTITION BY ch ORDER BY v >> 8)::BIGINT AS up FROM long GROUP BY 1, 2")
def cumulative_hist(spark, sf_dir):
    counts = pixels.long(px(spark, sf_dir)).groupBy("ch", F.shiftright("v", 8).alias("bin")).agg(F.count("*").alias("n"))
    return ordered.cumulative(counts, ["ch"], "bin", "n", "up")


BINNED = "bm AS (SELECT ch, v >> 9 AS bin, sum(ref) / count(*)::DOUBLE AS m FROM long GROUP BY 1, 2)"


def _binned(spark, sf_dir):
    return pixels.long(px(spark, sf_dir)).groupBy("ch", F.shiftright("v", 9).alias("bin")).agg((F.sum("ref") / F.count("*")).alias("m"))


@query(f"{{px}} {{long}} &{BINNED} SELECT ch, bin, max(m) OVER (PARTITION BY ch ORDER BY bin) AS m FROM bm")
def monotone_envelope(spark, sf_dir):
    return ordered.monotone(_binned(spark, sf_dir), ["ch"], "bin", "m", "m").select("ch", "bin", "m")


GRID = "g AS (SELECT c.ch, r.bin, m FROM (VALUES ('R'), ('G'), ('B')) c(ch) CROSS JOIN (SELECT unnest(range(0, 128)) AS bin) r LEFT JOIN bm ON bm.ch = c.ch AND bm.bin = r.bin)"
GAPS = (
    f"{BINNED}, {GRID}, e AS (SELECT *, last_value(CASE WHEN m IS NOT NULL THEN bin END IGNORE NULLS) OVER a AS lx, last_value(m IGNORE NULLS) OVER a AS ly, first_value(CASE WHEN m IS NOT NULL THEN bin END IGNORE NULLS) OVER z AS rx, first_value(m IGNORE NULLS) OVER z AS ry FROM g "
    "WINDOW a AS (PARTITION BY ch ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY ch ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), "
    "f AS (SELECT ch, bin, coalesce(m, CASE WHEN lx IS NULL THEN ry WHEN rx IS NULL THEN ly ELSE ly * (1 - (bin - lx) / nullif(rx - lx, 0)::DOUBLE) + ry * ((bin - lx) / nullif(rx - lx, 0)::DOUBLE) END, 0::DOUBLE) AS m FROM e)"
)


def _filled(spark, sf_dir):
    grid = spark.range(128).select(F.col("id").alias("bin"), F.explode(F.array(*map(F.lit, "RGB"))).alias("ch"))
    return ordered.fill_gaps(grid.join(_binned(spark, sf_dir), ["ch", "bin"], "left"), ["ch"], "bin", "m", "m").select("ch", "bin", "m")


@query(f"{{px}} {{long}} &{GAPS} SELECT ch, bin, m FROM f")
def gap_interp(spark, sf_dir):
    return _filled(spark, sf_dir)


@query(f"{{px}} {{long}} &{GAPS}, o AS (SELECT c.ch, i.range AS i, least(floor(i.range * 127::DOUBLE / 4095)::BIGINT, 126) AS k FROM (VALUES ('R'), ('G'), ('B')) c(ch) CROSS JOIN range(4096) i) SELECT o.ch, o.i, round(x.m * (1 - (o.i * 127::DOUBLE / 4095 - o.k)) + y.m * (o.i * 127::DOUBLE / 4095 - o.k), 6) AS m FROM o JOIN f x ON x.ch = o.ch AND x.bin = o.k JOIN f y ON y.ch = o.ch AND y.bin = o.k + 1")
def resample(spark, sf_dir):
    out = ordered.resample(_filled(spark, sf_dir), ["ch"], "bin", "m", 128, 4096)
    return out.select("ch", "i", F.round("m", 6).alias("m"))


PEAKS = f"h AS ({HIST}), w AS (SELECT *, max(n) OVER (PARTITION BY ch) AS top, max(n) OVER (PARTITION BY ch ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS five, lag(n, 2) OVER (PARTITION BY ch ORDER BY bin) AS b2, lead(n) OVER (PARTITION BY ch ORDER BY bin) AS a1 FROM h), p AS (SELECT ch, bin, n FROM w WHERE bin BETWEEN 1 AND 254 AND n >= floor(top * 0.3::DOUBLE) AND n = five AND (bin < 2 OR n > b2 OR n > a1))"


@query(f"{{px}} {{long}} &{PEAKS} SELECT ch, bin, n FROM p")
def peaks(spark, sf_dir):
    return ordered.peaks(_hist(spark, sf_dir), ["ch"], 0.3)


@query(f"{{px}} {{long}} &{PEAKS}, q AS (SELECT ch, bin AS peak, lead(bin) OVER (PARTITION BY ch ORDER BY bin) AS nx FROM p) SELECT q.ch, q.peak, arg_min(h.bin, h.n * 1000 + h.bin) AS bin, min(h.n) AS n FROM q JOIN h ON h.ch = q.ch AND h.bin > q.peak AND h.bin < q.nx GROUP BY 1, 2")
def valleys(spark, sf_dir):
    hist = _hist(spark, sf_dir)
    return ordered.valleys(hist, ordered.peaks(hist, ["ch"], 0.3), ["ch"])


KERNEL = near.gaussian(0.8)


def _conv(table: str, along: str, value: str = "v", kernel: list[float] = KERNEL) -> str:
    across = "y" if along == "x" else "x"
    w = f"(PARTITION BY image_id, {across} ORDER BY {along})"
    half = len(kernel) // 2
    at = lambda i: value if i == 0 else f"coalesce({'lag' if i < 0 else 'lead'}({value}, {abs(i)}) OVER {w}, {'first' if i < 0 else 'last'}_value({value}) OVER (PARTITION BY image_id, {across} ORDER BY {along} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    return f"SELECT image_id, y, x, {' + '.join(f'{at(i)} * {k!r}::DOUBLE' for i, k in zip(range(-half, half + 1), kernel))} AS v FROM {table}"


@query(f"{{tile}} SELECT image_id, y, x, round(v, 6) AS v FROM ({_conv('tile', 'x')})")
def conv_h(spark, sf_dir):
    return rounded(tiles.with_core(small(spark, sf_dir, 3), "out", tiles.convolved(KERNEL, "x")))


@query(f"{{tile}} SELECT image_id, y, x, round(v, 6) AS v FROM ({_conv('tile', 'y')})")
def conv_v(spark, sf_dir):
    return rounded(tiles.with_core(small(spark, sf_dir, 3), "out", tiles.convolved(KERNEL, "y")))


@query(f"{{tile}} &hh AS ({_conv('tile', 'x')}) SELECT image_id, y, x, round(v, 6) AS v FROM ({_conv('hh', 'y')})")
def blur(spark, sf_dir):
    return rounded(tiles.with_core(small(spark, sf_dir, 3), "out", tiles.blurred(0.8)))


@query(f"{{tile}} &u AS (SELECT image_id, y, x, v / 16383::DOUBLE AS v FROM tile), hh AS ({_conv('u', 'x')}), vv AS ({_conv('hh', 'y')}) SELECT u.image_id, u.y, u.x, floor(least(greatest(u.v + (120::DOUBLE / 50) * (u.v - vv.v), 0::DOUBLE), 1::DOUBLE) * 16383::DOUBLE + 0.5::DOUBLE)::BIGINT AS v FROM u JOIN vv USING (image_id, y, x)")
def usm(spark, sf_dir):
    return counted(tiles.with_core(small(spark, sf_dir, 3), "out", tiles.sharpened(120.0, 16.0, top=16383)))


@query(
    f"{{tile}} &u AS (SELECT image_id, y, x, v / 16383::DOUBLE AS v FROM tile), hh AS ({_conv('u', 'x', kernel=near.gaussian(1.0))}), vv AS ({_conv('hh', 'y', kernel=near.gaussian(1.0))}), q AS (SELECT u.image_id, u.y, u.x, u.v AS u, u.v - vv.v AS h, least(u.v / (90::DOUBLE / 255), 1::DOUBLE) AS t FROM u JOIN vv USING (image_id, y, x)), "
    "w AS (SELECT *, h * least(greatest(abs(h) - 2::DOUBLE / 255, 0::DOUBLE) / (2::DOUBLE / 255), 1::DOUBLE) AS hn FROM q) SELECT image_id, y, x, floor(least(greatest(u + 4::DOUBLE * t * t * (3 - 2 * t) * hn, 0::DOUBLE), 1::DOUBLE) * 16383::DOUBLE + 0.5::DOUBLE)::BIGINT AS v FROM w"
)
def usm_limits(spark, sf_dir):
    return counted(tiles.with_core(whole(spark, sf_dir), "out", tiles.sharpened(200.0, 20.0, dark_limit=90.0, noise_limit=2.0, top=16383)))


@query("{tile} SELECT image_id, y // 3 AS y, x // 3 AS x, v FROM tile WHERE y % 3 = 0 AND x % 3 = 0")
def downsample(spark, sf_dir):
    return near.subsample(pixels.tiles(spark, sf_dir), 3)


@query("{tile} SELECT t.image_id, ny.range AS y, nx.range AS x, t.v FROM range(5) ny JOIN tile t ON t.y = ny.range * 8 // 5 JOIN range(5) nx ON t.x = nx.range * 8 // 5")
def resize_nearest(spark, sf_dir):
    return near.resize_nearest(pixels.tiles(spark, sf_dir), 8, 8, 5, 5)


@query("{tile} SELECT image_id, y - 1 AS y, x - 2 AS x, v FROM tile WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4")
def crop_axis(spark, sf_dir):
    return near.crop(pixels.tiles(spark, sf_dir), 2, 1, 5, 4)


TURN = (0.5 * 8, 0.45 * 8, math.cos(0.3), math.sin(0.3))


@query(
    f"{{tile}} &o AS (SELECT i.range // 5 AS oy, i.range % 5 AS ox FROM range(20) i), s0 AS (SELECT oy, ox, ox + 0.5::DOUBLE - 2.5::DOUBLE AS dx, oy + 0.5::DOUBLE - 2.0::DOUBLE AS dy FROM o), s1 AS (SELECT oy, ox, {TURN[0]!r}::DOUBLE + dx * {TURN[2]!r}::DOUBLE - dy * {TURN[3]!r}::DOUBLE - 0.5::DOUBLE AS sx, {TURN[1]!r}::DOUBLE + dx * {TURN[3]!r}::DOUBLE + dy * {TURN[2]!r}::DOUBLE - 0.5::DOUBLE AS sy FROM s0), "
    "s2 AS (SELECT oy, ox, floor(sx)::BIGINT AS x0, floor(sy)::BIGINT AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM s1 WHERE sx >= 0 AND sy >= 0 AND sx <= 7 AND sy <= 7), "
    "b AS (SELECT a.image_id, oy, ox, floor(a.v * ((1 - fx) * (1 - fy)) + b.v * (fx * (1 - fy)) + c.v * ((1 - fx) * fy) + d.v * (fx * fy) + 0.5::DOUBLE)::BIGINT AS v FROM s2 JOIN tile a ON a.x = x0 AND a.y = y0 JOIN tile b ON b.image_id = a.image_id AND b.x = least(x0 + 1, 7) AND b.y = y0 JOIN tile c ON c.image_id = a.image_id AND c.x = x0 AND c.y = least(y0 + 1, 7) JOIN tile d ON d.image_id = a.image_id AND d.x = least(x0 + 1, 7) AND d.y = least(y0 + 1, 7)) "
    "SELECT i.image_id, o.oy AS y, o.ox AS x, coalesce(b.v, 0) AS v FROM (SELECT DISTINCT image_id FROM tile) i CROSS JOIN o LEFT JOIN b USING (image_id, oy, ox)"
)
def crop_rotated(spark, sf_dir):
    return tiles.crop_rotated(small(spark, sf_dir, 1), 0.5, 0.45, 0.6, 0.5, 0.3)


REGIONS_SQL = "rg AS (SELECT page_id AS region_id, (page_id % 10) / 10::DOUBLE AS cx, (page_id % 7) / 7::DOUBLE AS cy, (page_id % 5) / 4::DOUBLE AS w, (page_id % 3) / 2::DOUBLE AS h, (page_id % 12) / 4::DOUBLE AS angle FROM pages)"


def _regions(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id AS region_id", "(page_id % 10) / 10D AS cx", "(page_id % 7) / 7D AS cy", "(page_id % 5) / 4D AS w", "(page_id % 3) / 2D AS h", "(page_id % 12) / 4D AS angle")


@query(
    f"WITH {REGIONS_SQL}, s AS (SELECT region_id, cx, cy, angle, greatest(0.01::DOUBLE, least(1::DOUBLE, w)) AS w, greatest(0.01::DOUBLE, least(1::DOUBLE, h)) AS h FROM rg), a AS (SELECT *, w / 2 * abs(cos(angle)) + h / 2 * abs(sin(angle)) AS hw, w / 2 * abs(sin(angle)) + h / 2 * abs(cos(angle)) AS hh FROM s) "
    "SELECT region_id, round(greatest(hw, least(greatest(1 - hw, hw), cx)), 9) AS cx, round(greatest(hh, least(greatest(1 - hh, hh), cy)), 9) AS cy, w, h FROM a"
)
def clamp_region(spark, sf_dir):
    r = _regions(spark, sf_dir).select("region_id", *[c.alias(k) for k, c in near.clamp_region("cx", "cy", "w", "h", "angle").items()])
    return r.withColumns({"cx": F.round("cx", 9), "cy": F.round("cy", 9)})


@query(
    f"WITH {REGIONS_SQL}, k(corner, a, b) AS (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) "
    "SELECT region_id, corner, round(cx + a * w / 2 * cos(angle) - b * h / 2 * sin(angle), 9) AS px, round(cy + a * w / 2 * sin(angle) + b * h / 2 * cos(angle), 9) AS py FROM rg, k"
)
def region_corners(spark, sf_dir):
    return near.corners(_regions(spark, sf_dir)).select("region_id", "corner", F.round("px", 9).alias("px"), F.round("py", 9).alias("py"))
