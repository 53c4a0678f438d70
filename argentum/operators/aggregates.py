"""Histograms, exact percentiles, error metrics and fits.

Percentiles are exact and never gather values: counts by value come first (65 536 values at most for a
group), and only these are summed up in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BAND_LOW, BAND_HIGH = 13107, 52428


def histogram(long: DataFrame, by: list[str], bin_: Column, bins: int) -> DataFrame:
    """(by, bin, n) with a row for each of the bins, also the empty ones."""
    counts = long.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))
    groups = counts.select(*by).distinct()
    every = groups.select(*by, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    return every.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def composite(hist: DataFrame) -> DataFrame:
    """The histogram's channels and a fourth, 'max': the largest count of each bin."""
    return hist.unionByName(hist.groupBy("bin").agg(F.max("n").alias("n")).withColumn("ch", F.lit("max")))


def negative_bin(v: str, highlight: int) -> Column:
    """The bin, 0 to 255, of a negative's value below its 14-bit highlight."""
    hi = 4 * highlight
    return F.expr(f"least(255, CASE WHEN {v} >= {hi} THEN 0 ELSE ({hi} - {v}) * 255 div {max(hi, 1)} END)")


def bit_depth(top: str) -> Column:
    return F.expr(f"CASE WHEN {top} <= 4095 THEN 12 WHEN {top} <= 16383 THEN 14 ELSE 16 END")


def nearest_rank(counts: DataFrame, by: list[str], value: str, percents: dict[str, float], floor: bool = False) -> DataFrame:
    """(by, one column for each percent): the smallest value up to which ceil(n * percent / 100) rows lie.

    counts has (by, value, n). floor: floor instead of ceil.
    """
    order, whole = W.partitionBy(*by).orderBy(value), W.partitionBy(*by)
    up = counts.withColumns({"_up": F.sum("n").over(order), "_all": F.sum("n").over(whole)})
    at = {k: (F.floor if floor else F.ceil)(F.col("_all") * p / 100.0) for k, p in percents.items()}
    return up.groupBy(*by).agg(*[F.min(F.when(F.col("_up") >= t, F.col(value))).alias(k) for k, t in at.items()])


def clip_levels(hist: DataFrame, by: list[str], bins: int, black_percent: float, white_percent: float) -> DataFrame:
    """(by, low, high): where the given percents of the counts lie below and above, in 0 to 255; high at least low + 0.1."""
    up = W.partitionBy(*by).orderBy("bin")
    down = W.partitionBy(*by).orderBy(F.col("bin").desc())
    h = hist.withColumns({"_up": F.sum("n").over(up), "_down": F.sum("n").over(down), "_all": F.sum("n").over(W.partitionBy(*by))})
    at = lambda percent: F.greatest(F.floor(F.col("_all") * percent / 100.0), F.lit(1))
    scale = 255.0 / (bins - 1)
    h = h.groupBy(*by).agg((F.min(F.when(F.col("_up") >= at(black_percent), F.col("bin"))) * scale).alias("low"), (F.max(F.when(F.col("_down") >= at(white_percent), F.col("bin"))) * scale).alias("_high"))
    return h.select(*by, F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce(F.greatest(F.col("_high"), F.col("low") + 0.1), F.lit(255.0)).alias("high"))


def grade(mae: str, p99: str) -> Column:
    return F.expr(f"CASE WHEN {mae} <= 100 AND {p99} <= 500 THEN 'STRICT' WHEN {mae} <= 400 AND {p99} <= 2000 THEN 'PASS' WHEN {mae} <= 1280 AND {p99} <= 5000 THEN 'WARN' ELSE 'FAIL' END")


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.nullif(den, F.lit(0)))


def error_stats(long: DataFrame, by: list[str]) -> DataFrame:
    """Error metrics of v against ref for each group of by, and for all rows where by is empty.

    One pass counts (by, signed difference, band, 8-bit difference); everything follows from these counts.
    """
    d = long.select(*by, (F.col("v") - F.col("ref")).alias("s"), F.when(F.col("ref") < BAND_LOW, "low").when(F.col("ref") >= BAND_HIGH, "high").otherwise("mid").alias("band"), F.abs(F.shiftright("v", 8) - F.shiftright("ref", 8)).alias("d8"))
    return error_stats_of(d.groupBy(*by, "s", "band", "d8").agg(F.count("*").alias("n")), by)


def error_stats_of(counts: DataFrame, by: list[str]) -> DataFrame:
    """error_stats() from counts n of (by, signed difference s, band of the reference, 8-bit difference d8)."""
    d = counts.groupBy(*by, "s", "band", "d8").agg(F.sum("n").alias("n")).withColumn("d", F.abs("s"))
    of = lambda band: safe_ratio(F.sum(F.when(F.col("band") == band, F.col("d") * F.col("n")).otherwise(0)), F.sum(F.when(F.col("band") == band, F.col("n")).otherwise(0)))
    total = F.sum("n")
    out = d.groupBy(*by).agg(
        total.alias("n"),
        (F.sum(F.col("d") * F.col("n")) / total).alias("mae_16"),
        (F.sum(F.col("s") * F.col("n")) / total).alias("mean_signed"),
        F.max("d").alias("max_16"),
        of("low").alias("mae_shadow"),
        of("mid").alias("mae_mid"),
        of("high").alias("mae_high"),
        (F.sum(F.col("d8") * F.col("n")) / total).alias("mae_8"),
        (F.sum(F.col("d8") * F.col("d8") * F.col("n")) / total).alias("_mse"),
    )
    counts = d.groupBy(*by, "d").agg(F.sum("n").alias("n"))
    ranks = nearest_rank(counts, by, "d", {"p50_16": 50.0, "p95_16": 95.0, "p99_16": 99.0, "p999_16": 99.9})
    out = out.join(ranks, by) if by else out.crossJoin(F.broadcast(ranks))  # one row each
    psnr = F.when(F.col("_mse") > 0, 10.0 * F.log10(F.lit(65025.0) / F.nullif(F.col("_mse"), F.lit(0.0)))).otherwise(F.lit(float("inf")))
    return out.withColumns({"psnr_8": psnr, "p99_8": F.least(F.shiftright("p99_16", 8), F.lit(255)), "grade": grade("mae_16", "p99_16")}).drop("_mse")


def affine_fit(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, gain, offset): the least-squares line from v to ref; where v doesn't vary gain is 1 and offset the mean difference."""
    fit = long.groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.sum("v").cast("double").alias("sx"), F.sum("ref").cast("double").alias("sy"), F.sum(F.col("v") * F.col("v")).cast("double").alias("sxx"), F.sum(F.col("v") * F.col("ref")).cast("double").alias("sxy"))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    fit = fit.withColumn("gain", F.when(det == 0, F.lit(1.0)).otherwise((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(det, F.lit(0.0))))
    return fit.select(*by, "gain", ((F.col("sy") - F.col("gain") * F.col("sx")) / F.col("n")).alias("offset"))


def region_grid(df: DataFrame, width: int, height: int, parts: int = 3) -> DataFrame:
    """(gy, gx): the part of a parts x parts grid in which a pixel (y, x) lies; the last row and column take the rest."""
    at = lambda c, size: F.least(F.expr(f"{c} div {max(size // parts, 1)}"), F.lit(parts - 1)).cast("bigint")
    return df.withColumns({"gy": at("y", height), "gx": at("x", width)})


def worst(df: DataFrame, n: int, order: list[str], place: list[str]) -> DataFrame:
    """The n rows with the largest difference in any channel (d_max), in rising order of (d_max, place).

    It is what a scan in the order of `order` keeps of n: a row enters a full list only with a larger difference than
    the list's smallest, and the smallest (d_max, place) leaves. Of the rows at the n-th largest difference t, these
    are some of the first n rows with t or more, and of them the last ones by place. Three scans, each kept to n rows.
    """
    if n <= 0:
        return df.withColumn("d_max", F.lit(0).cast("bigint")).limit(0)
    d = df.withColumn("d_max", F.greatest(*[F.abs(F.col(c) - F.col(f"{c}_ref")) for c in "rgb"]))
    t = d.select("d_max").orderBy(F.desc("d_max")).limit(n).agg(F.min("d_max").alias("_t"))
    d = d.join(F.broadcast(t), F.lit(True)).filter("d_max >= _t")  # one row
    over = d.filter("d_max > _t").withColumn("_tie", F.lit(False))
    ties = d.orderBy(*order).limit(n).filter("d_max = _t").withColumn("_tie", F.lit(True))
    return over.unionByName(ties).orderBy("_tie", *[F.desc(c) for c in place]).limit(n).drop("_tie", "_t").orderBy("d_max", *place)


def border_samples(df: DataFrame, width: int, height: int, stride: int = 8, part: int = 50, least: int = 8) -> DataFrame:
    """Every stride-th pixel of every stride-th row that lies within the border: a part of the shorter side, or least pixels."""
    border = max(min(width, height) // part, least)
    inner = f"x < {border} OR x >= {max(width - border, 0)} OR y < {border} OR y >= {max(height - border, 0)}"
    return df.filter(f"x % {stride} = 0 AND y % {stride} = 0 AND ({inner})")


def rounded_rank(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """(by, value): the value at index round((n - 1) * share), from 0, of each group's sorted ones; counts by value come first."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    n = n.withColumns({"_up": F.sum("_n").over(W.partitionBy(*by).orderBy(value)), "_all": F.sum("_n").over(W.partitionBy(*by))})
    return n.filter(F.col("_up") > F.floor((F.col("_all") - 1) * share + 0.5)).groupBy(*by).agg(F.min(value).alias(value))


def fitted_error(long: DataFrame, fit: DataFrame, by: list[str], top: float) -> DataFrame:
    """(by, gain, offset, mae): the mean error of the fitted line, held within 0 to top. Counted by (v, ref) first."""
    n = long.groupBy(*by, "v", "ref").agg(F.count("*").alias("_n")).join(F.broadcast(fit), by)  # one row a group
    held = F.greatest(F.lit(0.0), F.least(F.lit(top), F.col("gain") * F.col("v") + F.col("offset")))
    return n.groupBy(*by).agg(F.first("gain").alias("gain"), F.first("offset").alias("offset"), (F.sum(F.abs(held - F.col("ref")) * F.col("_n")) / F.sum("_n")).alias("mae"))


def errors_8(long: DataFrame, by: list[str]) -> DataFrame:
    """Of 8-bit differences: mae, top, psnr (infinite without one), n, and how many are over 5 and over 10."""
    d = long.select(*by, F.abs(F.shiftright("v", 8) - F.shiftright("ref", 8)).alias("d"))
    d = d.groupBy(*by).agg(F.avg("d").alias("mae"), F.max("d").alias("top"), F.avg(F.col("d") * F.col("d")).alias("_mse"), F.count("*").alias("n"), F.count_if(F.col("d") > 5).alias("over_5"), F.count_if(F.col("d") > 10).alias("over_10"))
    psnr = F.when(F.col("_mse") > 0, 10.0 * F.log10(F.lit(65025.0) / F.nullif(F.col("_mse"), F.lit(0.0)))).otherwise(F.lit(float("inf")))
    return d.withColumn("psnr", psnr).drop("_mse")


def bias(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, mae, bias): mean absolute and mean signed difference of v to ref over the places that both images have."""
    d = F.col("v") - F.col("ref")
    return pairs.groupBy(*by).agg(F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"))


def region_errors(df: DataFrame, width: int, height: int, by: list[str], parts: int = 3) -> DataFrame:
    """(by, gy, gx, mae, mean, ref_mean, n) of the pixels' mean channel, v against ref, in each part of a grid."""
    return region_grid(df, width, height, parts).groupBy(*by, "gy", "gx").agg((F.sum(F.abs(F.col("v") - F.col("ref"))) / F.count("*")).alias("mae"), (F.sum("v") / F.count("*")).alias("mean"), (F.sum("ref") / F.count("*")).alias("ref_mean"), F.count("*").alias("n"))


def colour_errors(df: DataFrame) -> DataFrame:
    """Of chart pixels (colour, quadrant, r, g, b and references): colour, group, rms (mean over quadrants), group_rms.

    A quadrant's error is the root mean square of its three mean channel differences; groups are greys and the six hues.
    """
    means = df.groupBy("colour", "quadrant").agg(*[F.avg(F.col(c) - F.col(f"{c}_ref")).alias(c) for c in "rgb"])
    rms = F.sqrt((F.col("r") * F.col("r") + F.col("g") * F.col("g") + F.col("b") * F.col("b")) / 3.0)
    one = means.groupBy("colour").agg(F.avg(rms).alias("rms")).withColumn("group", F.when(F.col("colour") < 16, F.lit("Gray")).otherwise(F.get(F.array(*map(F.lit, "RGBYCM")), F.floor((F.col("colour") - 16) / 8).cast("int"))))
    return one.withColumn("group_rms", F.avg("rms").over(W.partitionBy("group")))  # 64 colours at most
