"""Scans along an ordered axis, such as a histogram's bins. Windows are over (group, bins), which are few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cumulative(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(W.partitionBy(*by).orderBy(order)))


def monotone(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """The running maximum."""
    return df.withColumn(name, F.max(value).over(W.partitionBy(*by).orderBy(order)))


def fill_gaps(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Nulls of value become points of the line between the nearest known values; ends are flat; without any, 0."""
    w = W.partitionBy(*by).orderBy(order)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("x"), F.col(value).alias("y")))
    df = df.withColumns({"_l": F.last(known, True).over(back), "_r": F.first(known, True).over(ahead)})
    part = (F.col(order) - F.col("_l.x")) / F.nullif(F.col("_r.x") - F.col("_l.x"), F.lit(0))
    line = F.col("_l.y") * (1.0 - part) + F.col("_r.y") * part
    filled = F.coalesce(F.col(value), F.when(F.col("_l").isNull(), F.col("_r.y")).when(F.col("_r").isNull(), F.col("_l.y")).otherwise(line), F.lit(0.0))
    return df.withColumn(name, filled).drop("_l", "_r")


def resample(df: DataFrame, by: list[str], order: str, value: str, bins: int, size: int) -> DataFrame:
    """(by, i, value): `bins` values read at `size` evenly spaced places by linear interpolation."""
    nxt = F.lead(value).over(W.partitionBy(*by).orderBy(order))
    segments = df.withColumn("_next", nxt).filter(F.col(order) < bins - 1)
    # Bin k serves the places i with k <= i * (bins - 1) / (size - 1) < k + 1; the last one also its end.
    first = F.ceil(F.col(order) * float(size - 1) / (bins - 1))
    last = F.when(F.col(order) == bins - 2, F.lit(size - 1)).otherwise(F.ceil((F.col(order) + 1) * float(size - 1) / (bins - 1)) - 1)
    out = segments.select(*by, order, value, "_next", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("i"))
    part = F.col("i") * float(bins - 1) / (size - 1) - F.col(order)
    return out.select(*by, "i", (F.col(value) * (1.0 - part) + F.col("_next") * part).alias(value))


def peaks(hist: DataFrame, by: list[str], ratio: float, bins: int = 256) -> DataFrame:
    """The inner bins that reach ratio of the largest count and are the maximum of their five bins.

    A flat top needs a smaller count two bins before it, or one bin after it, to be a peak.
    """
    w = W.partitionBy(*by).orderBy("bin")
    h = hist.withColumns({"_top": F.max("n").over(W.partitionBy(*by)), "_five": F.max("n").over(w.rowsBetween(-2, 2)), "_b2": F.lag("n", 2).over(w), "_a1": F.lead("n", 1).over(w)})
    rises = (F.col("bin") < 2) | (F.col("n") > F.col("_b2")) | (F.col("n") > F.col("_a1"))
    return h.filter((F.col("bin") >= 1) & (F.col("bin") <= bins - 2) & (F.col("n") >= F.floor(F.col("_top") * ratio)) & (F.col("n") == F.col("_five")) & rises).select(*by, "bin", "n")


def valleys(hist: DataFrame, tops: DataFrame, by: list[str]) -> DataFrame:
    """The smallest bin strictly between each two peaks that follow each other; of equals the first."""
    between = tops.withColumn("_next", F.lead("bin").over(W.partitionBy(*by).orderBy("bin"))).filter(F.col("_next") > F.col("bin") + 1)
    inside = between.select(*by, F.col("bin").alias("peak"), F.explode(F.sequence(F.col("bin") + 1, F.col("_next") - 1)).alias("bin"))
    found = inside.join(hist, [*by, "bin"]).groupBy(*by, "peak").agg(F.min(F.struct("n", "bin")).alias("m"))
    return found.select(*by, "peak", F.col("m.bin").alias("bin"), F.col("m.n").alias("n"))
