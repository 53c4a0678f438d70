"""Kernels, regions, and operators that pick pixels by their place, over rows (image_id, y, x, v).

What looks at a pixel's neighbours works on tiles (see tiles).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Width over height of the film formats.
RATIOS = {"35mm": 3 / 2, "6x4.5": 4 / 3, "6x6": 1.0, "6x7": 7 / 6, "6x9": 3 / 2, "6x12": 2.0, "6x17": 3.0, "4x5": 5 / 4}


def gaussian(sigma: float) -> list[float]:
    """A normalised kernel that reaches three sigmas, one pixel at least."""
    half = max(1, math.ceil(3 * sigma))
    raw = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-half, half + 1)]
    return [x / sum(raw) for x in raw]


def subsample(df: DataFrame, factor: int) -> DataFrame:
    """Every factor-th pixel of every factor-th row."""
    return df.filter(f"y % {factor} = 0 AND x % {factor} = 0").selectExpr("image_id", f"y div {factor} AS y", f"x div {factor} AS x", "v")


def resize_nearest(df: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Each new pixel takes the old one at its place times the ratio, rounded down."""
    spark = df.sparkSession
    axis = lambda n, old, c: F.broadcast(spark.range(n).selectExpr(f"id AS new_{c}", f"id * {old} div {n} AS {c}"))  # noqa: E731  as many rows as an image has lines
    return df.join(axis(to_width, width, "x"), "x").join(axis(to_height, height, "y"), "y").selectExpr("image_id", "new_y AS y", "new_x AS x", "v")


def crop(df: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    return df.filter(f"x BETWEEN {left} AND {left + width - 1} AND y BETWEEN {top} AND {top + height - 1}").selectExpr("image_id", f"y - {top} AS y", f"x - {left} AS x", "v")


def clamp_region(cx: str, cy: str, w: str, h: str, angle: str) -> dict[str, Column]:
    """The region's size within 0.01 to 1, and its centre so that the turned box stays in the unit square."""
    size = lambda c: f"greatest(0.01D, least(1D, {c}))"
    hw = f"({size(w)} / 2 * abs(cos({angle})) + {size(h)} / 2 * abs(sin({angle})))"
    hh = f"({size(w)} / 2 * abs(sin({angle})) + {size(h)} / 2 * abs(cos({angle})))"
    held = lambda c, half: F.expr(f"greatest({half}, least(greatest(1 - {half}, {half}), {c}))")
    return {"cx": held(cx, hw), "cy": held(cy, hh), "w": F.expr(size(w)), "h": F.expr(size(h))}


def corners(df: DataFrame) -> DataFrame:
    """The four corners (corner, px, py) of each region (cx, cy, w, h, angle)."""
    signs = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    one = lambda i, a, b: f"struct({i} AS corner, cx + {a} * w / 2 * cos(angle) - {b} * h / 2 * sin(angle) AS px, cy + {a} * w / 2 * sin(angle) + {b} * h / 2 * cos(angle) AS py)"
    return df.selectExpr("*", "inline(array(" + ", ".join(one(i, a, b) for i, (a, b) in enumerate(signs)) + "))")
