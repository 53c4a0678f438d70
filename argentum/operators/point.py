"""Operators that map a pixel to a pixel. Each is an expression over the channels; none of them shuffles.

Lookup tables are tabulated on the driver in 32-bit floats and joined as a broadcast relation: a table has
65 536 rows, whatever the images' size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RGB = ("r", "g", "b")
TOP = 65535


def widen(column: str) -> str:
    """8 to 16 bits: v * 257."""
    return f"{column} * 257"


def narrow(column: str) -> str:
    """16 to 8 bits: the high byte."""
    return f"shiftright({column}, 8)"


#: Four kinds of grey: 14-bit integer luma, rounded luma, truncated luma, and the integer mean.
GREYS = {
    "luma_int": "shiftleft((299 * shiftright(r, 2) + 587 * shiftright(g, 2) + 114 * shiftright(b, 2)) div 1000, 2)",
    "luma_round": "CAST(floor(0.299D * r + 0.587D * g + 0.114D * b + 0.5D) AS BIGINT)",
    "luma_trunc": "CAST(floor(0.299D * r + 0.587D * g + 0.114D * b) AS BIGINT)",
    "mean": "(r + g + b) div 3",
}


def desaturate(df: DataFrame, kind: str = "luma_int") -> DataFrame:
    """Sets all channels to one of GREYS."""
    grey = df.withColumn("_grey", F.expr(GREYS[kind]))
    return grey.withColumns({c: F.col("_grey") for c in RGB}).drop("_grey")


def invert_negative(df: DataFrame, highlights: tuple[int, int, int], grey: bool = False) -> DataFrame:
    """What a negative's highlights leave of each channel, stretched to 16 bits and truncated.

    highlights are 14-bit. grey: the channels then become their luma. Films that aren't negatives need no call.
    """
    out = df.withColumns({f"_{c}": F.expr(f"greatest(CAST({4 * h} AS FLOAT) - CAST({c} AS FLOAT), CAST(0 AS FLOAT)) * ({f'CAST(65535 / {4 * h} AS FLOAT)' if h > 0 else 'CAST(1 AS FLOAT)'})") for c, h in zip(RGB, highlights, strict=True)})
    out = out.withColumns({f"_{c}": F.expr(f"CAST(_{c} AS FLOAT)") for c in RGB})
    if grey:
        luma = F.expr("CAST(0.299 AS FLOAT) * _r + CAST(0.587 AS FLOAT) * _g + CAST(0.114 AS FLOAT) * _b")
        out = out.withColumns({f"_{c}": luma for c in RGB})
    return out.withColumns({c: F.expr(f"CAST(greatest(least(_{c}, CAST(65535 AS FLOAT)), CAST(0 AS FLOAT)) AS BIGINT)") for c in RGB}).drop("_r", "_g", "_b")


def affine(df: DataFrame, gains: tuple[float, float, float], offsets: tuple[float, float, float]) -> DataFrame:
    """v * gain + offset * 257 for each channel, held within 16 bits and truncated. Offsets are in 8-bit units."""
    return df.withColumns({c: F.expr(f"CAST(floor(greatest(0D, least(65535D, {c} * {g!r}D + {o!r}D * 257D))) AS BIGINT)") for c, g, o in zip(RGB, gains, offsets, strict=True)})


def affine_32(df: DataFrame, gains: tuple[float, float, float], offsets: tuple[float, float, float]) -> DataFrame:
    """affine() in 32-bit floats."""
    one = lambda c, g, o: F.expr(f"CAST(greatest(CAST(0 AS FLOAT), least(CAST(65535 AS FLOAT), CAST({c} AS FLOAT) * CAST({g!r} AS FLOAT) + CAST({o!r} AS FLOAT) * CAST(257 AS FLOAT))) AS BIGINT)")
    return df.withColumns({c: one(c, g, o) for c, g, o in zip(RGB, gains, offsets, strict=True)})


# Gains and 8-bit offsets for colour negatives, with and without an input profile.
NEGATIVE_CALIBRATION = {True: ((1.06, 1.04, 0.97), (-17.54, -13.26, 17.28)), False: ((1.01, 1.05, 0.96), (-3.07, -16.64, 8.66))}


def calibrate_negative(df: DataFrame, film_type: int, profile: str | None) -> DataFrame:
    """The affine calibration of colour negatives (film type 1); other films stay as they are."""
    return affine_32(df, *NEGATIVE_CALIBRATION[bool((profile or "").strip())]) if film_type == 1 else df


def gains(df: DataFrame, factors: tuple[float, float, float]) -> DataFrame:
    """v * factor for each channel, rounded and held within 16 bits."""
    return df.withColumns({c: F.expr(f"CAST(greatest(0D, least(65535D, floor({c} * {f!r}D + 0.5D))) AS BIGINT)") for c, f in zip(RGB, factors, strict=True)})


def matrix(df: DataFrame, m: list[list[float]]) -> DataFrame:
    """A 3 x 3 matrix over the channels, each held within 16 bits and truncated."""
    rows = {c: " + ".join(f"{w!r}D * {x}" for w, x in zip(row, RGB, strict=True)) for c, row in zip(RGB, m, strict=True)}
    return df.withColumns({c: F.expr(f"CAST(floor(greatest(0D, least(65535D, {e}))) AS BIGINT)") for c, e in rows.items()})


def saturate(df: DataFrame, percent: float) -> DataFrame:
    """Moves the channels away from their luma (BT.709), held within 16 bits and truncated."""
    if abs(percent / 100) <= 0.001:
        return df
    grey = df.withColumn("_grey", F.expr("0.2126D * r + 0.7152D * g + 0.0722D * b"))
    return grey.withColumns({c: F.expr(f"CAST(floor(greatest(0D, least(65535D, _grey + ({c} - _grey) * {1 + percent / 100!r}D))) AS BIGINT)") for c in RGB}).drop("_grey")


@dataclass(frozen=True)
class Display:
    """Display adjustments. Zero (midtone: 1) leaves a step out."""

    out_low: tuple[float, float, float] = (0.0, 0.0, 0.0)
    out_high: tuple[float, float, float] = (255.0, 255.0, 255.0)
    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)
    exposure: float = 0.0
    temperature: float = 0.0
    tint: float = 0.0
    shadows: float = 0.0
    highlights: float = 0.0
    contrast: float = 0.0
    brightness: float = 0.0
    depth: float = 0.0
    midtone: float = 1.0
    saturation: float = 0.0
    matrix: tuple | None = None
    contrast_gain: float = 2.0


def _power(v, e) -> np.ndarray:
    """A power of 32-bit numbers, worked out in 64 bits and rounded: the same in every engine."""
    return np.power(np.asarray(v).astype(np.float64), np.float64(e)).astype(np.float32)


def display_tables(p: Display) -> np.ndarray:
    """Three tables of 65 536 values: output range, shift, exposure, temperature, tone steps; truncated 32-bit floats."""
    f = np.float32
    unit = lambda v: np.clip(v, f(0), f(1))
    warm, tint = f(p.temperature) / f(100), f(p.tint) / f(100)
    moved = abs(p.temperature) > 0.1 or abs(p.tint) > 0.1
    factors = [f(1) + warm * f(0.15), f(1) - tint * f(0.15), f(1) - warm * f(0.15)] if moved else [f(1)] * 3
    tables = []
    for c in range(3):
        low, high = f(p.out_low[c]) / f(255), f(p.out_high[c]) / f(255)
        v = low + np.arange(TOP + 1, dtype=f) / f(TOP) * max(high - low, f(0.001))
        v = unit((v + f(p.shift[c]) / f(255)) * f(_power(f(2), f(p.exposure))) * factors[c])
        if abs(p.shadows) > 0.1:
            v = unit(v + f(p.shadows) / f(100) * (f(1) - v) * (f(1) - v) * f(0.5))
        if abs(p.highlights) > 0.1:
            v = unit(v + f(p.highlights) / f(100) * v * v * f(0.5))
        if abs(p.contrast) > 0.1:
            x = f(p.contrast) / f(100)
            v = unit((v - f(0.5)) * (f(1) + x * f(p.contrast_gain) if x >= 0 else f(1) + x) + f(0.5))
        if abs(p.brightness) > 0.1:
            v = unit(v + f(p.brightness) / f(100) * f(0.5))
        if abs(p.depth) > 0.1:
            v = unit(_power(v, f(1) / max(f(1) + f(p.depth) / f(100), f(0.1))))
        if abs(p.midtone - 1) > 0.01:
            v = unit(_power(v, f(1) / np.clip(f(p.midtone), f(0.1), f(10))))
        tables.append((v * f(TOP)).astype(np.int64))
    return np.array(tables)


def level_tables(black, white, gamma, master_gamma: float = 1.0, film: np.ndarray | None = None) -> np.ndarray:
    """Three tables: normalise between black and white (0 to 255), a film curve of 65 536 entries, two gammas; truncated."""
    f = np.float32
    tables = []
    for c in range(3):
        low, high = f(black[c]) / f(255), f(white[c]) / f(255)
        v = np.clip((np.arange(TOP + 1, dtype=f) / f(TOP) - low) / max(high - low, f(0.001)), f(0), f(1))
        if film is not None:
            at = v * f(TOP)
            i = np.minimum(at.astype(np.int64), TOP - 1)
            part = at - i.astype(f)
            v = film[c].astype(f)[i] * (f(1) - part) + film[c].astype(f)[i + 1] * part
        for g in (gamma[c], master_gamma):
            v = _power(v, f(1) / np.clip(f(g), f(0.01), f(99)))
        tables.append((np.clip(v, f(0), f(1)) * f(TOP)).astype(np.int64))
    return np.array(tables)


def table_frame(spark: SparkSession, tables: np.ndarray) -> DataFrame:
    """(k, t_r, t_g, t_b): a relation of 65 536 rows."""
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"k": np.arange(tables.shape[1]), "t_r": tables[0], "t_g": tables[1], "t_b": tables[2]}))


def look_up(df: DataFrame, tables: np.ndarray, columns: tuple[str, str, str] = RGB) -> DataFrame:
    """Replaces each channel by its table's value: three broadcast hash joins with one relation of fixed size."""
    relation = table_frame(df.sparkSession, tables)
    for c, t in zip(columns, ("t_r", "t_g", "t_b"), strict=True):
        one = F.broadcast(relation.select(F.col("k").alias("_k"), F.col(t).alias("_t")))
        df = df.join(one, F.col(c) == F.col("_k")).withColumn(c, F.col("_t")).drop("_k", "_t")
    return df


def display(df: DataFrame, p: Display) -> DataFrame:
    """The display adjustments in their order: tables, matrix, saturation. A neutral step isn't part of the plan."""
    if p != Display(matrix=p.matrix, saturation=p.saturation):
        df = look_up(df, display_tables(p))
    if p.matrix is not None:
        df = matrix(df, [list(row) for row in p.matrix])
    return saturate(df, p.saturation)


def invert_table(table: np.ndarray) -> np.ndarray:
    """For each output of a 256-entry table the input that comes nearest; of equals the smallest."""
    return np.abs(table[None, :].astype(np.int64) - np.arange(256)[:, None]).argmin(axis=1)


def bezier_table(control: list[tuple[float, float]]) -> np.ndarray:
    """256 entries of the Bezier curve of all control points; two are a straight line, fewer the identity.

    Points are sorted by x; those within 0.5 of the last kept one go. The curve is sampled at 1024
    parameters and read by linear interpolation, flat beyond its ends.
    """
    kept: list[tuple[float, float]] = []
    for x, y in sorted(control, key=lambda p: p[0]):
        if not kept or abs(x - kept[-1][0]) >= 0.5:
            kept.append((float(x), float(y)))
    if len(kept) < 2:
        return np.arange(256)
    xs, ys = np.array(kept).T
    if len(kept) > 2:
        t = np.linspace(0.0, 1.0, 1024)
        px, py = [np.repeat(v[:, None], len(t), axis=1) for v in (xs, ys)]
        while len(px) > 1:
            px, py = (1 - t) * px[:-1] + t * px[1:], (1 - t) * py[:-1] + t * py[1:]
        xs, ys = px[0], py[0]
    return np.clip(np.floor(np.interp(np.arange(256), xs, ys) + 0.5), 0, 255).astype(np.int64)


def is_straight(curve: list[tuple[float, float]]) -> bool:
    """Is a curve the two points (0, 0) and (255, 255)?"""
    return len(curve) == 2 and tuple(curve[0][:2]) == (0, 0) and tuple(curve[1][:2]) == (255, 255)


def curve_tables(curves: list[list[tuple[float, float]]]) -> np.ndarray | None:
    """16-bit tables of seven curves: master; red, green, blue; cyan, magenta, yellow. None if they change nothing.

    A channel goes through its own curve, then its complement through that of its complementary colour, then through
    the master. Under seven curves nothing is changed.
    """
    if len(curves) < 7 or all(map(is_straight, curves)):
        return None
    wide = lambda t: np.floor(np.interp(np.arange(TOP + 1) / 257.0, np.arange(256), t) * 257.0 + 0.5).astype(np.int64)
    master, *others = [wide(bezier_table([p[:2] for p in c])) for c in curves[:7]]
    return np.array([master[TOP - others[3 + c][TOP - others[c]]] for c in range(3)])


def gradation(df: DataFrame, curves: list[list[tuple[float, float]]]) -> DataFrame:
    tables = curve_tables(curves)
    return df if tables is None else look_up(df, tables)
