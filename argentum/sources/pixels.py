"""Pixel relations made from the star-schema tables.

`points` has one row for each pixel of a flat image, with the same pixel of a reference image beside it;
`tiles` has small square images, for operators that look at a pixel's neighbours. Both read only the
columns that they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["k_order", "k_line", "k_part", "image_id", "k_price"]
SIDE = 8


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEY, r, g, b (0 to 65535) and r_ref, g_ref, b_ref."""
    px = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey AS k_order",
        "CAST(l_linenumber AS BIGINT) AS k_line",
        "l_partkey AS k_part",
        "l_suppkey AS image_id",
        "l_extendedprice AS k_price",
        "(l_partkey * 7919 + l_linenumber * 104729) % 65536 AS r",
        "(l_orderkey * 31337 + l_suppkey * 271) % 65536 AS g",
        "CAST(l_quantity AS BIGINT) * 1310 AS b",
    )
    return px.withColumns({f"{c}_ref": F.expr(f"least(65535, {c} + k_order % 257)") for c in "rgb"})


#: The same relation in DuckDB's SQL.
POINTS_SQL = (
    "px AS (SELECT *, least(65535, r + k_order % 257) AS r_ref, least(65535, g + k_order % 257) AS g_ref, least(65535, b + k_order % 257) AS b_ref FROM ("
    "SELECT l_orderkey AS k_order, l_linenumber::BIGINT AS k_line, l_partkey AS k_part, l_suppkey AS image_id, l_extendedprice AS k_price, "
    "(l_partkey * 7919 + l_linenumber * 104729) % 65536 AS r, (l_orderkey * 31337 + l_suppkey * 271) % 65536 AS g, trunc(l_quantity)::BIGINT * 1310 AS b FROM lineitem))"
)
LONG_SQL = "long AS (SELECT image_id, 'R' AS ch, r AS v, r_ref AS ref FROM px UNION ALL SELECT image_id, 'G', g, g_ref FROM px UNION ALL SELECT image_id, 'B', b, b_ref FROM px)"


def long(px: DataFrame) -> DataFrame:
    """(image_id, ch, v, ref): one row for each pixel and channel."""
    return px.selectExpr("image_id", "stack(3, 'R', r, r_ref, 'G', g, g_ref, 'B', b, b_ref) AS (ch, v, ref)")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, v): 8 x 8 images of 14-bit values."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "e"))
    return e.selectExpr("image_id", f"pos div {SIDE} AS y", f"CAST(pos % {SIDE} AS BIGINT) AS x", "CAST(floor((CAST(e AS DOUBLE) + 1) * 8191.5) AS BIGINT) AS v")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, height, width, px): the images of tiles(), one row each with the values by rows."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "embedding")
    px = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 8191.5).cast("double"))
    return e.select("image_id", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.slice(px, 1, SIDE * SIDE).alias("px"))


TILES_SQL = (
    "tile AS (SELECT vec_id AS image_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, floor((embedding[i]::DOUBLE + 1) * 8191.5::DOUBLE)::BIGINT AS v "
    "FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"
)
