"""Pixel relations from the star-schema tables: tiles of embeddings, a mosaic of them, colour tiles, labelled figures.

All are narrow maps over Parquet columns (a figure is generated from its key), keyed by image_id; arithmetic is integral.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE, PER_ROW, FIGURE = 8, 20, 48

#: Figures a partition: about half a million pixels.
FIGURES = 250


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v").cast("double") + 0.5) * 256))).cast("int")
    tiles = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    return tiles.select("vec_id", F.expr("cast(p div 8 as int)").alias("py"), (F.col("p") % TILE).cast("int").alias("px"), q.alias("q"))


class TilePixels:
    """pixels_of(tile): a row (y, x, q) for each element of an 8 x 8 tile of values around 0; nothing for a null tile."""

    def eval(self, tile: list[float] | None):
        for p, v in enumerate(tile or ()):
            if v is not None:
                yield p // TILE, p % TILE, max(0, min(255, int((v + 0.5) * 256 // 1)))


def register(spark: SparkSession) -> None:
    """The table function pixels_of for SQL: SELECT vec_id, t.* FROM embeddings, LATERAL pixels_of(embedding) t."""
    spark.udtf.register("pixels_of", F.udtf(TilePixels, returnType="y int, x int, q int"))


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, q): one grey 8 x 8 tile a vector."""
    return _tiles(spark, sf_dir).select(F.col("vec_id").alias("image_id"), F.col("py").alias("y"), F.col("px").alias("x"), "q")


def mx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, q): all tiles in one mosaic image of twenty tiles a row."""
    y = F.expr(f"cast(vec_id div {PER_ROW} as int)") * TILE + F.col("py")
    x = (F.col("vec_id") % PER_ROW).cast("int") * TILE + F.col("px")
    return _tiles(spark, sf_dir).select(F.lit(0).cast("long").alias("image_id"), y.alias("y"), x.alias("x"), "q")


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, r, g, b): three neighbouring vectors are the channels of one tile; an incomplete tile is left out."""
    tiles = _tiles(spark, sf_dir).withColumn("image_id", F.expr("vec_id div 3")).withColumn("c", F.col("vec_id") % 3)
    wide = tiles.groupBy("image_id", F.col("py").alias("y"), F.col("px").alias("x")).agg(*(F.max(F.when(F.col("c") == i, F.col("q"))).alias(n) for i, n in enumerate("rgb")), F.count("*").alias("n"))
    return wide.where("n = 3").drop("n")


def _dealt(keys: DataFrame) -> DataFrame:
    """Keys dealt by image_id before they grow into pixels, so that a small file becomes many tasks and an image stays in one."""
    least = keys.sparkSession.sparkContext.defaultParallelism
    return keys.repartition(max(least, -(-keys.count() // FIGURES)), "image_id")


def fig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, label, r, g, b): a figure of known regions for each supplier; aggregations and joins by image need no shuffle."""
    side = F.sequence(F.lit(0).cast("long"), F.lit(FIGURE - 1).cast("long"))
    keys = _dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("image_id")))
    grid = keys.withColumn("y", F.explode(side)).withColumn("x", F.explode(side))
    return grid.selectExpr(
        "image_id", "y", "x", "image_id % 8 AS k",
        "cast(case when x between 30 and 45 and y between 30 and 45 then 3 when abs(x + y - 47) <= 1 then 2 "
        "when (x - 16) * (x - 16) + (y - 16) * (y - 16) <= (10 + image_id % 8) * (10 + image_id % 8) then 1 else 0 end as int) AS label",
    ).selectExpr(
        "image_id", "y", "x", "label",
        "case label when 0 then 250L when 1 then 226L when 2 then 32L else 18 + 22 * (x - 30) div 15 end AS r",
        "case label when 0 then 249L when 1 then 92L when 2 then 32L else 58 + 132 * (x - 30) div 15 end AS g",
        "case label when 0 then 246L when 1 then 28 + 8 * k when 2 then 40L else 200 + 20 * (x - 30) div 15 end AS b",
    )


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, seq, x, y): a closed ring of sixteen points around each figure, in whole numbers."""
    points = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("seq"))
    # a walk around a square of side 4 * step with a dent in every third corner, so that corners and straights occur
    return points.selectExpr(
        "image_id", "seq",
        "cast(case when seq < 4 then seq when seq < 8 then 4 when seq < 12 then 12 - seq else 0 end * (3 + image_id % 5) + seq % 3 as double) AS x",
        "cast(case when seq < 4 then 0 when seq < 8 then seq - 4 when seq < 12 then 4 else 16 - seq end * (3 + image_id % 7) + seq % 2 as double) AS y",
    )
