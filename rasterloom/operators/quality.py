"""Fidelity: PSNR, mean absolute error, error away from edges, smoothness, residual activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.regions import CHANNELS, KEY


def psnr(predicted: DataFrame, top: float = 1.0) -> DataFrame:
    """(image_id, psnr, mae) of observed against predicted channels on the 0..255 scale; 99 without any error."""
    k = 255.0 / top
    diffs = [(F.col(c) - F.col(f"p_{c}")) * k for c in CHANNELS]
    mse = F.avg(sum((d * d for d in diffs), F.lit(0.0)) / 3)
    mae = F.avg(sum((F.abs(d) for d in diffs), F.lit(0.0)) / 3)
    found = predicted.groupBy("image_id").agg(mse.alias("mse"), mae.alias("mae"))
    return found.select("image_id", F.when(F.col("mse") > 0, F.log10(F.lit(255.0**2) / F.col("mse")) * 10).otherwise(99.0).alias("psnr"), "mae")


def interior_mae(predicted: DataFrame, gradient: str, most: float = 0.5, top: float = 1.0) -> DataFrame:
    """Mean absolute error over pixels whose gradient column is below `most`."""
    k = 255.0 / top
    mae = F.avg(sum((F.abs(F.col(c) - F.col(f"p_{c}")) * k for c in CHANNELS), F.lit(0.0)) / 3)
    return predicted.where(F.col(gradient) < most).groupBy("image_id").agg(mae.alias("mae"), F.count("*").alias("n"))


def mean_abs_gradient(px: DataFrame, value: str) -> DataFrame:
    """(image_id, g): mean absolute neighbour difference along rows plus that along columns; larger is rougher."""
    dx = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy("image_id", "y").orderBy("x")))
    dy = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy("image_id", "x").orderBy("y")))
    return px.withColumn("_dx", dx).withColumn("_dy", dy).groupBy("image_id").agg((F.avg("_dx") + F.avg("_dy")).alias("g"))


def activity(errors: DataFrame, core: DataFrame | None = None, least: int = 50) -> DataFrame:
    """(…, activity): mean residual act over the core of regions whose core has `least` pixels; errors are of the core if it isn't given."""
    inner = errors if core is None else errors.join(core.select("image_id", "y", "x").hint("merge"), ["image_id", "y", "x"], "left_semi")
    return inner.groupBy(*KEY).agg(F.avg("act").alias("activity"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
