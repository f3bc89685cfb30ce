"""Closed polylines as rows (image_id, seq, x, y): area, corners, chords, spline controls, runs. Windows per ring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = ["image_id"]


def _around(df: DataFrame, columns: tuple[str, ...], steps: tuple[int, ...], keys: list[str]) -> DataFrame:
    """Columns <name>_<step>: values that many places on along the closed ring (p for forward, m for backward)."""
    size = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    df = df.join(size, keys)
    for step in steps:
        name = f"{'p' if step > 0 else 'm'}{abs(step)}"
        other = df.select(*keys, F.pmod(F.col("seq") - step, F.col("_size")).alias("seq"), *(F.col(c).alias(f"{c}_{name}") for c in columns))
        df = df.join(other, [*keys, "seq"])
    return df.drop("_size")


def shoelace(df: DataFrame, keys: list[str] = RING) -> DataFrame:
    """(keys, area): half the absolute cross sum of a ring."""
    both = _around(df, ("x", "y"), (1,), keys)
    return both.groupBy(*keys).agg((F.abs(F.sum(F.col("x") * F.col("y_p1") - F.col("y") * F.col("x_p1"))) / 2).alias("area"))


def corner_angles(df: DataFrame, k: int = 1, keys: list[str] = RING) -> DataFrame:
    """angle: degrees between the directions from k places before and to k places after each point."""
    both = _around(df, ("x", "y"), (-k, k), keys)
    ax, ay = F.col("x") - F.col(f"x_m{k}"), F.col("y") - F.col(f"y_m{k}")
    bx, by = F.col(f"x_p{k}") - F.col("x"), F.col(f"y_p{k}") - F.col("y")
    turn = F.abs(F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by)))
    return both.select(*keys, "seq", "x", "y", turn.alias("angle"))


def chord_parameters(df: DataFrame, keys: list[str] = RING) -> DataFrame:
    """u: cumulated chord length as a share of the open polyline's, 0 at its start; all 0 where it has no length."""
    w = Window.partitionBy(*keys).orderBy("seq")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    run = df.withColumn("_s", step).withColumn("_c", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum("_s").over(Window.partitionBy(*keys)))
    return run.withColumn("u", F.when(F.col("_t") > 0, F.col("_c") / F.col("_t")).otherwise(0.0)).drop("_s", "_c", "_t")


def spline_controls(df: DataFrame, most: float = 0.55, keys: list[str] = RING) -> DataFrame:
    """Catmull-Rom controls of the curve from each point to the next: a sixth of the neighbours' chord, clamped to `most` of the side."""
    both = _around(df, ("x", "y"), (-1, 1, 2), keys)
    side = F.hypot(F.col("x_p1") - F.col("x"), F.col("y_p1") - F.col("y"))

    def control(x: Column, y: Column, dx: Column, dy: Column, name: str) -> list[Column]:
        length = F.hypot(dx, dy)
        k = F.when(length > most * side, most * side / length).otherwise(1.0)
        return [(x + dx * k).alias(f"{name}x"), (y + dy * k).alias(f"{name}y")]

    first = control(F.col("x"), F.col("y"), (F.col("x_p1") - F.col("x_m1")) / 6, (F.col("y_p1") - F.col("y_m1")) / 6, "c1")
    second = control(F.col("x_p1"), F.col("y_p1"), (F.col("x") - F.col("x_p2")) / 6, (F.col("y") - F.col("y_p2")) / 6, "c2")
    return both.select(*keys, "seq", "x", "y", *first, *second, F.col("x_p1").alias("ex"), F.col("y_p1").alias("ey"))


def moving_average(df: DataFrame, value: str, half: int, keys: list[str] = RING) -> DataFrame:
    """Mean over the places within `half` of each; shorter at the ends."""
    return df.withColumn(f"{value}_avg", F.avg(value).over(Window.partitionBy(*keys).orderBy("seq").rowsBetween(-half, half)))


def filled_forward(df: DataFrame, value: str, keys: list[str] = RING) -> DataFrame:
    """Missing values (null) replaced by the last one before."""
    return df.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def runs(df: DataFrame, value: str, keys: list[str] = RING) -> DataFrame:
    """(keys, run, value, first, n): runs of equal neighbours along the closed ring; a run over the seam counts once."""
    w = Window.partitionBy(*keys).orderBy("seq")
    change = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(0))
    marked = df.withColumn("run", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys)
    marked = marked.withColumn("_last", F.max("run").over(whole)).withColumn("_first", F.min(F.struct("seq", value)).over(whole)[value]).withColumn("_end", F.max(F.struct("seq", value)).over(whole)[value])
    joined = F.when((F.col("run") == F.col("_last")) & (F.col("_first") == F.col("_end")), F.lit(0)).otherwise(F.col("run"))
    return marked.withColumn("run", joined).groupBy(*keys, "run", value).agg(F.min("seq").alias("first"), F.count("*").alias("n"))
