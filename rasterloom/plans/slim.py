"""Existing documents made small: a folder of SVG files in, slim (and packed) documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import svg
from rasterloom.sources.images import read_svg


def slim_folder(spark: SparkSession, source: str, tight: bool = False, packed: bool = True) -> DataFrame:
    """(path, before, svg, valid[, svgz], after): every document of a folder; a map, no shuffle.

    Documents that are no valid XML after slimming come back as they were, with valid false.
    """
    found = read_svg(spark, source).withColumn("old", F.col("svg"))
    slim = svg.slimmed(found, tight=tight, packed=packed)
    out = slim.withColumn("svg", F.when(F.col("valid"), F.col("svg")).otherwise(F.col("old")))
    after = F.octet_length("svgz") if packed else F.octet_length("svg")
    return out.withColumn("before", F.octet_length("old")).withColumn("after", after).drop("old")
