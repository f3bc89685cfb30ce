"""Images as pixels, label tables and other kept tables, file hashes, and sinks for documents and metrics."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.text import gzip_column


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for id_, h, w, n, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            plane = np.frombuffer(data, np.uint8).reshape(h, w, n)
            bgr = plane[..., :3] if n >= 3 else np.repeat(plane[..., :1], 3, axis=2)
            y, x = (g.ravel().astype(np.int32) for g in np.mgrid[:h, :w])
            rgb = [pa.array(bgr[..., c].ravel() / 255.0) for c in (2, 1, 0)]
            yield pa.record_batch([pa.array(np.full(h * w, id_, np.int64)), pa.array(y), pa.array(x), *rgb], ["image_id", "y", "x", "r", "g", "b"])


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, pixels) of PNG or JPEG files: (image_id, path, w, h) and (image_id, y, x, r, g, b) in 0..1; ids hash the path."""
    found = spark.read.format("image").option("dropInvalid", True).load(path).select(F.xxhash64("image.origin").alias("image_id"), "image.*")
    images = found.select("image_id", F.col("origin").alias("path"), F.col("width").alias("w"), F.col("height").alias("h"))
    pixels = found.select("image_id", "height", "width", "nChannels", "data").mapInArrow(_explode, "image_id long, y int, x int, r double, g double, b double")
    return images, pixels


def kept(df: DataFrame, name: str) -> DataFrame:
    """df computed once: a Parquet table in the shared folder that spark.checkpoint.dir names, or Spark's cache without one."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder}/rasterloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def options_key(options) -> str:
    """The same short key for the same options (a dataclass) in every session."""
    return hashlib.md5(repr(sorted(asdict(options).items())).encode()).hexdigest()[:16]


def cached_labels(spark: SparkSession, folder: str, options, make, buckets: int = 64) -> DataFrame:
    """The label table kept for a trace's options under folder, made and kept if it isn't there; images dealt to buckets by hash."""
    path = f"{folder}/{options_key(options)}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop.suffix("/_SUCCESS")):
        bucketed(make(), buckets).write.mode("overwrite").partitionBy("bucket").parquet(path)
    return spark.read.parquet(path).drop("bucket")


def bucketed(df: DataFrame, buckets: int = 64) -> DataFrame:
    """df with a column bucket, from the hash of image_id: what tables of many images are partitioned by."""
    return df.withColumn("bucket", F.pmod(F.xxhash64("image_id"), F.lit(buckets)).cast("int"))


def write_labels(labels: DataFrame, path: str, buckets: int = 64) -> None:
    """Refined labels, or any pixels of images, as a table in buckets."""
    bucketed(labels, buckets).write.mode("overwrite").partitionBy("bucket").parquet(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5, size) of every file under a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"), F.col("length").alias("size"))


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of the files that read_images leaves out because they are no images that Spark can read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    seen = spark.read.format("image").option("dropInvalid", True).load(path).select(F.col("image.origin").alias("path"))
    return files.join(seen, "path", "left_anti")


def read_svg(spark: SparkSession, path: str) -> DataFrame:
    """(path, svg): whole documents."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("svg"))


def write_svg(docs: DataFrame, path: str, packed: bool = False, buckets: int = 0) -> None:
    """Documents under path: text files, a folder an image; with buckets (for many images) or packed (gzip bytes, the same for
    the same text) a table."""
    if packed:
        docs = docs.select("image_id", gzip_column("svg").alias("svgz"))
    if buckets:
        bucketed(docs.select("image_id", "svgz" if packed else "svg"), buckets).write.mode("overwrite").partitionBy("bucket").parquet(path)
    elif packed:
        docs.write.mode("overwrite").parquet(path)
    else:
        docs.select("image_id", "svg").write.mode("overwrite").partitionBy("image_id").text(path)


def write_audit(df: DataFrame, path: str) -> None:
    """Tab-separated audit rows."""
    df.write.mode("overwrite").option("header", True).csv(path, sep="\t")


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def output_names(source: str) -> dict[str, str]:
    """Where a bare file name is read from and what is written for it: inputs/ and out/."""
    src = source if "/" in source else f"inputs/{source}"
    stem = src.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return {"src": src, "svg": f"out/{stem}.svg", "svgz": f"out/{stem}.svgz", "preview": f"out/{stem}_preview.png"}
