"""What the training-data operators share: the shared folder, table reading, column handling, text chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Spark's setting for the bytes of a batch between JVM and Python, its default, and what the operators set in its place:
#: wide rows (texts, shingle sets) would else fill 64 MB in each of several buffers of a task.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864", "8388608"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's batches, unless the setting has been changed from its default."""
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT).rstrip("b") == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a temporary one only where that is unset and Spark is local (tests)."""
    small_batches(spark)
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named and context.getCheckpointDir() is None and not context.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="rasterloom-checkpoint-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: lineage ends here and a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """As cut(), as a compressed Parquet table: for wide rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rasterloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(column: str, buckets: int):
    """crc32 of an id as text, modulo buckets: the held-out rule of the query contracts. Null ids fall into fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % buckets, F.lit(0))


def chunked(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(row number of the first, texts as UTF-8 bytes) in chunks of at most `most` bytes or one text; null counts as empty."""
    raw = [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]
    at, size = 0, 0
    for i, x in enumerate(raw):
        if size and size + len(x) > most:
            yield at, raw[at:i]
            at, size = i, 0
        size += len(x) + 1
    if at < len(raw):
        yield at, raw[at:]


def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches, cut so that no kernel gets more than a few thousand rows at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            yield batch.slice(at, 4096)


#: Ids that without() may broadcast; more are taken out by a shuffled join.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is in the one column of ids; rows without id stay. Ids are broadcast if counted few."""
    gone = stash(ids.toDF("_gone").where("_gone is not null").distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col(id_col) == F.col("_gone"), "left_anti")
