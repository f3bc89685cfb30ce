"""Token-ID / binary output (6): rANS-coded token files in ascending id order, and their reader.

Method. Texts are encoded by a public tokenizer without special tokens, each closed by an end id. Ids go in ascending
document order to shards (range partitions), and in each shard to segments of SEGMENT ids or the one text that is
longer. A segment is coded with a static range asymmetric numeral system (`rans`): one frequency table from all its ids,
shared by independent interleaved blocks that have a checkpoint and a checksum each.

Plan. One shuffle, of the texts by ranges of id; encoding and writing are one map behind it, so that ids are never
shuffled or kept uncoded. Files are written by Spark's own committer (a Parquet table of segments, whose payloads are
the format), so that lost executors leave no half files and any store works. Reading is a map over segments; the
document offsets need one number for each shard on the driver.

Defined cases. Null texts are empty: they have the end id alone. Null document ids come first; repeated ids stay as rows
of their own, in order of their texts' xxhash64, which also divides the rows of one id among shards. Empty tables write no segments. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import rans
from rasterloom.llm.common import flat, shared_dir
from rasterloom.llm.pretokens import encoder, text_chunks

SEGMENT = 1 << 20
SCHEMA = "shard int, segment int, start long, n_docs long, n_tokens long, payload binary"


def _encode(tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        number, start = 0, 0
        docs: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def give() -> pa.RecordBatch:
            own = [np.concatenate(x) for x in (docs, nulls, lengths, ids)]
            row = [shard, number, start, len(own[0]), len(own[3]), rans.pack(*own)]
            for x in (docs, nulls, lengths, ids):
                x.clear()
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "segment", "start", "n_docs", "n_tokens", "payload"])

        held = 0
        for batch in flat(batches):
            column = batch.column(0)
            own_ids, own_nulls = np.asarray(column.fill_null(0)), np.asarray(column.is_null())
            for at, texts in text_chunks([x or "" for x in batch.column(1).to_pylist()]):
                got, offsets = encoder(tokenizer).encode(texts, end)
                docs.append(own_ids[at : at + len(texts)])
                nulls.append(own_nulls[at : at + len(texts)])
                lengths.append(np.diff(offsets))
                ids.append(got)
                held += len(got)
                if held >= SEGMENT:
                    yield give()
                    number, start, held = number + 1, start + held, 0
        if held:
            yield give()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Token files of all documents under path (a folder that all executors share)."""
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
    order = F.col("id").asc_nulls_first(), F.col("digest")
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text").drop("digest")
    dealt.mapInArrow(_encode(tokenizer, end), SCHEMA).write.option("compression", "uncompressed").parquet(path)


def _decode(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs, nulls, lengths, ids = rans.unpack(payload)
                offsets = np.concatenate(([0], np.cumsum(lengths.astype(np.int64))))
                raw = ids.astype("<u4")
                columns = [pa.array(docs, mask=nulls), pa.array(offsets[:-1] + start), pa.array(lengths.astype(np.int64))]
                if whole:
                    last = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(raw.astype(np.int32)))
                else:
                    last = pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64())
                yield pa.record_batch([*columns, last], ["id", "start", "n_tokens", "ids" if whole else "crc32"])

    return run


def read_tokens(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids) from token files; with whole=False the crc32 of the ids in their place."""
    found = spark.read.schema(SCHEMA).parquet(path)
    sizes = {r["shard"]: r["n"] for r in found.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    before, offsets = 0, []
    for shard in sorted(sizes):
        offsets.append((shard, before))
        before += sizes[shard]
    first = F.broadcast(spark.createDataFrame(offsets or [(-1, 0)], "shard int, before long"))
    rows = found.join(first, "shard").select((F.col("start") + F.col("before")).alias("start"), "payload")
    return rows.mapInArrow(_decode(whole), "id long, start long, n_tokens long, " + ("ids array<int>" if whole else "crc32 long"))


def tokens_of(docs: DataFrame, tokenizer: str, end: int = 2, whole: bool = False, **columns) -> DataFrame:
    """The documents' tokens as read back from files written for them in the shared folder."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/rasterloom-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end, **columns)
    return read_tokens(spark, path, whole)
