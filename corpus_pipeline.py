"""The corpus pipeline: five stages, each of which calls one training-data operator on all that the stage before kept.

Each stage's function takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Models and statistics are learned from the stage's own input.

Defined cases. Rows without id take part as others do: filtering stages know them by a hash of the whole row, and of equal
ones one stays in near-dedup. Of repeated ids the row that is least in the order of its columns, text first, stays there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import langid
from rasterloom.llm.common import fold, stash, table, without
from rasterloom.llm.decontamination import contaminated
from rasterloom.llm.mixing import mixed
from rasterloom.llm.neardup import near_duplicates
from rasterloom.llm.queries import byte_bpe
from rasterloom.llm.token_files import tokens_of


def known(docs: DataFrame) -> DataFrame:
    """docs with _key: the id, or a hash of the row where there is none."""
    return docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(*docs.columns)))


def keep(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the keys in gone."""
    return without(known(docs), gone, "_key").drop("_key")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those of no letter, and those none of whose n-grams any language holds."""
    found = langid.predict(known(docs), langid.train(docs.where(fold("doc_id", 4) != 2)), "_key")
    return keep(docs, found.where((F.col("lang_pred") == langid.UND) | (F.col("score") <= 0)).select("id"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id (or hash, where there is none)."""
    if known(docs).groupBy("_key").count().where("count > 1").limit(1).count():
        columns = ["text", *(c for c in docs.columns if c != "text")]
        once = known(docs).groupBy("_key").agg(F.min(F.struct(*columns)).alias("_row"))
        docs = stash(once.select(*(F.col(f"_row.{c}").alias(c) for c in docs.columns)), "once")
    return keep(docs, near_duplicates(known(docs), "_key").where("not kept").select("id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return keep(docs, contaminated(known(docs), table(spark, sf_dir, "benchmark"), "_key").select("id").distinct())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, in order of ids, read back: (doc_id, start, n_tokens, ids_crc32)."""
    read = tokens_of(docs, byte_bpe(), end=2)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc32").alias("ids_crc32"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", token_output),
]

#: Models, components and token ids are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stash(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
