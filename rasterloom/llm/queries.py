"""Queries of the training-data operators: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import langid, mixing, pii, secret_scan, token_counts, token_files, toxicity
from rasterloom.llm.common import fold, table
from rasterloom.llm.decontamination import contaminated
from rasterloom.llm.embedding_links import embedding_links
from rasterloom.llm.neardup import near_duplicates


def byte_bpe() -> str:
    """The public byte-level BPE file; wherever the tokenizers' package lies."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def kind_is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = fold("id", toxicity.FOLDS) == toxicity.HELD_OUT
    return toxicity.score(docs, model).select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    counts = [F.size(F.filter("spans", kind_is(k))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(secret_scan.spelled(base).cast("binary"), 256).alias("base_sha256"), secret_scan.spelled(F.col("spans")).alias("spans"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold("doc_id", 4) != 2))
    return langid.predict(docs, model).select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.tokens_of(table(spark, sf_dir, "documents"), byte_bpe(), end=2)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc32").alias("ids_crc32"))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole text before and after three edits a document, at places drawn from its id."""
    docs = table(spark, sf_dir, "documents")
    length = F.coalesce(F.char_length("text"), F.lit(0))

    def edit(k: int) -> Column:
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"edit{k}"), F.col("doc_id").cast("string"))), 1, 12), 16, 10).cast("long")
        start = (draw % (length + 1)).cast("long")
        return F.struct(start.alias("start"), (start + 4 * k).alias("end"), F.element_at(F.array(F.lit(""), F.lit(" [edited]"), F.lit("x")), k + 1).alias("text"))

    counted = token_counts.token_counts(docs.select("doc_id", "text", F.array(*map(edit, range(3))).alias("edits")), byte_bpe(), edits_col="edits")
    return counted.withColumnRenamed("id", "doc_id")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    counts = [F.size(F.filter("spans", kind_is(k))).cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(secret_scan.spelled(base).cast("binary"), 256).alias("base_sha256"), secret_scan.spelled(F.col("spans")).alias("spans"))


ORACLE_1 = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM embeddings LEFT JOIN least_of ON vec_id = least_of.a LEFT JOIN counted ON vec_id = counted.a
"""

ORACLE_7 = """
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM worded
), sizes AS (SELECT r, doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
members AS (SELECT r, unnest(s) AS x FROM sets),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM members a JOIN members b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
half AS (SELECT a, b FROM shared JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b WHERE 100 * shared.n >= 85 * (p.n + q.n - shared.n)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_of AS (SELECT a, min(doc_id) AS root FROM reach JOIN sizes ON r = b GROUP BY a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(root, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(root, doc_id)) AS kept
FROM sizes LEFT JOIN least_of ON r = a
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_neardup": op1_embedding_neardup,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_token_files": op6_token_files,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE: dict[str, str] = {
    "op1_embedding_neardup": ORACLE_1,
    "op7_minhash_neardup": ORACLE_7,
    "op8_mixing": mixing.ORACLE,
}
