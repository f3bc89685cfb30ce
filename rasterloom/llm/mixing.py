"""Mixing sources to target weights (8): repetition rates by source, whole copies plus one hash-seeded Bernoulli copy.

Method. Sizes (words `[^\\x20\\x09-\\x0D]+`) are summed by source. Sources in code point order, null last, take the
weights in turn; each gets its weight's share of the total size, but at most `most` times its own size, and what is
cut off is shared again by weight until none is above. That water level has a closed form: in the order of
most * size / weight, a source is capped iff its cap lies below its weight's share of what the earlier ones left,
which running sums decide in exact integers. rate = target / size; a document is taken floor(rate) times, and once
more if a hash of seed and id, uniform in [0, 1), lies below the fraction. Reruns and other partitionings agree.

Plan. One pass with a partial aggregate by source, so that a hot source costs nothing; running sums over the one
row of each source, in range partitions whose totals (a few numbers each) are added up on the driver, so that sources may
be as many as documents; a map-side join back to the documents when there are at most BROADCAST_SOURCES sources
(counted), else a shuffled one. Texts are neither shuffled nor collected.

Defined cases. Null texts have size 0 and are taken no words. A null source is a source of its own, last. Null ids
hash as an empty string; repeated rows of one id are all counted and draw alike. Extra columns pass through
untouched, whatever their names. Empty tables give empty results; when all sizes are 0 all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import stash

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
BROADCAST_SOURCES = 50_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[Column], values: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """df with the sums of values over all rows before each in an order without ties, and their totals.

    Rows are dealt by ranges; a window runs inside each range only.
    """
    ranged = stash(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = [F.sum(v).cast("long").alias(name) for name, v in values.items()]
    before, offsets = dict.fromkeys(values, 0), []
    for row in sorted(ranged.groupBy("_part").agg(*sums).collect(), key=lambda r: r["_part"]):
        offsets.append((row["_part"], *before.values()))
        before = {name: n + int(row[name] or 0) for name, n in before.items()}
    schema = "_part int" + "".join(f", _{name} long" for name in values)
    first = F.broadcast(df.sparkSession.createDataFrame(offsets or [(-1, *before.values())], schema))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(first, "_part").select("*", *((F.col(f"_{name}") + F.coalesce(F.sum(v).over(own), F.lit(0))).alias(name) for name, v in values.items()))
    return out.drop("_part", *(f"_{name}" for name in values)), before


def _product(a: Column, b: Column) -> Column:
    """Exact beyond 64 bits."""
    return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, int]:
    """(source, source_size) -> the same with weight and target, one row for each source; and the number of sources."""
    ranked, all_ = running(sizes, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long"), "total": F.col("source_size")})
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    df = ranked.select("source", "source_size", turn.alias("weight"), (F.col("source_size") * most).alias("cap"))
    order = [(F.col("cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    df, sums = running(df, order, {"caps": F.col("cap"), "shares": F.col("weight")})
    rest, shares = F.lit(all_["total"]) - F.col("caps"), F.lit(sums["shares"]) - F.col("shares")
    df = df.withColumn("capped", _product(F.col("cap"), shares) <= _product(rest, F.col("weight")))
    cut_off = df.agg(F.sum(F.when(F.col("capped"), F.col("cap"))).alias("caps"), F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("free")).first()
    left, free = all_["total"] - int(cut_off["caps"] or 0), int(cut_off["free"] or 0)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.lit(left)).cast("double") / F.lit(float(free)))
    return df.select("source", "source_size", "weight", target.alias("target")), all_["rank"]


def uniform(id_: Column, seed: str) -> Column:
    """52 bits of md5(seed:id) as a number in [0, 1)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """One row per document: doc (all its columns), id, size, source_size, target, copies."""
    sized = docs.select(F.struct("*").alias("doc")).select("doc", F.col("doc").getField(id_col).alias("id"), F.col("doc").getField(source_col).alias("source"), words_in(F.col("doc").getField(text_col)).alias("size"))
    totals = docs.select(F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets, sources = source_targets(totals, weights, most)
    targets = targets.select(F.struct("source").alias("key"), "source_size", "target")
    if sources <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    both = sized.join(targets, F.struct(sized["source"]).eqNullSafe(targets["key"]))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (uniform(F.col("id"), seed) < rate - F.floor(rate)).cast("long")
    return both.select("doc", "id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with all their columns, each as often as it is taken."""
    plan = mix_plan(docs, **options)
    return plan.where("copies > 0").select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("doc.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM sized GROUP BY source
), prefix AS (
  SELECT *, source_size * 3 AS cap,
         CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER before, 0) AS BIGINT) AS rest,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS shares
  FROM totals WINDOW before AS (ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), flagged AS (
  SELECT *, cap * shares <= rest * weight AS capped FROM prefix
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS BIGINT) AS left_over,
         CAST(coalesce(sum(CASE WHEN NOT capped THEN weight END) OVER (), 0) AS BIGINT) AS free FROM flagged
), targets AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(weight * left_over AS DOUBLE) / CAST(free AS DOUBLE) END AS target FROM levels
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""
