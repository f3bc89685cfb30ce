"""Every catalogue query runs; those with SQL equal it row by row."""

import pytest

from rasterloom.plans import catalogue, oracles

from .conftest import SMALL

def same(spark_rows, sql_rows):
    columns = sorted(spark_rows.columns)
    assert columns == sorted(sql_rows.columns)
    a, b = (df[columns].sort_values(columns).reset_index(drop=True) for df in (spark_rows, sql_rows))
    assert len(a) == len(b)
    for c in columns:
        assert (a[c].astype(object) == b[c].astype(object)).all(), c


@pytest.mark.parametrize("name", sorted(oracles.ORACLE))
def test_equals_sql(spark, tables, name):
    same(catalogue.QUERIES[name](spark, SMALL).toPandas(), tables.execute(oracles.ORACLE[name]).df())


@pytest.mark.parametrize("name", ["background_label", "border_pixels"])
def test_figure_without_key_equals_sql(spark, tmp_path, name):
    """A supplier whose key is null has a figure, as in the SQL."""
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE TABLE supplier AS SELECT unnest([1, 2, NULL])::BIGINT AS s_suppkey; COPY supplier TO '{tmp_path}/supplier.parquet'")
    rows = catalogue.QUERIES[name](spark, str(tmp_path))
    want = c.execute(f"SELECT {', '.join(rows.columns)} FROM ({oracles.ORACLE[name]})").fetchall()
    assert None in {r[0] for r in want} and sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows.collect())


def rows_of(spark, name):
    rounded = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(str([rounded(v) for v in r]) for r in catalogue.QUERIES[name](spark, SMALL).collect())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(oracles.ORACLE)))
def test_same_rows_for_other_partitions(spark, name):
    """Queries that SQL can't express return rows, and the same ones however pixels are dealt."""
    one = rows_of(spark, name)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert one and rows_of(spark, name) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_models_find_the_ramp(spark):
    px, fills, fits = catalogue._models(spark, SMALL)
    rows = fits.collect()
    assert rows and all(r["label"] == 3 and abs(r["ux"]) > 0.99 and r["gain"] > 0.9 for r in rows)


def test_entry(spark):
    assert catalogue.entry(spark, SMALL).count() == 40
