import struct
import zlib

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import fit, grids, regions
from rasterloom.plans.params import for_smoothness, for_size, params
from rasterloom.plans.trace import traced
from rasterloom.sources import images
from rasterloom.sources.relations import fig

from .conftest import SMALL


def test_params():
    assert params().scale == 4.0 and params("logo").scale == 4.0 and params("logo").no_strokes
    assert params("painting", kmeans_k=9).kmeans_k == 9 and params("painting").thresh == 8.0
    small = for_size(params(scale=1.0), 627, 400)
    assert small.min_area == 150 and small.spacing == 5.0 and small.edge_min_len == 2
    assert for_size(params(scale=2.0), 2000, 100).spacing == 20.0
    with pytest.raises(ValueError):
        params(nothing=1)


def png(width, height, pixels):
    raw = b"".join(b"\0" + bytes(c for x in range(width) for c in pixels[y][x]) for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_source(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 2, [[(255, 0, 0), (0, 255, 0), (0, 0, 255)], [(10, 20, 30)] * 3]))
    found, pixels = images.read_images(spark, str(tmp_path))
    assert [(r["w"], r["h"]) for r in found.collect()] == [(3, 2)]
    rows = {(r["y"], r["x"]): (round(r["r"] * 255), round(r["g"] * 255), round(r["b"] * 255)) for r in pixels.collect()}
    assert rows[0, 0] == (255, 0, 0) and rows[0, 2] == (0, 0, 255) and rows[1, 1] == (10, 20, 30)


def test_names():
    assert images.output_names("apple.png")["src"] == "inputs/apple.png" and images.output_names("/x/apple.png")["svg"] == "out/apple.svg"


def test_trace_makes_documents(spark, tmp_path):
    px = fit.scaled(fig(spark, SMALL).where("image_id IN (1, 2)")).drop("label")
    p = params(scale=1.0, method="colors", kmeans_k=6, kmeans_iters=4, min_area=40, autoscale=False, contour_min_area=8.0, gzip=True, spacing=6.0, stroke_min=8.0, aa_levels=2, edge_mode="both", shade_blobs=True, shade_layers=2)
    cut = lambda df, name: (df.write.mode("overwrite").parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}"))[1]
    docs = traced(px, p, cut)
    rows = docs.collect()
    assert len(rows) == 2
    for r in rows:
        assert r["svg"].startswith("<svg") and '<g id="regions">' in r["svg"] and r["psnr"] > 15 and r["svgz"][:2] == b"\x1f\x8b"
    images.write_svg(docs, f"{tmp_path}/many", buckets=4)
    assert spark.read.parquet(f"{tmp_path}/many").select("image_id", "svg").exceptAll(docs.select("image_id", "svg")).count() == 0
    images.write_svg(docs, f"{tmp_path}/out")
    assert images.read_svg(spark, f"{tmp_path}/out/*").count() == 2


def test_label_cache(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return fig(spark, SMALL).select("image_id", "y", "x", "label")

    p = params(scale=1.0)
    first = images.cached_labels(spark, str(tmp_path), p, make).count()
    assert images.cached_labels(spark, str(tmp_path), params(scale=1.0), make).count() == first and len(made) == 1
    assert images.cached_labels(spark, str(tmp_path), params(scale=2.0), make).count() == first and len(made) == 2
    images.write_labels(make(), f"{tmp_path}/refined")
    assert spark.read.parquet(f"{tmp_path}/refined").select("image_id", "y", "x", "label").exceptAll(make()).count() == 0


def test_hashes_audit_and_metrics(spark, tmp_path):
    import hashlib
    import json

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc")
    (row,) = images.file_hashes(spark, f"{tmp_path}/in").collect()
    assert row["md5"] == hashlib.md5(b"abc").hexdigest() and row["size"] == 3
    assert images.unreadable(spark, f"{tmp_path}/in").count() == 1
    px = fit.scaled(fig(spark, SMALL).where("image_id = 1"))
    audit = grids.band_audit(px)
    images.write_audit(audit, f"{tmp_path}/audit")
    back = spark.read.option("header", True).option("sep", "\t").csv(f"{tmp_path}/audit")
    assert back.columns == ["image_id", "label", "neighbor", "points", "ring", "synthetic"] and back.count() == audit.count() > 0
    images.write_metrics(spark.createDataFrame([(1, 30.5)], "image_id long, psnr double"), f"{tmp_path}/metrics")
    (line,) = [x for p in (tmp_path / "metrics").glob("*.json") for x in p.read_text().splitlines()]
    assert json.loads(line) == {"image_id": 1, "psnr": 30.5}


def test_smoothness_gates():
    p = params(scale=1.0, auto_gradient=True)
    q = for_smoothness(p, 0.02)
    assert (q.grad_min_gain, q.merge_grad_tol, q.merge_grad_passes, q.aa_levels, q.refine_err) == (0.02, 0.3, 8, 3, 0.008)
    assert for_smoothness(p, 0.005) == p and for_smoothness(params(scale=1.0), 0.02) == params(scale=1.0)
    assert for_smoothness(params(scale=1.0, auto_gradient=True, aa_levels=1, refine_err=0.001), 0.02).aa_levels == 1


def test_trace_does_not_depend_on_partitions(spark):
    px = fit.scaled(fig(spark, SMALL).where("image_id IN (1, 2)")).drop("label")
    p = params(scale=1.0, method="colors", kmeans_k=6, kmeans_iters=4, min_area=40, autoscale=False, contour_min_area=8.0, auto_gradient=True, spacing=6.0, stroke_min=8.0)
    one, two = ({r["image_id"]: r["svg"] for r in traced(x, p).collect()} for x in (px, px.repartition(7, "x")))
    assert one == two and len(one) == 2


def test_degenerate_images_through_dataframes(spark):
    rows = [(1, 0, 0, 0.5), *((2, 0, x, x / 9) for x in range(10)), *((3, y, x, 0.25) for y in range(9) for x in range(9))]
    px = spark.createDataFrame([(i, y, x, v, v, v) for i, y, x, v in rows], "image_id long, y int, x int, r double, g double, b double")
    found = traced(px, params(scale=1.0, method="colors", seg="auto", min_area=1, no_strokes=True, auto_gradient=True)).collect()
    assert sorted(r["image_id"] for r in found) == [1, 2, 3] and all(r["svg"].startswith("<svg") for r in found)


def test_stream_of_arrivals(spark, tmp_path):
    from rasterloom.streaming.arrivals import trace_arrivals

    px = fit.scaled(fig(spark, SMALL).where("image_id = 1")).select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "r", "g", "b")
    px.write.parquet(f"{tmp_path}/in/a")
    plan = lambda df: regions.area(df.withColumn("label", F.lit(0)))
    for _ in range(2):  # the second run finds nothing new
        trace_arrivals(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/ck", plan).awaitTermination(120)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [r["area"] for r in rows] == [2304]


def test_kernel_equals_expression(spark):
    small = fig(spark, SMALL).where("image_id = 1")
    kernel = {(r["y"], r["x"]) for r in grids.per_pixel(small, lambda p: {"core": __import__("rasterloom.kernels.masks", fromlist=["x"]).eroded(p["label"] == 3)}, "core boolean", ["label"]).where("core").collect()}
    rows = {(r["y"], r["x"]) for r in regions.core(small, 1).where("label = 3").collect()}
    assert kernel == rows


def test_table_function(spark):
    from rasterloom.sources import relations

    relations.register(spark)
    spark.read.parquet(f"{SMALL}/embeddings.parquet").limit(20).createOrReplaceTempView("some")
    got = spark.sql("SELECT vec_id AS image_id, t.* FROM some, LATERAL pixels_of(embedding) t")
    want = relations.px(spark, SMALL).join(spark.table("some").selectExpr("vec_id AS image_id"), "image_id", "left_semi")
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == 20 * 64


def test_one_pass_profiles_equal_separate_ones(spark):
    px = fit.scaled(fig(spark, SMALL).where("label = 3"))
    t = px.withColumn("t", F.col("x").cast("double"))
    whole = {r["image_id"]: r for r in fit.profiles(t, regions.KEY, False).collect()}
    gains = {r["image_id"]: r["gain"] for r in fit.ramp_gain(t, regions.KEY).collect()}
    bins = fit.ramp_bins(t, regions.KEY).collect()
    assert whole and all(abs(whole[i]["gain"] - gains[i]) < 1e-9 for i in gains)
    for i, r in whole.items():
        assert [tuple(s)[1:] for s in r["stops"]] == [(b["r"], b["g"], b["b"]) for b in sorted((b for b in bins if b["image_id"] == i), key=lambda b: b["bin"])]


def test_slim_folder(spark, tmp_path):
    from rasterloom.plans.slim import slim_folder

    (tmp_path / "a.svg").write_text('<svg><g id="regions"><path d="M0.50 1.00L10.0 10.0Z"/></g></svg>')
    (tmp_path / "b.svg").write_text("<svg><g></svg>")
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in slim_folder(spark, str(tmp_path)).collect()}
    assert 'd="M.5 1L10 10z"' in rows["a.svg"]["svg"] and rows["a.svg"]["valid"] and rows["a.svg"]["svgz"][:2] == b"\x1f\x8b"
    assert not rows["b.svg"]["valid"] and rows["b.svg"]["svg"] == "<svg><g></svg>"


def test_regroup_refits_what_changed(spark):
    seen = []

    def refit(df):
        seen.append(df)
        return grids.gradient_models(df)

    px = fit.scaled(fig(spark, SMALL).where("image_id = 1"))
    groups = px.select("image_id", "label").distinct().selectExpr("image_id", "label", "cast(if(label = 2, 1, label) as int) AS group")
    old = grids.gradient_models(px)
    got = {r["label"]: r["gain"] for r in fit.regroup(px, groups, old, refit).collect()}
    assert {r["label"] for r in seen[0].select("label").distinct().collect()} == {1}
    assert got[3] == {r["label"]: r["gain"] for r in old.collect()}[3]
