"""Queries by name over the driver's tables: (spark, folder) -> DataFrame. Their SQL is in `oracles`."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import color, text
from rasterloom.functions.color import micro
from rasterloom.operators import fit, grids, palette, polylines, quality, regions, svg
from rasterloom.plans import trace
from rasterloom.plans.params import params
from rasterloom.sources.relations import fig, mx, px, rgb, rings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = regions.KEY
RGB = ("r", "g", "b")

#: Colours (0..255) that the fixed-palette queries use.
PALETTE = np.array([[250, 249, 246], [226, 92, 56], [32, 32, 40], [25, 120, 210]], float)


def query(of: Query) -> Query:
    QUERIES[of.__name__] = of
    return of


def _micro(df: DataFrame, keys: list[str], *names: str) -> DataFrame:
    return df.select(*keys, *(micro(F.col(n)).alias(n) for n in names))


def _place(df: DataFrame, *keys: str) -> DataFrame:
    """Number of pixels and a checksum of their places."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col("y") * 1000 + F.col("x")).cast("long")).alias("places"))


def _unit(spark: SparkSession, d: str) -> DataFrame:
    return fit.scaled(fig(spark, d))


def _with_luma(df: DataFrame) -> DataFrame:
    return df.withColumn("l", color.luma(*map(F.col, RGB)))


def _sloped(df: DataFrame) -> DataFrame:
    return fit.gradients(_with_luma(df), "l").withColumn("energy", F.col("gx") ** 2 + F.col("gy") ** 2)


def _axes(df: DataFrame) -> DataFrame:
    """A horizontal axis through each region's centroid."""
    return df.groupBy(*KEY).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).withColumn("ux", F.lit(1.0)).withColumn("uy", F.lit(0.0))


def _flat_prediction(df: DataFrame) -> DataFrame:
    """Pixels (0..255) with their region's median colour as the prediction, and residuals."""
    fills = regions.median_color(df).select(*KEY, *(F.col(c).alias(f"p_{c}") for c in RGB))
    return fit.residuals(regions.matched(df, fills))


# ---- scans, projections -------------------------------------------------------------------------


@query
def px_scan(spark, d):
    return px(spark, d)


@query
def px_normalize(spark, d):
    return rgb(spark, d).select("image_id", "y", "x", *(micro(color.unit(F.col(c) / 255.0)).alias(c) for c in RGB))


@query
def px_luma(spark, d):
    return rgb(spark, d).select("image_id", "y", "x", micro(color.luma(*map(F.col, RGB))).alias("luma"))


@query
def px_saturation(spark, d):
    return rgb(spark, d).select("image_id", "y", "x", color.saturation(*map(F.col, RGB)).alias("sat"))


@query
def px_lab_chroma(spark, d):
    return rgb(spark, d).select("image_id", "y", "x", micro(color.chroma(*(F.col(c) / 255.0 for c in RGB))).alias("chroma"))


@query
def hex_colors(spark, d):
    return rgb(spark, d).select("image_id", "y", "x", color.hex_color(*(F.col(c) / 255.0 for c in RGB)).alias("hex"))


@query
def border_pixels(spark, d):
    return _place(regions.border(fig(spark, d)), *KEY)


# ---- palettes -----------------------------------------------------------------------------------


@query
def hist_packed_color(spark, d):
    return palette.histogram(rgb(spark, d), 3)


@query
def palette_peaks(spark, d):
    return palette.peaks(fig(spark, d)).select("image_id", "key", "n")


@query
def palette_coverage(spark, d):
    return _micro(palette.coverage(fig(spark, d)), ["image_id", "n_peaks"], "coverage")


@query
def lut_nearest_color(spark, d):
    return palette.assign(fig(spark, d), PALETTE).groupBy("image_id", "cluster").agg(F.count("*").alias("n"))


@query
def palette_lookup(spark, d):
    found = palette.palette(fig(spark, d), least=16)
    return palette.lookup(fig(spark, d).drop("label"), found).groupBy("image_id", "label").agg(F.count("*").alias("n"))


@query
def kmeans_assign(spark, d):
    return palette.assign(rgb(spark, d), PALETTE).select("image_id", "y", "x", "cluster")


@query
def lloyd_step(spark, d):
    rows = palette.assign(rgb(spark, d), PALETTE).groupBy("cluster").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in RGB))
    return _micro(rows, ["cluster", "n"], *RGB)


@query
def kmeans_full(spark, d):
    return palette.kmeans(_unit(spark, d), 5, 4)[1].groupBy("cluster").agg(F.count("*").alias("n"))


# ---- region aggregates --------------------------------------------------------------------------


@query
def region_area(spark, d):
    return regions.area(fig(spark, d))


@query
def region_bbox(spark, d):
    return regions.bounding_boxes(fig(spark, d))


@query
def region_mean(spark, d):
    return _micro(regions.mean_color(fig(spark, d)), KEY, *RGB)


@query
def region_median(spark, d):
    return _micro(regions.median_color(fig(spark, d)), KEY, *RGB)


@query
def region_spread(spark, d):
    return _micro(regions.spread(fig(spark, d)), KEY, "spread")


@query
def region_mean_sat(spark, d):
    return regions.protected(fig(spark, d), 100.0).select(*KEY, micro(F.col("sat")).alias("sat"), "protected")


@query
def region_having_min_area(spark, d):
    return regions.at_least(fig(spark, d), 300)


@query
def region_fill_color(spark, d):
    px_ = fig(spark, d)
    return _micro(regions.fill_color(px_, regions.core(px_)), KEY, *RGB)


@query
def region_order(spark, d):
    return regions.ordered(fig(spark, d))


@query
def region_fit_mode(spark, d):
    return regions.choose_fit(fig(spark, d), F.col("x") < 24)


@query
def component_size_filter(spark, d):
    px_ = fig(spark, d)
    return _place(regions.pixels_of(px_, regions.at_least(px_, 300)), "image_id")


@query
def background_label(spark, d):
    return regions.background(fig(spark, d))


@query
def dense_relabel(spark, d):
    return _place(regions.dense_relabel(fig(spark, d).where("label <> 1")), "image_id", "label", "dense")


# ---- neighbours, morphology, sets ---------------------------------------------------------------


@query
def adjacency_pairs(spark, d):
    return regions.adjacency(fig(spark, d))


@query
def adjacency_color_distance(spark, d):
    return regions.pair_distances(fig(spark, d)).select("image_id", "a", "b", micro(F.col("d")).alias("d"), "rank")


@query
def region_boundary_pixels(spark, d):
    return _place(regions.boundary(fig(spark, d)), *KEY)


@query
def erosion_core(spark, d):
    return _place(regions.core(fig(spark, d)), *KEY)


@query
def dilation(spark, d):
    return _place(regions.dilated(fig(spark, d), 3, 2), *KEY)


@query
def min_max_filter_core(spark, d):
    return _place(regions.label_range(fig(spark, d), 2).where("low = high"), *KEY)


def _masks(spark, d) -> tuple[DataFrame, DataFrame]:
    px_ = fig(spark, d)
    return px_.where("label IN (1, 2)"), px_.where("x < 24")


@query
def set_union_masks(spark, d):
    return _place(regions.combine(*_masks(spark, d), "union"), "image_id")


@query
def set_intersect_masks(spark, d):
    return _place(regions.combine(*_masks(spark, d), "intersect"), "image_id")


@query
def set_except_masks(spark, d):
    return _place(regions.combine(*_masks(spark, d), "except"), "image_id")


@query
def central_gradient(spark, d):
    return _micro(fit.gradients(px(spark, d).withColumn("q", F.col("q").cast("double")), "q"), ["image_id", "y", "x"], "gx", "gy")


@query
def mean_abs_gradient(spark, d):
    return _micro(quality.mean_abs_gradient(px(spark, d), "q"), ["image_id"], "g")


# ---- filters ------------------------------------------------------------------------------------


@query
def gaussian_blur_nearest(spark, d):
    return _micro(grids.blurred(px(spark, d), "q", 1.0, "nearest"), ["image_id", "y", "x"], "q")


@query
def gaussian_blur_reflect(spark, d):
    return _micro(grids.blurred(px(spark, d), "q", 1.0, "reflect"), ["image_id", "y", "x"], "q")


@query
def structure_tensor(spark, d):
    t = grids.tensor(_unit(spark, d))
    return _micro(t.groupBy("image_id").agg(F.count("*").alias("n"), F.avg("coh").alias("coh"), F.max("l1").alias("l1"), F.avg("l2").alias("l2")), ["image_id", "n"], "coh", "l1", "l2")


@query
def texture_map(spark, d):
    return _micro(grids.texture(_unit(spark, d)).groupBy("image_id").agg(F.avg("texture").alias("texture"), F.max("texture").alias("most")), ["image_id"], "texture", "most")


@query
def denoised(spark, d):
    return _micro(grids.denoised(_unit(spark, d), 0.1).groupBy("image_id").agg(*(F.avg(c).alias(c) for c in RGB), F.stddev_pop("r").alias("spread")), ["image_id"], *RGB, "spread")


@query
def resized(spark, d):
    out = grids.resized(_unit(spark, d), 1.5).groupBy("image_id").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in RGB), F.stddev_pop("r").alias("spread"))
    return _micro(out, ["image_id", "n"], *RGB, "spread")


@query
def edge_map(spark, d):
    return _place(grids.edges(_unit(spark, d)).where("edge"), "image_id")


@query
def hysteresis(spark, d):
    return _place(grids.hysteresis(px(spark, d).withColumn("q", F.col("q").cast("double")), "q", 130.0, 180.0).where("kept"), "image_id")


@query
def distance_transform(spark, d):
    return _micro(grids.distances(fig(spark, d), 2), ["image_id", "y", "x"], "d")


@query
def mask_opening(spark, d):
    return _place(grids.morphology(fig(spark, d), 2, "opened").where("kept"), "image_id")


@query
def mask_closing(spark, d):
    return _place(grids.morphology(fig(spark, d), 2, "closed").where("kept"), "image_id")


@query
def connected_components(spark, d):
    quantised = px(spark, d).withColumn("label", F.expr("cast(q div 64 as int)"))
    return _place(grids.components(quantised), "image_id", "component")


# ---- models -------------------------------------------------------------------------------------


@query
def pca_axis(spark, d):
    return _micro(fit.pca_axis(_unit(spark, d)), [*KEY, "n"], "cx", "cy", "ux", "uy")


@query
def tensor_axis(spark, d):
    return _micro(fit.tensor_axis(_sloped(fig(spark, d))), KEY, "ux", "uy")


@query
def ramp_bins(spark, d):
    px_ = fig(spark, d)
    return _micro(fit.ramp_bins(fit.along_axis(px_, _axes(px_)), KEY), [*KEY, "bin", "n"], *RGB)


@query
def ramp_gain(spark, d):
    px_ = fig(spark, d)
    return _micro(fit.ramp_gain(fit.along_axis(px_, _axes(px_)), KEY), KEY, "gain")


@query
def radial_center_lsq(spark, d):
    return _micro(fit.radial_centers(_sloped(fig(spark, d))), [*KEY, "kind"], "cx", "cy")


@query
def radial_bins(spark, d):
    px_ = fig(spark, d)
    boxes = px_.groupBy(*KEY).agg(((F.min("x") + F.max("x")) / 2).alias("cx"), ((F.min("y") + F.max("y")) / 2).alias("cy"))
    return _micro(fit.ramp_bins(fit.from_center(px_, boxes), KEY, least_range=2.0), [*KEY, "bin", "n"], *RGB)


def _models(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    px_ = _unit(spark, d)
    sloped = _sloped(px_)
    pca = fit.pca_axis(px_)
    tensor = regions.matched(pca.drop("ux", "uy"), fit.tensor_axis(sloped))
    axes = pca.withColumn("kind", F.lit("pca")).unionByName(tensor.withColumn("kind", F.lit("tensor")))
    return px_, regions.median_color(px_), fit.fit_gradients(px_, axes, fit.radial_centers(sloped))


@query
def fit_select(spark, d):
    return _models(spark, d)[2].select(*KEY, "kind", F.size("stops").alias("n_stops"), micro(F.col("gain")).alias("gain"))


@query
def refine_accept(spark, d):
    """Regions whose two halves, each with its own median colour, pay for a split at x = 24."""
    px_ = fig(spark, d)
    halves = px_.withColumn("label", (F.col("label") * 2 + (F.col("x") >= 24).cast("int")).cast("int"))
    errors = _flat_prediction(halves).withColumn("label", F.floor(F.col("label") / 2).cast("int"))
    before, after = (fit.fill_stats(x, 5.0) for x in (_flat_prediction(px_), errors))
    return fit.accepts(before, after).select(*KEY)


@query
def regroup_models(spark, d):
    px_ = _unit(spark, d)
    groups = px_.select(*KEY).distinct().withColumn("group", F.when(F.col("label") == 2, 0).otherwise(F.col("label")).cast("int"))
    old = grids.gradient_models(px_)
    return fit.regroup(px_, groups, old, grids.gradient_models).select(*KEY, "kind", "gain")


@query
def fill_predict(spark, d):
    predicted = fit.residuals(fit.predict(*_models(spark, d)))
    return predicted.groupBy(*KEY).agg(F.avg("e").alias("e"), F.max("e").alias("most"))


@query
def fill_residual(spark, d):
    return _flat_prediction(fig(spark, d)).groupBy(*KEY).agg(micro(F.sum("e")).alias("e"), micro(F.sum("act")).alias("act"))


@query
def fill_stats(spark, d):
    return _micro(fit.fill_stats(_flat_prediction(fig(spark, d)), 5.0), [*KEY, "nbad"], "rms", "excess")


@query
def refine_trigger(spark, d):
    px_ = fig(spark, d)
    return fit.needs_refinement(fit.fill_stats(_flat_prediction(px_), 5.0), regions.area(px_), 200).select(*KEY, "area", "nbad")


@query
def error_split_axis(spark, d):
    return _micro(fit.error_axis(_flat_prediction(fig(spark, d))), KEY, "cx", "cy", "ux", "uy")


@query
def weighted_median_cut(spark, d):
    errors = _flat_prediction(fig(spark, d))
    return _micro(fit.weighted_cut(errors, _axes(errors)), KEY, "cut")


@query
def psnr_mae(spark, d):
    return _micro(quality.psnr(_flat_prediction(fig(spark, d)), 255.0), ["image_id"], "psnr", "mae")


@query
def interior_mae(spark, d):
    sloped = fit.gradients(_with_luma(_flat_prediction(fig(spark, d))), "l").withColumn("slope", F.abs("gx") + F.abs("gy"))
    return _micro(quality.interior_mae(sloped, "slope", 3.0, 255.0), ["image_id", "n"], "mae")


@query
def activity_residual(spark, d):
    px_ = fig(spark, d)
    return _micro(quality.activity(_flat_prediction(px_), regions.core(px_, 1)), KEY, "activity")


# ---- segmentation -------------------------------------------------------------------------------


def _segments(method: str, **options) -> Query:
    def run(spark, d):
        return _place(grids.segmented(_unit(spark, d), method, **options), *KEY)

    return run


for _method, _options in {"colors": {"k": 6, "rounds": 6}, "flat": {}, "edges": {}, "watershed": {}, "hybrid": {"k": 6, "rounds": 6, "snap": "watershed"}}.items():
    QUERIES[f"segment_{_method}"] = _segments(_method, **_options)


@query
def rag_merge(spark, d):
    tiles = rgb(spark, d).withColumn("label", (F.col("y") * 8 + F.col("x")).cast("int"))
    return _place(grids.merged_similar(tiles, 40.0), *KEY)


@query
def small_region_merge(spark, d):
    quantised = rgb(spark, d).withColumn("label", F.expr("cast(r div 64 as int)"))
    return _place(grids.merged_small(quantised, 8), *KEY)


@query
def merge_gradient(spark, d):
    strips = _unit(spark, d).withColumn("label", (F.col("label") * 4 + F.when(F.col("label") == 3, F.expr("(x - 30) div 4")).otherwise(0)).cast("int"))
    return _place(grids.merged_by_gradient(strips), *KEY)


@query
def refine_regions(spark, d):
    joined = _unit(spark, d).withColumn("label", F.when(F.col("label").isin(1, 2), 0).otherwise(F.col("label")).cast("int"))
    return _place(grids.refined(joined, min_area=100), "image_id", "label", "root")


@query
def classify_regions(spark, d):
    found = grids.classified(_unit(spark, d), min_area=50)
    return found.select(*KEY, "area", micro(F.col("tex")).alias("tex"), micro(F.col("spread")).alias("spread"), "geo")


# ---- geometry -----------------------------------------------------------------------------------


@query
def shoelace_area(spark, d):
    return _micro(polylines.shoelace(rings(spark, d)), ["image_id"], "area")


@query
def corner_angles(spark, d):
    return _micro(polylines.corner_angles(rings(spark, d)), ["image_id", "seq"], "angle")


@query
def chord_param(spark, d):
    return _micro(polylines.chord_parameters(rings(spark, d)), ["image_id", "seq"], "u")


@query
def catmull_rom_controls(spark, d):
    return _micro(polylines.spline_controls(rings(spark, d)), ["image_id", "seq"], "c1x", "c1y", "c2x", "c2y")


@query
def profile_smoothing(spark, d):
    return _micro(polylines.moving_average(rings(spark, d), "x", 2), ["image_id", "seq"], "x_avg")


@query
def last_value_fill(spark, d):
    holes = rings(spark, d).withColumn("v", F.when(F.col("seq") % 3 == 0, F.col("x")))
    return _micro(polylines.filled_forward(holes, "v"), ["image_id", "seq"], "v")


@query
def neighbor_runs(spark, d):
    return polylines.runs(rings(spark, d).withColumn("v", (F.col("x") > 6).cast("int")), "v")


@query
def contours(spark, d):
    return grids.rings(fig(spark, d)).groupBy(*KEY, "ring").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"))


@query
def simplified_contours(spark, d):
    return grids.rings(fig(spark, d), tolerance=0.75).groupBy(*KEY, "ring").agg(F.count("*").alias("n"))


@query
def bezier_fit(spark, d):
    return grids.region_paths(fig(spark, d), "bezier")


@query
def catmull_rom_paths(spark, d):
    return grids.region_paths(fig(spark, d), "cr")


@query
def snapped_paths(spark, d):
    return grids.region_paths(_unit(spark, d), "bezier", snap="half")


@query
def skeleton_paths(spark, d):
    return grids.center_lines(fig(spark, d), 2)


@query
def streamlines(spark, d):
    return grids.streamlines(_unit(spark, d), 3, spacing=6.0, shortest=6.0).groupBy("image_id", "line").agg(F.count("*").alias("n"))


@query
def ribbons(spark, d):
    active = _unit(spark, d).withColumn("activity", F.lit(0.01))
    return grids.stroke_groups(active, coarse=(1.0, 3.0), spacing=6.0, shortest=6.0, least_pixels=200)


@query
def aa_bands(spark, d):
    return grids.edge_bands(_unit(spark, d))


@query
def aa_audit(spark, d):
    return grids.band_audit(_unit(spark, d).withColumn("root", F.when(F.col("label") == 3, 0).otherwise(F.col("label")).cast("int")))


@query
def edge_lines(spark, d):
    return grids.edge_lines(_unit(spark, d))


@query
def gradient_models(spark, d):
    return grids.gradient_models(_unit(spark, d)).select(*KEY, "kind", F.size("stops").alias("n_stops"), "gain")


@query
def detail_layer(spark, d):
    return grids.seams(_unit(spark, d))


@query
def shade_stack(spark, d):
    ramp = fig(spark, d).select("image_id", "y", "x", *((F.lit(90.0) + F.col("x") * k).alias(c) for c, k in zip(RGB, (1.5, 1.0, 0.5), strict=True)))
    flat = fit.scaled(ramp).withColumns({f"p_{c}": F.lit((90 + 24 * k) / 255) for c, k in zip(RGB, (1.5, 1.0, 0.5), strict=True)})
    return grids.shade_stack(flat, layers=4, radius=24.0, min_area=200).select("image_id", "seq", "cx", "cy", "r", "opacity", "gain")


# ---- text, documents ----------------------------------------------------------------------------


@query
def slim_number(spark, d):
    tenth = (F.col("q") - 128) / 64.0
    return px(spark, d).select("image_id", "y", "x", text.compact_column(tenth, F.lit(1)).alias("one"), text.compact_column(tenth, F.lit(2)).alias("two"))


@query
def fixed_number(spark, d):
    tenth = (F.col("q") - 128) / 64.0
    return px(spark, d).select("image_id", "y", "x", text.fixed_column(tenth, F.lit(1)).alias("one"), text.fixed_column(tenth, F.lit(3)).alias("three"))


@query
def human_sizes(spark, d):
    size = (F.col("area") * F.col("area") * (F.col("image_id") % 50 + 1)).cast("long")
    return regions.area(fig(spark, d)).select(*KEY, text.human_size(size).alias("size"))


@query
def slim_path(spark, d):
    return grids.region_paths(fig(spark, d), "cr").select(*KEY, text.slim_path_column("d", F.lit(0)).alias("d"))


def _rect_documents(spark, d) -> DataFrame:
    px_ = fig(spark, d)
    boxes = regions.bounding_boxes(px_).join(regions.median_color(px_), KEY).where("label > 0")
    fill = color.hex_color(*(F.col(c) / 255.0 for c in RGB))
    whole: list[Column] = [F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")]
    parts = boxes.select("image_id", F.lit("regions").alias("layer"), F.col("label").cast("long").alias("seq"), svg.rect(*whole, fill).alias("element"))
    size = px_.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return svg.documents(parts, size)


@query
def svg_document(spark, d):
    return _rect_documents(spark, d)


@query
def svg_layer_counts(spark, d):
    return svg.layer_counts(_rect_documents(spark, d))


@query
def svg_slim(spark, d):
    return svg.slimmed(_rect_documents(spark, d), packed=True).select("image_id", "svg", "valid", (F.hex(F.substring("svgz", 1, 3)) == "1F8B08").alias("packed"))


@query
def trace_documents(spark, d):
    p = params(scale=1.0, method="colors", kmeans_k=6, kmeans_iters=4, min_area=40, autoscale=False, contour_min_area=8.0, no_strokes=True)
    return trace.traced(_unit(spark, d).drop("label"), p).select("image_id", F.length("svg").alias("length"), "psnr")


@query
def mosaic_bands(spark, d):
    """Percentiles of four row bands of the mosaic, as regions of hundreds of pixels and more."""
    m = mx(spark, d)
    banded = m.select("image_id", "y", "x", F.expr("cast(y % 4 as int)").alias("label"), *(F.col("q").alias(c) for c in RGB))
    return _micro(regions.quantiles(banded, (0.05, 0.5)).where("channel = 'r'"), KEY, "p0", "p1")


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: area, box, mean and median colour of every region."""
    px_ = fig(spark, d)
    return regions.area(px_).join(regions.bounding_boxes(px_), KEY).join(regions.mean_color(px_), KEY).join(regions.median_color(px_).withColumnsRenamed({c: f"median_{c}" for c in RGB}), KEY)
