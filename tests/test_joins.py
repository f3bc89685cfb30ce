"""Queries of figures neither broadcast pixels nor deal them anew, whatever size Spark takes them for."""

import pytest

from rasterloom.operators import fit
from rasterloom.plans import catalogue
from rasterloom.plans.params import params
from rasterloom.plans.trace import traced
from rasterloom.sources.relations import fig

from .conftest import SMALL

#: Pixels of these queries meet regions, images or other pixels.
QUERIES = [
    "activity_residual",
    "adjacency_color_distance",
    "adjacency_pairs",
    "background_label",
    "border_pixels",
    "dense_relabel",
    "dilation",
    "error_split_axis",
    "fill_predict",
    "fill_residual",
    "fill_stats",
    "fit_select",
    "interior_mae",
    "palette_lookup",
    "psnr_mae",
    "radial_bins",
    "ramp_bins",
    "ramp_gain",
    "refine_accept",
    "refine_trigger",
    "region_boundary_pixels",
    "regroup_models",
    "weighted_median_cut",
]


@pytest.mark.parametrize("name", QUERIES)
def test_no_broadcast(spark, name):
    plan = catalogue.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_figures_are_dealt(spark):
    """The keys of a small file become pixels in several tasks, each image in one."""
    tasks = fig(spark, SMALL).select("image_id").rdd.glom().map(lambda rows: {r["image_id"] for r in rows}).collect()
    assert len([t for t in tasks if t]) > 1 and sum(map(len, tasks)) == len(set().union(*tasks))


def test_trace_broadcasts_no_pixels(spark):
    """Kept pixels are small files, yet their joins with regions and images are not broadcasts."""
    px = fit.scaled(fig(spark, SMALL)).drop("label")
    p = params(scale=1.0, method="colors", kmeans_k=6, kmeans_iters=4, min_area=40, autoscale=False, contour_min_area=8.0, no_strokes=True)
    seen = []
    docs = traced(px, p, lambda df, name: (seen.append(df), df)[1])
    assert all("Broadcast" not in df._jdf.queryExecution().executedPlan().toString() for df in (*seen, docs))


def test_trace_passes_over_labelled_pixels_once(spark):
    """Paths, models and seams come from one grouping of an image's pixels, after that of its labels."""
    px = fit.scaled(fig(spark, SMALL)).drop("label")
    p = params(scale=1.0, method="colors", kmeans_k=6, kmeans_iters=4, min_area=40, autoscale=False, contour_min_area=8.0, no_strokes=True)
    seen = {}

    def cut(df, name):
        seen[name] = df._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow ")
        return spark.createDataFrame([], df.schema)

    docs = traced(px, p, cut)
    assert {n for n, k in seen.items() if k} == {"labels", "shapes"}
    assert "FlatMapGroupsInArrow" not in docs._jdf.queryExecution().executedPlan().toString()
