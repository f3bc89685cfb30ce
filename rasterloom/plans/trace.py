"""From pixels to documents: segmentation, models, paths, strokes and assembly as one composition of DataFrames.

Pixel-heavy sequential steps run once per image in one kernel call; region statistics, fits, residuals and assembly are
aggregations and joins. Tables that several branches read are kept: as Parquet in the cluster's shared folder
(spark.checkpoint.dir), or in Spark's cache where none is named.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.color import hex_color
from rasterloom.functions.text import gzip_column, slim_document_column
from rasterloom.kernels import conv, curves, masks, models, segments
from rasterloom.operators import fit, grids, quality, regions, svg
from rasterloom.plans.params import PROBE, Params, for_size, for_smoothness, params
from rasterloom.sources.images import kept


def own_params(p: Params, rgb: np.ndarray) -> Params:
    """An image's options: by its size, and by its smoothness if asked for."""
    p = for_size(p, rgb.shape[1], rgb.shape[0])
    return for_smoothness(p, conv.thumbnail_change(rgb, PROBE)) if p.auto_gradient else p


def _label_planes(rgb: np.ndarray, p: Params) -> dict[str, np.ndarray]:
    """label, root, geo, core and inner planes of one image by the chosen method, merged and refined.

    core and inner are the pixels whose colours stand for their region: three steps, one step from another label.
    """
    p = own_params(p, rgb)
    if p.denoise > 0:
        rgb = conv.bilateral(rgb, p.denoise)
    labels = segments.by_flat_colors(rgb, p.flat_nb, p.flat_share, p.flat_cov, p.flat_merge, 0.0, p.thresh) if p.seg in ("auto", "flat") else None
    if labels is None:
        colors = {"k": p.kmeans_k, "rounds": p.kmeans_iters, "smooth": p.pre_smooth, "threshold": p.thresh, "second": p.merge_thresh2, "passes": p.merge_passes, "protect": p.protect_sat, "seed": p.seed}
        t = conv.structure_tensor(rgb, p.sigma_d, p.sigma_i) if p.method in ("edges", "watershed", "hybrid") else {}
        if p.method == "edges":
            labels = segments.by_edges(t["energy"], t["gx"], t["gy"], p.edge_core, p.edge_close, p.edge_dsmooth, high=p.edge_nms_hi, low=p.edge_nms_lo)
        elif p.method == "watershed":
            labels = segments.by_energy(t["energy"])
        elif p.method == "hybrid":
            labels = segments.hybrid(rgb, t, p.snap_band, p.snap_mode, **colors)[0]
        else:
            labels = segments.by_colors(rgb, **colors)
    labels = segments.merge_small(labels, p.min_area, rgb * 255, p.protect_sat, 8, p.min_width)
    if p.merge_grad:
        labels = models.merge_by_gradient(labels, rgb, p.merge_grad_tol, p.merge_grad_passes)
    geo = segments.classified(labels, conv.luma(rgb), rgb, p.min_area, p.tex_thr, p.range_thr, p.tex_norm)["geo"][labels]
    root = np.arange(labels.max() + 1)
    if p.adaptive_refine:
        labels, lineage = models.refine(labels, rgb, p.refine_err, p.refine_min_area, p.refine_max_depth, p.refine_gain, p.refine_budget)
        root = np.array([lineage[i] for i in range(len(lineage))])
    return {"label": labels, "root": root[labels], "geo": geo, "core": segments.cores(labels, 3), "inner": segments.cores(labels, 1)}


def labelled(px: DataFrame, p: Params) -> DataFrame:
    """px (channels in 0..1) with label, root, geo, core and inner."""

    def of(planes: grids.Planes) -> grids.Planes:
        return {c: planes[c] for c in "rgb"} | _label_planes(np.stack([planes[c] for c in "rgb"], axis=-1), p)

    return grids.per_pixel(px, of, "r double, g double, b double, label int, root int, geo boolean, core boolean, inner boolean", ["r", "g", "b"])


def path_kernel(p: Params) -> grids.Kernel:
    """(label, d, moved): each region's path, its fit by its share of drawn pixels, snapped if asked for."""

    def of(planes: grids.Planes) -> list[dict]:
        own = for_size(p, planes["label"].shape[1], planes["label"].shape[0])
        t = conv.structure_tensor(np.stack([planes[c] for c in "rgb"], axis=-1), own.snap_sigma, own.snap_sigma) if own.snap_mode == "refine" else {}
        kinds: dict[str, list[tuple[int, int, np.ndarray]]] = {"bezier": [], "cr": []}
        moved: dict[int, int] = {}
        for part in segments.windows(planes["label"], 1):
            geo = planes["geo"][part.ys, part.xs].mean() >= own.auto_geo_frac
            kind = ("bezier" if geo else "cr") if own.fit == "auto" else own.fit
            moved[part.label] = 0
            for k, ring in enumerate(curves.mask_rings(masks.dilated(part.mask), own.contour_smooth, own.contour_min_area, (part.x0, part.y0))):
                if geo and t:
                    ring, n = curves.snapped(ring, t["luma"], t["energy"], own.snap_w, own.snap_step, own.snap_shift, mode=own.snap_sub)
                    moved[part.label] += n
                kinds["bezier" if kind == "bezier" else "cr"].append((part.label, k, ring))
        drawn: dict[int, dict[int, str]] = {}
        for kind, rings in kinds.items():  # all rings of an image at once
            for (label, k, _), d in zip(rings, curves.ring_paths([r for _, _, r in rings], kind, own.contour_tol, own.fit_tol), strict=True):
                drawn.setdefault(label, {})[k] = d
        paths = {label: "".join(d[k] for k in sorted(d)) for label, d in drawn.items()}
        return [{"label": label, "d": paths[label], "moved": n} for label, n in moved.items() if paths.get(label)]

    return grids.Kernel(of, "label int, d string, moved int", ["label", "geo", "r", "g", "b"])


def region_paths(px: DataFrame, p: Params) -> DataFrame:
    """image_id and the records of path_kernel()."""
    return grids.per_image(px, *path_kernel(p))


def model_kernel(p: Params) -> grids.Kernel:
    """The chosen gradients."""
    return grids.gradient_kernel(p.grad_min_gain, p.grad_min_range, p.grad_radial_margin, lambda rgb: own_params(p, rgb).grad_min_gain)


def region_models(px: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(fills, fits): flat colours by core medians, and the chosen gradients."""
    return regions.fill_color(px, px.where("core")), grids.per_image(px, *model_kernel(p))


def rim_options(p: Params, rgb: np.ndarray) -> dict:
    """Options of an image's transition bands."""
    own = own_params(p, rgb)
    least_geo = own.auto_geo_frac if own.aa_geo_thr < 0 else own.aa_geo_thr
    return {"levels": own.aa_levels, "width": own.aa_width, "quantile": own.edge_nms_hi, "profile": own.aa_profile, "least_geo": least_geo, "least_radius": own.aa_min_radius, "least_points": own.aa_min_area, "tolerance": own.aa_tol, "degrees": own.corner_deg, "synthetic": own.aa_synthetic, "smooth": own.contour_smooth, "least_area": own.contour_min_area}


def _parts(df: DataFrame, layer: str, seq: Column, element: Column, definition: Column | None = None, kind: int = 0, sub: Column | None = None) -> DataFrame:
    """Elements of a layer in order of kind, seq and sub."""
    last = F.lit(0) if sub is None else sub
    return df.select("image_id", F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), seq.cast("long").alias("seq"), last.cast("long").alias("sub"), element.alias("element"), (F.lit(None).cast("string") if definition is None else definition).alias("def"))


def traced(px: DataFrame, p: Params | None = None, cut=kept) -> DataFrame:
    """(image_id, svg[, svgz], psnr): documents of images given as pixels with channels in 0..1.

    cut(df, name) keeps a table that several branches read.
    """
    p = p or params(scale=1.0)
    px = cut(labelled(px, p), "labels")
    fills = cut(regions.fill_color(px, px.where("core")), "fills")
    kernels = {"paths": path_kernel(p), "fits": model_kernel(p)}
    if p.detail_chroma > 0:
        kernels["seams"] = grids.seam_kernel(p.detail_chroma, p.detail_scale, p.detail_min_area)
    made = cut(grids.together(px, **kernels), "shapes")
    fits = grids.only(made, "fits")
    ground = regions.background(px).select("image_id", F.col("label").alias("ground"))
    predicted = fit.residuals(fit.predict(px, fills, fits))
    if not p.no_strokes or p.shade_blobs:
        predicted = cut(predicted, "residuals")
    order = regions.ordered(px).select("image_id", "label", "rank")
    size = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    id_ = F.concat(F.lit("g"), F.col("label").cast("string"))
    colour = hex_color(F.col("r"), F.col("g"), F.col("b"))
    paths = regions.matched(regions.matched(grids.only(made, "paths"), fills), order)
    shapes = regions.matched(regions.matched(paths, fits, how="left"), ground, "image_id").where("label <> ground")
    fill = F.when(F.col("stops").isNotNull(), F.concat(F.lit("url(#"), id_, F.lit(")"))).otherwise(colour)
    sloped = F.col("stops").isNotNull()
    parts = _parts(shapes, "regions", F.col("rank"), svg.path(F.col("d"), fill), F.when(sloped, svg.gradient_def(id_)))
    if p.aa_levels > 0 or p.auto_gradient:
        rims = grids.edge_bands(px, options_of=lambda rgb: rim_options(p, rgb)).where("d <> ''")
        parts = parts.unionByName(_parts(rims, "regions", F.col("label"), svg.path(F.col("d"), colour), kind=1, sub=F.col("neighbor") * 64 + F.col("level")))
    if p.detail_chroma > 0:
        parts = parts.unionByName(_parts(grids.only(made, "seams"), "regions", F.col("component"), svg.path(F.col("d"), colour), kind=2))
    if not p.no_strokes:
        active = quality.activity(predicted.where("inner"))
        with_activity = regions.matched(px, active, how="left").withColumn("activity", F.coalesce("activity", F.lit(0.0)))
        options = {"alpha": p.stroke_alpha, "reference": p.stroke_activity_ref, "least_alpha": p.stroke_alpha_min, "width": p.stroke_width, "spacing": p.spacing, "ratio": p.occ_ratio, "step": p.stroke_step, "longest": p.stroke_max, "shortest": p.stroke_min, "nodes": p.stroke_nodes, "least_coh": p.coh_min, "most_turn": p.max_turn}
        lines = grids.stroke_groups(with_activity, p.seed, (p.cs_sigma_d, p.cs_sigma_i), **options)
        drawn = F.concat(F.lit('<path d="'), F.col("d"), F.lit('" fill="'), colour, F.lit('" fill-opacity="'), F.format_string("%.2f", "alpha"), F.lit('"/>'))
        parts = parts.unionByName(_parts(lines, "strokes", F.col("label"), drawn, sub=F.col("seq")))
    if p.edge_mode != "off":
        found = grids.edge_lines(px, p.edge_mode, p.edge_chroma, p.edge_hi, p.edge_lo, p.edge_coh, p.edge_width, p.edge_min_area, p.edge_min_len, p.edge_tol)
        parts = parts.unionByName(_parts(found, "edges", F.col("line"), svg.line(F.col("d"), colour, F.col("width"), p.edge_alpha)))
    if p.shade_blobs:
        options = {"layers": p.shade_layers, "stops": p.shade_stops, "opacities": p.shade_eps, "edge": p.shade_tedge, "radius": p.shade_radius, "min_area": p.shade_min_area, "slope": p.shade_smooth_gtol, "texture": p.shade_smooth_ttol, "rough": p.shade_non_smooth, "halo": p.shade_halo, "gain": p.shade_gain, "candidates": p.shade_cand, "margin": p.shade_margin}
        shaded = regions.matched(grids.shade_stack(predicted, **options), size, "image_id")
        name = F.concat(F.lit("s"), F.col("seq").cast("string"))
        parts = parts.unionByName(_parts(shaded, "shade", F.col("seq"), svg.shade_rect(name, F.col("w"), F.col("h")), svg.shade_def(name)))
    canvas = regions.matched(size, ground, "image_id")
    canvas = regions.matched(canvas, fills.select("image_id", F.col("label").alias("ground"), colour.alias("background")), ["image_id", "ground"])
    docs = svg.documents(parts, canvas.select("image_id", "w", "h", "background"))
    if p.compress != "off":
        tight = p.compress == "tight"
        docs = docs.withColumn("svg", slim_document_column("svg", F.lit(0 if tight else 1), F.lit(0 if tight else 1), F.lit(tight)))
    if p.gzip:
        docs = docs.withColumn("svgz", gzip_column("svg"))
    return regions.matched(docs, quality.psnr(predicted).select("image_id", "psnr"), "image_id")
