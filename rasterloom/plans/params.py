"""Options of a trace: fixed defaults, presets, and scaling for small images. Immutable."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    # fixed values: defaults of a trace, by stage
    scale: float = 4.0
    seed: int = 7
    autoscale: bool = True
    # structure tensor
    sigma_d: float = 1.0
    sigma_i: float = 2.5
    cs_sigma_d: float = 2.0
    cs_sigma_i: float = 12.0
    # segmentation
    method: str = "hybrid"
    seg: str = "full"
    flat_cov: float = 0.9
    flat_nb: int = 5
    flat_share: float = 0.0002
    flat_merge: float = 0.0
    edge_nms_hi: float = 0.97
    edge_nms_lo: float = 0.92
    edge_core: float = 3.0
    edge_close: int = 0
    edge_dsmooth: float = 0.6
    kmeans_k: int = 20
    kmeans_iters: int = 16
    pre_smooth: float = 1.6
    thresh: float = 12.0
    merge_thresh2: float = 10.0
    merge_passes: int = 4
    protect_sat: float = 0.0
    min_area: int = 600
    min_width: int = 0
    denoise: float = 0.0
    # colour seams
    detail_chroma: float = 12.0
    detail_scale: float = 1.0
    detail_min_area: int = 40
    # contours
    contour_tol: float = 0.75
    contour_smooth: float = 1.0
    contour_min_area: float = 30.0
    fit: str = "auto"
    fit_tol: float = 0.1
    corner_deg: float = 62.0
    auto_geo_frac: float = 0.5
    # drawn or painted
    tex_sigma: float = 2.5
    tex_smooth: float = 6.0
    tex_norm: float = 99.5
    tex_thr: float = 3.0
    range_thr: float = 0.02
    # snapping
    snap_mode: str = "refine"
    snap_sub: str = "half"
    snap_w: float = 3.0
    snap_sigma: float = 1.0
    snap_band: float = 3.0
    snap_shift: float = 1.5
    snap_step: float = 0.15
    # edge bands
    aa_levels: int = 0
    aa_width: float = 2.5
    aa_smooth: float = 0.8
    aa_min_radius: float = 1.4
    aa_min_area: int = 8
    aa_profile: str = "shape"
    aa_tol: float = 0.15
    aa_geo_thr: float = -1.0
    aa_synthetic: bool = False
    # gradients
    grad_stops: int = 10
    grad_min_gain: float = 0.12
    auto_gradient: bool = False
    grad_min_range: float = 0.004
    grad_radial: bool = True
    grad_radial_margin: float = 0.05
    merge_grad: bool = True
    merge_grad_tol: float = 0.05
    merge_grad_passes: int = 4
    # refinement
    adaptive_refine: bool = True
    refine_err: float = 0.02
    refine_min_area: int = 400
    refine_max_depth: int = 6
    refine_gain: float = 0.2
    refine_budget: int = 0
    # strokes
    no_strokes: bool = False
    spacing: float = 10.0
    occ_ratio: float = 0.45
    stroke_step: float = 3.0
    stroke_max: float = 120.0
    stroke_min: float = 24.0
    stroke_nodes: int = 12
    stroke_width: float = 7.5
    stroke_grid_units: bool = False
    stroke_alpha: float = 0.6
    stroke_jitter: float = 0.012
    stroke_activity_ref: float = 0.012
    stroke_alpha_min: float = 0.03
    coh_min: float = 0.12
    max_turn: float = 70.0
    # centre lines
    edge_mode: str = "off"
    edge_chroma: float = 9.0
    edge_hi: float = 0.975
    edge_lo: float = 0.9
    edge_coh: float = 0.45
    edge_width: float = 2.0
    edge_alpha: float = 0.9
    edge_min_area: int = 24
    edge_min_len: int = 8
    edge_tol: float = 0.6
    # shade layers
    shade_blobs: bool = False
    shade_layers: int = 48
    shade_cand: int = 8
    shade_stops: int = 4
    shade_halo: float = 6.0
    shade_radius: float = 0.0
    shade_min_area: int = 0
    shade_eps: tuple[float, ...] = (0.2, 0.35, 0.5)
    shade_tedge: float = 0.55
    shade_smooth_gtol: float = 2.5
    shade_smooth_ttol: float = 2.0
    shade_non_smooth: float = 0.35
    shade_gain: float = 0.0
    shade_margin: float = 28.0
    # output
    compress: str = "slim"
    gzip: bool = False


# fixed values: the side that defaults are made for, and the presets
REFERENCE_SIDE = 1254.0
PRESETS = {
    "logo": {"seg": "full", "no_strokes": True, "kmeans_k": 20, "min_area": 600, "contour_tol": 0.75, "contour_smooth": 1.0, "snap_mode": "refine", "snap_sub": "half", "fit": "auto", "fit_tol": 0.10, "aa_levels": 0, "grad_stops": 10, "detail_chroma": 12.0},
    "painting": {"seg": "full", "kmeans_k": 48, "thresh": 8.0, "merge_thresh2": 6.0, "merge_passes": 4, "min_area": 180, "min_width": 0, "contour_tol": 0.5, "contour_smooth": 1.3, "contour_min_area": 12.0, "grad_stops": 12, "grad_min_range": 0.003, "detail_chroma": 0.0, "spacing": 7.0, "stroke_width": 4.0, "stroke_alpha": 0.5, "stroke_nodes": 10, "stroke_min": 14.0, "stroke_max": 90.0, "coh_min": 0.10, "stroke_activity_ref": 0.02, "stroke_alpha_min": 0.02, "aa_levels": 0, "compress": "tight"},
}
_STROKE_LENGTHS = ("spacing", "stroke_min", "stroke_max", "stroke_width")
_LENGTHS = (*_STROKE_LENGTHS, "stroke_step", "contour_tol", "snap_band", "snap_sigma", "snap_shift", "edge_width", "edge_tol", "tex_sigma", "tex_smooth", "pre_smooth", "detail_scale", "aa_width", "aa_smooth", "aa_min_radius")
_AREAS = ("min_area", "detail_min_area", "edge_min_area", "edge_min_len", "contour_min_area", "aa_min_area")


def params(preset: str | None = None, **given) -> Params:
    """Defaults, then a preset, then what is given: explicit options win over presets."""
    unknown = set(given) - {f.name for f in fields(Params)}
    if unknown:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    return Params(**(PRESETS[preset] if preset else {}) | given)


def for_size(p: Params, width: int, height: int) -> Params:
    """Stroke lengths in grid units, and lengths and areas scaled down for images smaller than the reference side."""
    if p.scale != 1 and not p.stroke_grid_units:
        p = replace(p, **{n: getattr(p, n) * p.scale for n in _STROKE_LENGTHS})
    k = max(width, height) / REFERENCE_SIDE
    if not p.autoscale or k >= 1:
        return p
    return replace(p, **{n: getattr(p, n) * k for n in _LENGTHS}, **{n: max(1, round(getattr(p, n) * k * k)) for n in _AREAS})


# fixed values: mean absolute change of a 64 by 64 thumbnail above which an image counts as smooth, and what follows from it
PROBE, SMOOTH_AT = 64, 0.008
SMOOTH = {"grad_min_gain": 0.02, "merge_grad_tol": 0.3, "merge_grad_passes": 8, "aa_levels": 3, "refine_err": 0.008}


def for_smoothness(p: Params, change: float) -> Params:
    """Gates of an image by its thumbnail's mean change, if auto_gradient asks for it.

    Tolerances and passes only grow, the error gate only shrinks; bands are added only where gradients are and none are set.
    """
    if not p.auto_gradient or change <= SMOOTH_AT:
        return p
    levels = SMOOTH["aa_levels"] if p.aa_levels <= 0 and (p.grad_radial or p.merge_grad) else p.aa_levels
    error = min(p.refine_err, SMOOTH["refine_err"]) if p.adaptive_refine else p.refine_err
    return replace(p, grad_min_gain=SMOOTH["grad_min_gain"], merge_grad_tol=max(p.merge_grad_tol, SMOOTH["merge_grad_tol"]), merge_grad_passes=max(p.merge_grad_passes, SMOOTH["merge_grad_passes"]), aa_levels=levels, refine_err=error)
