"""Kernels per image: pixels (image_id, y, x, ...) in, pixels or records out.

groupBy(image_id).applyInArrow puts an image into one task, which bounds an image by a task's memory; images run in
parallel. Kernels that follow each other on the same planes run in one such call. Missing pixels count as 0.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rasterloom.kernels import conv, curves, masks, models, rims, segments, shades, strokes

Planes = dict[str, np.ndarray]


def _planes(table: pa.Table) -> tuple[Planes, np.ndarray, np.ndarray]:
    y, x = np.asarray(table.column("y")).astype(int), np.asarray(table.column("x")).astype(int)
    shape = (int(y.max()) + 1, int(x.max()) + 1)
    out = {}
    for name in table.column_names:
        if name not in ("image_id", "y", "x"):
            values = np.asarray(table.column(name))
            out[name] = np.zeros(shape, values.dtype)
            out[name][y, x] = values
    return out, y, x


def _arrow(schema: str) -> pa.Schema:
    """Parsed on the driver; tasks get the Arrow schema."""
    return to_arrow_schema(StructType.fromDDL(schema))


def per_pixel(px: DataFrame, of: Callable[[Planes], Planes], schema: str, columns: list[str]) -> DataFrame:
    """(image_id, y, x, new columns): `of` maps an image's planes to new planes, named as in schema."""
    whole = f"image_id long, y int, x int, {schema}"
    shape = _arrow(whole)

    def run(table: pa.Table) -> pa.Table:
        planes, y, x = _planes(table)
        made = of(planes)
        columns = [table.column("image_id").combine_chunks(), pa.array(y), pa.array(x), *(pa.array(made[n][y, x]) for n in shape.names[3:])]
        return pa.table([c.cast(k) for c, k in zip(columns, shape.types, strict=True)], schema=shape)

    return px.select("image_id", "y", "x", *columns).groupBy("image_id").applyInArrow(run, whole)


class Kernel(NamedTuple):
    """of maps an image's planes of these columns to records with the fields of schema."""

    of: Callable[[Planes], list[dict]]
    schema: str
    columns: list[str]


def per_image(px: DataFrame, of: Callable[[Planes], list[dict]], schema: str, columns: list[str]) -> DataFrame:
    """(image_id, record columns): `of` maps an image's planes to records."""
    whole = f"image_id long, {schema}"
    shape = _arrow(whole)

    def run(table: pa.Table) -> pa.Table:
        planes, _, _ = _planes(table)
        image = int(table.column("image_id")[0].as_py())
        return pa.Table.from_pylist([{"image_id": image} | {k: r[k] for k in shape.names[1:]} for r in of(planes)], schema=shape)

    return px.select("image_id", "y", "x", *columns).groupBy("image_id").applyInArrow(run, whole)


def together(px: DataFrame, **kernels: Kernel) -> DataFrame:
    """(image_id, a struct for each kernel): the records of several kernels in one pass; each row has one kernel's struct, the others are null."""

    def of(planes: Planes) -> list[dict]:
        nothing = dict.fromkeys(kernels)
        return [nothing | {name: record} for name, kernel in kernels.items() for record in kernel.of(planes)]

    schema = ", ".join(f"{name} struct<{StructType.fromDDL(kernel.schema).simpleString()[len('struct<') : -1]}>" for name, kernel in kernels.items())
    return per_image(px, of, schema, list(dict.fromkeys(c for kernel in kernels.values() for c in kernel.columns)))


def only(rows: DataFrame, name: str) -> DataFrame:
    """(image_id, record columns) of one kernel of together()."""
    return rows.where(rows[name].isNotNull()).select("image_id", f"{name}.*")


def _rgb(p: Planes) -> np.ndarray:
    return np.stack([p[c].astype(float) for c in "rgb"], axis=-1)


RGB = ["r", "g", "b"]


def blurred(px: DataFrame, value: str, sigma: float, mode: str = "reflect") -> DataFrame:
    return per_pixel(px, lambda p: {value: conv.gaussian(p[value], sigma, mode)}, f"{value} double", [value])


def tensor(px: DataFrame, sigma_d: float = 1.0, sigma_i: float = 2.5) -> DataFrame:
    """Structure tensor of channels in 0..1: l1, l2, coh, energy, luma, gx, gy, tx, ty."""
    return per_pixel(px, lambda p: conv.structure_tensor(_rgb(p), sigma_d, sigma_i), "l1 double, l2 double, coh double, energy double, luma double, gx double, gy double, tx double, ty double", RGB)


def texture(px: DataFrame, sigma: float = 2.5, smooth: float = 6.0) -> DataFrame:
    return per_pixel(px, lambda p: {"texture": conv.texture(_rgb(p) @ np.array([0.299, 0.587, 0.114]), sigma, smooth)}, "texture double", RGB)


def denoised(px: DataFrame, sigma_color: float) -> DataFrame:
    def of(p: Planes) -> Planes:
        out = conv.bilateral(_rgb(p), sigma_color)
        return {c: out[..., i] for i, c in enumerate("rgb")}

    return per_pixel(px, of, "r double, g double, b double", RGB)


def resized(px: DataFrame, scale: float) -> DataFrame:
    """Resampled images; rows are those of the new grid."""

    def of(p: Planes) -> list[dict]:
        out = conv.resized(_rgb(p), scale)
        return [{"y": y, "x": x, "r": r, "g": g, "b": b} for y, row in enumerate(out.tolist()) for x, (r, g, b) in enumerate(row)]

    return per_image(px, of, "y int, x int, r double, g double, b double", RGB)


def components(px: DataFrame, value: str = "label") -> DataFrame:
    """component: 8-connected parts of equal value, numbered from 0 in scan order."""
    return per_pixel(px, lambda p: {"component": masks.components(p[value])}, "component int", [value])


def hysteresis(px: DataFrame, value: str, low: float, high: float) -> DataFrame:
    return per_pixel(px, lambda p: {"kept": masks.hysteresis(p[value], low, high)}, "kept boolean", [value])


def morphology(px: DataFrame, label: int, step: str, times: int = 1) -> DataFrame:
    """kept: a region's mask after 'eroded', 'dilated', 'opened' or 'closed' with a cross."""
    of = {"eroded": masks.eroded, "dilated": masks.dilated, "opened": masks.opened, "closed": masks.closed}[step]
    return per_pixel(px, lambda p: {"kept": of(p["label"] == label, times)}, "kept boolean", ["label"])


def distances(px: DataFrame, label: int) -> DataFrame:
    """d: distance of each pixel to the nearest pixel of a label."""
    return per_pixel(px, lambda p: {"d": masks.distance(p["label"] == label)[0]}, "d double", ["label"])


def edges(px: DataFrame, high: float = 0.97, low: float = 0.92, **tensor_options) -> DataFrame:
    def of(p: Planes) -> Planes:
        t = conv.structure_tensor(_rgb(p), **tensor_options)
        return {"edge": segments.edge_map(t["energy"], t["gx"], t["gy"], high, low)}

    return per_pixel(px, of, "edge boolean", RGB)


def segmented(px: DataFrame, method: str = "colors", **options) -> DataFrame:
    """label by 'colors', 'flat' (falls back on colors), 'edges', 'watershed' or 'hybrid'; channels in 0..1."""

    def of(p: Planes) -> Planes:
        rgb = _rgb(p)
        if method == "flat":
            found = segments.by_flat_colors(rgb, **options)
            return {"label": segments.by_colors(rgb) if found is None else found}
        if method == "colors":
            return {"label": segments.by_colors(rgb, **options)}
        t = conv.structure_tensor(rgb)
        if method == "edges":
            return {"label": segments.by_edges(t["energy"], t["gx"], t["gy"], **options)}
        if method == "watershed":
            return {"label": segments.by_energy(t["energy"], **options)}
        return {"label": segments.hybrid(rgb, t, **options)[0]}

    return per_pixel(px, of, "label int", RGB)


def merged_similar(px: DataFrame, threshold: float, rounds: int = 4, protect: float = 0.0) -> DataFrame:
    """label after joining touching regions of similar mean colour; channels in 0..255."""
    return per_pixel(px, lambda p: {"label": segments.merge_similar(p["label"], _rgb(p), threshold, rounds, protect)}, "label int", ["label", *RGB])


def merged_small(px: DataFrame, min_area: int, **options) -> DataFrame:
    return per_pixel(px, lambda p: {"label": segments.merge_small(p["label"], min_area, _rgb(p), **options)}, "label int", ["label", *RGB])


def merged_by_gradient(px: DataFrame, tolerance: float = 0.05, rounds: int = 4) -> DataFrame:
    return per_pixel(px, lambda p: {"label": models.merge_by_gradient(p["label"], _rgb(p), tolerance, rounds)}, "label int", ["label", *RGB])


def refined(px: DataFrame, **options) -> DataFrame:
    """label and root after refinement; channels in 0..1."""

    def of(p: Planes) -> Planes:
        labels, root = models.refine(p["label"], _rgb(p), **options)
        return {"label": labels, "root": np.array([root[i] for i in range(len(root))])[labels]}

    return per_pixel(px, of, "label int, root int", ["label", *RGB])


def classified(px: DataFrame, **options) -> DataFrame:
    """(image_id, label, area, tex, spread, geo) of labelled pixels with channels in 0..1."""

    def of(p: Planes) -> list[dict]:
        rgb = _rgb(p)
        found = segments.classified(p["label"], rgb @ np.array([0.299, 0.587, 0.114]), rgb, **options)
        return [{"label": i, "area": int(found["area"][i]), "tex": float(found["tex"][i]), "spread": float(found["spread"][i]), "geo": bool(found["geo"][i])} for i in np.flatnonzero(found["area"]).tolist()]

    return per_image(px, of, "label int, area long, tex double, spread double, geo boolean", ["label", *RGB])


def rings(px: DataFrame, smooth: float = 1.0, least_area: float = 30.0, tolerance: float | None = None) -> DataFrame:
    """(image_id, label, ring, seq, x, y): contours of every region, simplified if a tolerance is given."""

    def of(p: Planes) -> list[dict]:
        out = []
        for own in segments.windows(p["label"]):
            for k, ring in enumerate(curves.mask_rings(own.mask, smooth, least_area, (own.x0, own.y0))):
                line = ring if tolerance is None else curves.simplified(ring, tolerance)
                out += [{"label": own.label, "ring": k, "seq": s, "x": float(x), "y": float(y)} for s, (x, y) in enumerate(line)]
        return out

    return per_image(px, of, "label int, ring int, seq int, x double, y double", ["label"])


def region_paths(px: DataFrame, fit: str = "bezier", grow: int = 1, snap: str | None = None, **options) -> DataFrame:
    """(image_id, label, d, moved): path data of every region grown by a pixel; regions without a path are left out.

    snap 'half' or 'peak' moves contour points onto the luminance edge first (channels in 0..1).
    """

    def of(p: Planes) -> list[dict]:
        out, luma, energy = [], None, None
        if snap:
            t = conv.structure_tensor(_rgb(p), 1.0, 1.0)
            luma, energy = t["luma"], t["energy"]
        for own in segments.windows(p["label"], grow):
            moved = [0]

            def move(ring: np.ndarray, moved=moved) -> np.ndarray:
                ring, n = curves.snapped(ring, luma, energy, mode=snap)
                moved[0] += n
                return ring

            d = curves.region_path(masks.dilated(own.mask, grow), fit, offset=(own.x0, own.y0), snap=move if snap else None, **options)
            if d:
                out.append({"label": own.label, "d": d, "moved": moved[0]})
        return out

    return per_image(px, of, "label int, d string, moved int", ["label", *(RGB if snap else [])])


def center_lines(px: DataFrame, label: int, least: int = 8, tolerance: float = 0.6) -> DataFrame:
    """(image_id, line, seq, x, y): skeleton paths of a region, simplified."""

    def of(p: Planes) -> list[dict]:
        lines = masks.skeleton_paths(masks.thinned(p["label"] == label), least)
        return [{"line": k, "seq": s, "x": float(x), "y": float(y)} for k, line in enumerate(lines) for s, (x, y) in enumerate(curves.simplified(line, tolerance))]

    return per_image(px, of, "line int, seq int, x double, y double", ["label"])


def stroke_groups(px: DataFrame, seed: int = 7, coarse: tuple[float, float] = (2.0, 12.0), **options) -> DataFrame:
    """(image_id, label, seq, d, r, g, b, alpha): strokes of every region but the background; px has activity, channels in 0..1."""

    def of(p: Planes) -> list[dict]:
        rgb = _rgb(p)
        t = conv.structure_tensor(rgb, *coarse)
        edge = np.concatenate((p["label"][0], p["label"][-1], p["label"][:, 0], p["label"][:, -1]))
        ground = int(np.bincount(edge).argmax())
        out = []
        sizes = np.bincount(p["label"].ravel())
        for i in np.flatnonzero(sizes >= options.get("least_pixels", 1)).tolist():
            if i != ground:
                for s, (d, c, a) in enumerate(strokes.region_strokes(p["label"] == i, rgb, t, p["activity"], i, seed, **options)):
                    out.append({"label": i, "seq": s, "d": d, "r": float(c[0]), "g": float(c[1]), "b": float(c[2]), "alpha": float(a)})
        return out

    return per_image(px, of, "label int, seq int, d string, r double, g double, b double, alpha double", ["label", "activity", *RGB])


def streamlines(px: DataFrame, label: int, seed: int = 7, **options) -> DataFrame:
    """(image_id, line, seq, x, y): evenly spaced lines along the tangents within a region."""

    def of(p: Planes) -> list[dict]:
        found = strokes.streamlines(p["label"] == label, conv.structure_tensor(_rgb(p), 2.0, 4.0), seed, **options)
        return [{"line": k, "seq": s, "x": float(x), "y": float(y)} for k, line in enumerate(found) for s, (x, y) in enumerate(line)]

    return per_image(px, of, "line int, seq int, x double, y double", ["label", *RGB])


def _rims(p: Planes, levels: int, width: float, quantile: float, **options) -> tuple[list[dict], list[dict]]:
    rgb = _rgb(p)
    t = conv.structure_tensor(rgb)
    label = p["label"]
    return rims.rims(label, rgb, p.get("geo", np.ones(label.shape, bool)), p.get("root", label), t, levels, width, float(np.quantile(t["energy"], quantile)), **options)


def edge_bands(px: DataFrame, levels: int = 2, width: float = 2.5, quantile: float = 0.97, options_of: Callable[[np.ndarray], dict] | None = None, **options) -> DataFrame:
    """(image_id, label, neighbor, level, area, r, g, b, d): transition bands inside the rims of drawn regions, with their paths.

    px may have geo (drawn pixels; else all are) and root (else every region is its own); channels in 0..1. options_of may
    give an image's own levels, width and options; no levels, no bands.
    """

    def of(p: Planes) -> list[dict]:
        own = {"levels": levels, "width": width, "quantile": quantile} | options | (options_of(_rgb(p)) if options_of else {})
        if own["levels"] <= 0:
            return []
        return [{k: f[k] for k in ("label", "neighbor", "level", "area", "d")} | {c: float(v) for c, v in zip("rgb", f["color"], strict=True)} for f in _rims(p, **own)[0]]

    given = [c for c in ("geo", "root") if c in px.columns]
    return per_image(px, of, "label int, neighbor int, level int, area double, r double, g double, b double, d string", ["label", *RGB, *given])


def band_audit(px: DataFrame, levels: int = 2, width: float = 2.5, quantile: float = 0.97, **options) -> DataFrame:
    """(image_id, label, neighbor, points, ring, synthetic): every stretch of a rim that edge_bands looks at."""
    given = [c for c in ("geo", "root") if c in px.columns]
    return per_image(px, lambda p: _rims(p, levels, width, quantile, **options)[1], "label int, neighbor int, points int, ring int, synthetic boolean", ["label", *RGB, *given])


def edge_lines(px: DataFrame, mode: str = "both", chroma: float = 9.0, high: float = 0.975, low: float = 0.9, coherence: float = 0.45, width: float = 2.0, least_area: int = 24, least_length: int = 8, tolerance: float = 0.6) -> DataFrame:
    """(image_id, line, d, r, g, b, width): centre lines of colourful or strong edges outside the background; channels in 0..1."""

    def of(p: Planes) -> list[dict]:
        rgb = _rgb(p)
        t = conv.structure_tensor(rgb)
        of_lab = conv.lab(rgb)
        colour = conv.gaussian(np.hypot(of_lab[..., 1], of_lab[..., 2]), 1.0)
        mask = np.zeros(colour.shape, bool)
        if mode in ("chroma", "both"):
            mask |= colour > chroma
        if mode in ("energy", "both"):
            mask |= masks.hysteresis(t["energy"], *np.quantile(t["energy"], (low, high))) & (t["coh"] > coherence)
        edge = np.concatenate((p["label"][0], p["label"][-1], p["label"][:, 0], p["label"][:, -1]))
        mask &= p["label"] != int(np.bincount(edge).argmax())
        own = masks.components(mask.astype(int), mask)
        large = np.flatnonzero(np.bincount(own[mask], minlength=1) >= least_area)
        lines = masks.skeleton_paths(masks.thinned(mask & np.isin(own, large)), least_length)
        out = []
        for k, line in enumerate(lines):
            under = np.median(conv.bilinear(rgb, line[:, 0], line[:, 1]), axis=0)
            strength = float(np.median(conv.bilinear(t["coh"], line[:, 0], line[:, 1])))
            points = curves.simplified(line, tolerance)
            d = "M" + "L".join(f"{curves.fixed(x)} {curves.fixed(y)}" for x, y in points)
            out.append({"line": k, "d": d, **{c: float(v) for c, v in zip("rgb", under, strict=True)}, "width": width * (0.5 + 0.5 * strength)})
        return out

    return per_image(px, of, "line int, d string, r double, g double, b double, width double", ["label", *RGB])


def gradient_kernel(min_gain: float = 0.12, min_range: float = 0.004, margin: float = 0.05, gain_of: Callable[[np.ndarray], float] | None = None) -> Kernel:
    """(label, kind, cx, cy, ux, uy, lo, hi, stops, range, gain): chosen ramps of all regions in one pass.

    The same columns as operators.fit.fit_gradients; one shuffle by image in place of its aggregations. gain_of may give
    an image's own min_gain.
    """

    def of(p: Planes) -> list[dict]:
        rgb = _rgb(p)
        least = gain_of(rgb) if gain_of else min_gain
        gy, gx = np.gradient(rgb @ np.array([0.299, 0.587, 0.114])) if min(rgb.shape[:2]) > 1 else (np.zeros(rgb.shape[:2]),) * 2
        out = []
        for i, _, _, _, ys, xs in segments.windows(p["label"]):
            a, b = gx[ys, xs], gy[ys, xs]
            m = models.fit(ys, xs, rgb[ys, xs], a, b, a * a + b * b, least, min_range, margin)
            if m:
                u = m.get("u", (None, None))
                stops = [{"offset": float(o), **{c: float(v) for c, v in zip("rgb", row, strict=True)}} for o, row in zip(m["offsets"], m["values"], strict=True)]
                out.append({"label": i, "kind": "radial" if m["radial"] else "linear", "cx": float(m["cx"]), "cy": float(m["cy"]), "ux": None if u[0] is None else float(u[0]), "uy": None if u[1] is None else float(u[1]), "lo": float(m["lo"]), "hi": float(m["hi"]), "stops": stops, "range": m["range"], "gain": m["gain"]})
        return out

    return Kernel(of, "label int, kind string, cx double, cy double, ux double, uy double, lo double, hi double, stops array<struct<offset:double,r:double,g:double,b:double>>, range double, gain double", ["label", *RGB])


def gradient_models(px: DataFrame, *options, **more) -> DataFrame:
    """image_id and the records of gradient_kernel()."""
    return per_image(px, *gradient_kernel(*options, **more))


def seam_kernel(chroma: float = 12.0, scale: float = 1.0, least: int = 40) -> Kernel:
    """(component, area, r, g, b, d): colourful seams as a layer of their own; channels in 0..1."""

    def of(p: Planes) -> list[dict]:
        rgb = _rgb(p)
        of_lab = conv.lab(rgb)
        mask = masks.closed(conv.gaussian(np.hypot(of_lab[..., 1], of_lab[..., 2]), scale) > chroma, 1, masks.RING8)
        own = masks.components(mask.astype(int), mask)
        out = []
        for part in segments.windows(own):
            if len(part.ys) >= least and (d := curves.region_path(part.mask, "cr", 0.6, 0.375, offset=(part.x0, part.y0))):
                out.append({"component": part.label, "area": len(part.ys), **{c: float(v) for c, v in zip("rgb", np.median(rgb[part.ys, part.xs], axis=0), strict=True)}, "d": d})
        return out

    return Kernel(of, "component int, area long, r double, g double, b double, d string", RGB)


def seams(px: DataFrame, *options, **more) -> DataFrame:
    """image_id and the records of seam_kernel()."""
    return per_image(px, *seam_kernel(*options, **more))


def shade_stack(px: DataFrame, **options) -> DataFrame:
    """(image_id, seq, cx, cy, r, opacity, edge, stops, gain): shade layers over what is drawn (p_r, p_g, p_b) of r, g, b in 0..1.

    stops are colours (0..1) at even shares of the radius.
    """

    def of(p: Planes) -> list[dict]:
        source = _rgb(p) * 255
        drawn = np.stack([p[f"p_{c}"].astype(float) for c in "rgb"], axis=-1) * 255
        found, _ = shades.shade_layers(source, drawn, shades.Options(**options))
        return [{"seq": k} | f | {"stops": [dict(zip("rgb", (c / 255).tolist(), strict=True)) for c in f["colors"]]} for k, f in enumerate(found)]

    return per_image(px, of, "seq int, cx double, cy double, r double, opacity double, edge double, stops array<struct<r:double,g:double,b:double>>, gain double", [*RGB, *(f"p_{c}" for c in "rgb")])
