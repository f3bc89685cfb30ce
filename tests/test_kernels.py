import numpy as np
import pytest

from rasterloom.functions import text
from rasterloom.kernels import conv, curves, masks, models, rims, segments, shades, strokes


def test_taps_and_boundaries():
    assert len(conv.taps(1.0)) == 9 and abs(conv.taps(2.5).sum() - 1) < 1e-12
    flat = np.full((5, 7), 3.0)
    for mode in ("nearest", "reflect"):
        assert np.allclose(conv.gaussian(flat, 1.5, mode), flat)
    plane = np.arange(9.0)[None].repeat(3, 0)
    wide = np.pad(plane[0], 4, mode="symmetric")
    assert np.allclose(conv.along(plane, conv.taps(1.0), 1, "reflect")[0], [wide[i : i + 9] @ conv.taps(1.0) for i in range(9)])


def test_tensor_of_a_vertical_edge():
    rgb = np.zeros((11, 9, 3))
    rgb[:, 5:] = 1
    t = conv.structure_tensor(rgb, 1.0, 2.0)
    assert abs(abs(t["gx"][5, 4]) - 1) < 1e-9 and abs(t["ty"][5, 4]) > 0.99 and t["coh"][5, 4] > 0.99
    flat = conv.structure_tensor(np.ones((4, 4, 3)))
    assert np.allclose(flat["gx"], 0) and np.allclose(flat["l1"], 0)


def brute_components(values, mask):
    out, n = np.full(values.shape, -1), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start] >= 0:
            continue
        todo = [start]
        out[start] = n
        while todo:
            y, x = todo.pop()
            for dy, dx in masks.RING8:
                p = (y + dy, x + dx)
                if 0 <= p[0] < values.shape[0] and 0 <= p[1] < values.shape[1] and mask[p] and out[p] < 0 and values[p] == values[start]:
                    out[p] = n
                    todo.append(p)
        n += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_components(seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 3, (13, 17))
    mask = rng.random((13, 17)) < 0.8
    assert np.array_equal(masks.components(values, mask), brute_components(values, mask))
    assert np.array_equal(masks.components(values), brute_components(values, np.ones_like(mask)))


@pytest.mark.parametrize("seed", range(4))
def test_distance(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((12, 15)) < 0.07
    mask[0, 0] = True
    d, y, x = masks.distance(mask)
    ys, xs = np.nonzero(mask)
    gy, gx = np.mgrid[:12, :15]
    want = np.sqrt((gy[..., None] - ys) ** 2 + (gx[..., None] - xs) ** 2).min(axis=2)
    assert np.allclose(d, want) and mask[y, x].all() and np.allclose(np.hypot(gy - y, gx - x), want)
    assert not np.isfinite(masks.distance(np.zeros((3, 3), bool))[0]).any()


def test_morphology():
    mask = np.zeros((7, 7), bool)
    mask[1:6, 1:6] = True
    assert masks.eroded(mask).sum() == 9 and masks.dilated(masks.eroded(mask)).sum() == 21
    assert masks.closed(mask).sum() == 25 and masks.eroded(np.ones((3, 3), bool)).sum() == 1  # outside counts as empty
    assert masks.hysteresis(np.array([[0, 2, 5, 0, 2]]), 1, 4).tolist() == [[False, True, True, False, False]]


def test_watershed_and_thinning():
    elevation = np.abs(np.arange(9) - 4)[None].repeat(3, 0) * -1.0
    markers = np.zeros((3, 9), int)
    markers[1, 0], markers[1, 8] = 1, 2
    flooded = masks.watershed(elevation, markers)
    assert (flooded > 0).all() and set(flooded[:, 0]) == {1} and set(flooded[:, 8]) == {2}
    bar = np.zeros((9, 30), bool)
    bar[3:6, 2:28] = True
    thin = masks.thinned(bar)
    assert thin.sum() < 30 and thin[4, 10:20].all()
    (path,) = masks.skeleton_paths(thin)
    assert len(path) > 18


@pytest.mark.parametrize("shape", [(1, 1), (2, 1), (1, 2), (2, 2), (3, 3), (16, 16)])
def test_one_colour_is_one_region(shape):
    rgb = np.full((*shape, 3), 0.5)
    assert segments.by_colors(rgb, 20, 4).max() == 0
    assert segments.merge_small(np.zeros(shape, int), 600).max() == 0


def test_bands_and_disc_survive():
    bands = np.zeros((16, 16, 3))
    bands[:, 8:] = (1, 0.2, 0.1)
    assert segments.by_colors(bands, 20, 6, smooth=0.5).max() == 1
    y, x = np.mgrid[:64, :64]
    disc = np.where(((y - 32) ** 2 + (x - 32) ** 2 <= 400)[..., None], 0.0, 1.0) * np.ones(3)
    labels = segments.by_flat_colors(disc)
    assert labels is not None and labels.max() == 1
    assert segments.by_flat_colors(np.random.default_rng(0).random((64, 64, 3))) is None


def test_kmeans_guard():
    same = np.ones((6, 3))
    assert len(segments.kmeans(same, 5, 3, 7)[0]) == 1
    three = np.repeat(np.eye(3), 4, axis=0)
    centres, own = segments.kmeans(three, 20, 3, 7)
    assert len(centres) == 3 and len(set(own.tolist())) == 3
    assert len(segments.kmeans(np.random.default_rng(1).normal(size=(400, 3)), 5, 3, 7)[0]) == 5


def test_merges():
    labels = np.array([[0, 0, 1, 1, 2, 2]] * 3)
    rgb = np.array([[[0] * 3, [0] * 3, [5] * 3, [5] * 3, [90] * 3, [90] * 3]] * 3, float)
    assert segments.merge_similar(labels, rgb, 10).max() == 1
    assert segments.merge_similar(labels, rgb, 1).max() == 2
    small = np.zeros((8, 8), int)
    small[3, 3] = 1
    assert segments.merge_small(small, 4).max() == 0
    assert segments.merge_small(small, 100).max() == 1  # nothing kept ends it


def test_contours_and_paths():
    y, x = np.mgrid[:40, :40]
    (ring,) = curves.mask_rings((y - 20) ** 2 + (x - 20) ** 2 <= 144)
    assert abs(curves.ring_area(ring) - np.pi * 144) < 25 and np.allclose(ring[0], ring[-1])
    d = curves.path_data(curves.bezier_segments(ring))
    assert d.startswith("M") and d.endswith("z") and "c" in d
    hole = ((y - 20) ** 2 + (x - 20) ** 2 <= 225) & ((y - 20) ** 2 + (x - 20) ** 2 >= 64)
    assert len(curves.mask_rings(hole)) == 2
    assert len(curves.simplified(np.array([[0, 0], [1, 0.01], [2, 0], [2, 2]], float), 0.1)) == 3
    square = np.zeros((30, 30), bool)
    square[5:25, 5:25] = True
    assert len(curves.corners(curves.mask_rings(square, 0.3)[0][:-1])) == 4


def test_snapping_finds_the_edge():
    x = np.arange(40.0)
    luma = (1 / (1 + np.exp(-(x - 20.3) * 3)))[None].repeat(40, 0)
    ring = np.array([[19.5, float(y)] for y in range(8, 32)] + [[10.0, float(y)] for y in range(31, 7, -1)])
    moved, n = curves.snapped(ring, luma, np.ones_like(luma))
    assert n > 10 and np.abs(moved[4:20, 0] - 20.3).max() < 0.1


def test_models():
    y, x = (g.ravel().astype(float) for g in np.mgrid[:20, :30])
    ramp = np.stack([x / 30, x / 60, np.full_like(x, 0.3)], axis=1)
    fit = models.fit(y, x, ramp)
    assert fit and not fit["radial"] and abs(fit["u"][0]) > 0.99
    assert np.abs(models.predict(fit, ramp.mean(0), y, x) - ramp).max() < 0.08
    ring = np.stack([np.hypot(x - 15, y - 10) / 30] * 3, axis=1)
    assert models.fit(y, x, ring)["radial"]
    assert models.fit(y, x, np.ones_like(ramp)) is None
    strips = (np.mgrid[:20, :60][1] // 20) + 1
    strips[0], strips[-1] = 0, 0
    picture = np.stack([np.mgrid[:20, :60][1] / 600] * 3, axis=-1) + np.random.default_rng(0).normal(0, 0.05, (20, 60, 3))
    assert models.merge_by_gradient(strips, picture).max() < 3
    two = np.zeros((40, 40, 3))
    two[:, 20:] = 0.5
    labels, root = models.refine(np.zeros((40, 40), int), two, min_area=100)
    assert labels.max() >= 1 and set(root.values()) == {0}


def test_strokes_are_repeatable():
    rgb = np.stack([np.mgrid[:40, :40][1] / 40.0] * 3, axis=-1)
    t = conv.structure_tensor(rgb, 1.0, 3.0)
    mask = np.ones((40, 40), bool)
    one, two = (strokes.region_strokes(mask, rgb, t, np.full((40, 40), 0.02), 3, shortest=8.0) for _ in range(2))
    assert one and [a[0] for a in one] == [b[0] for b in two]
    assert strokes.region_strokes(mask, rgb, t, np.zeros((40, 40)), 3) == []


def test_slim_strings():
    assert text.slim_path("M100.0 200.0l-1.40 .60c0 0 0 0 0 0z") == "M100 200l-1.4 .6c0 0 0 0 0 0z"
    assert text.slim_path("M1.6 2.4l3.5 0", 0) == "M2 2l4 0"
    assert [text.compact(v) for v in (0.5, -0.5, -0.04, 12345.65, 0.25)] == [".5", "-.5", "0", "12345.6", ".2"]
    svg = '<svg><defs><clipPath id="a"><path d="M1.0 1.0"/></clipPath></defs><g id="regions"><path d="M0.0 0.0L10.0 10.0" clip-path="url(#a)"/></g></svg>'
    assert text.slim_document(text.slim_document(svg)) == text.slim_document(svg)
    tight = text.slim_document(svg, 0, 0, True)
    assert "clip" not in tight and 'd="M0 0L10 10"' in tight and text.valid_xml(tight)
    assert text.gzipped(svg) == text.gzipped(svg)


def test_rims_follow_the_profile():
    """A soft edge between two flat regions: depths parted where the profile is, bands on both sides, colours between the two."""
    y, x = np.mgrid[:60, :60].astype(float)
    d = np.hypot(y - 30, x - 30) - 16
    rgb = np.clip(0.5 + d / 3, 0, 1)[..., None] * np.array([0.8, 0.7, 0.6]) + 0.1
    labels = (d > 0).astype(int)
    t = conv.structure_tensor(rgb)
    profile = rims.mean_profile(t["luma"], t, float(np.quantile(t["energy"], 0.9)), 1.5)
    assert abs(profile[0]) < 1e-9 and abs(profile[-1] - 1) < 1e-9 and (np.diff(profile) >= -1e-6).all()
    depths = rims.ramp_depths(profile, 1.5, 3)
    assert depths.cuts[0] == 0 and depths.cuts[-1] == 1.5 and (np.diff(depths.cuts) > 0).all() and ((depths.at > depths.cuts[:-1]) & (depths.at < depths.cuts[1:])).all()
    assert rims.ramp_depths(None, 1.5, 3) is None and rims.ramp_depths(np.ones(13), 1.5, 3) is None
    drawn = np.ones(labels.shape, bool)
    # a vertical cut makes two stretches for each half
    cut = labels * 2 + (x > 30)
    bands, audit = rims.rims(cut, rgb, drawn, cut, t, 2, 3.0, least_points=6)
    assert {(b["label"], b["neighbor"], b["level"]) for b in bands} >= {(0, 2, 0), (0, 2, 1), (1, 3, 0), (0, 1, 0)}
    assert all(b["d"].startswith("M") and b["d"].endswith("z") and 0 <= b["color"].min() <= b["color"].max() <= 1 for b in bands)
    same, seen = rims.rims(cut, rgb, drawn, labels, t, 2, 3.0, least_points=6)
    assert all(labels[cut == b["label"]][0] != labels[cut == b["neighbor"]][0] for b in same) and any(a["synthetic"] for a in seen)
    assert not rims.rims(cut, rgb, ~drawn, cut, t)[0]


def test_ring_normals_point_inward():
    y, x = np.mgrid[:40, :40]
    for ring in curves.mask_rings((np.hypot(y - 20, x - 20) <= 14) & (np.hypot(y - 20, x - 20) > 6)):
        ring = ring[:-1]
        inner = ring + rims.inward(ring) * 2
        r = np.hypot(*(inner - 20).T)
        assert ((r < 13.9) & (r > 6.5)).all()


def test_shade_layers_take_back_smooth_error():
    y, x = np.mgrid[:96, :96].astype(float)
    source = (120 + 40 * np.exp(-((y - 48) ** 2 + (x - 48) ** 2) / 900))[..., None] * np.ones(3)
    drawn = np.full_like(source, 130.0)
    options = shades.Options(layers=6, radius=40.0, min_area=400)
    found, after = shades.shade_layers(source, drawn, options)
    assert found and ((source - after) ** 2).sum() < 0.5 * ((source - drawn) ** 2).sum()
    assert all(b["gain"] > 0 and b["colors"].shape == (4, 3) and 0 <= b["colors"].min() <= b["colors"].max() <= 255 for b in found)
    again = drawn.copy()
    for f in found:  # the layers, composed as a renderer would
        t = np.clip(np.hypot(y - f["cy"], x - f["cx"]) / f["r"], 0, 1)
        a = f["opacity"] * np.clip((1 - t) / (1 - f["edge"]), 0, 1)[..., None]
        c = np.stack([np.interp(t, np.linspace(0, 1, 4), f["colors"][:, k]) for k in range(3)], axis=-1)
        again = (1 - a) * again + a * c
    assert np.abs(again - after).max() < 1e-9
    noise = np.random.default_rng(0).integers(0, 255, (96, 96, 3)).astype(float)
    assert shades.shade_layers(noise, drawn, options)[0] == []


def test_distance_by_sweeps_and_envelopes(monkeypatch):
    rng = np.random.default_rng(4)
    for density in (0.3, 0.02, 0.002):
        mask = rng.random((40, 55)) < density
        mask[rng.integers(40), rng.integers(55)] = True
        swept = masks.distance(mask)
        with monkeypatch.context() as m:
            m.setattr(masks, "SWEPT", -1)
            envelope = masks.distance(mask)
        assert all(np.array_equal(a, b) for a, b in zip(swept, envelope, strict=True))
        ys, xs = np.nonzero(mask)
        y, x = np.mgrid[:40, :55]
        assert np.allclose(swept[0], np.sqrt(((y[..., None] - ys) ** 2 + (x[..., None] - xs) ** 2).min(axis=2)))
    assert np.isinf(masks.distance(np.zeros((3, 4), bool))[0]).all()


def test_cores_are_erosions_of_each_label():
    labels = np.kron(np.random.default_rng(5).integers(0, 3, (5, 6)), np.ones((8, 7), int))
    for radius in (0, 1, 3):
        want = np.zeros(labels.shape, bool)
        for i in range(3):
            want |= masks.eroded(labels == i, radius)
        assert np.array_equal(segments.cores(labels, radius), want)


def test_windows_are_boxes_of_labels():
    labels = np.random.default_rng(2).integers(-1, 6, (9, 11))
    for w in segments.windows(labels, 1):
        ys, xs = np.nonzero(labels == w.label)
        assert np.array_equal(ys, w.ys) and np.array_equal(xs, w.xs) and w.y0 == max(0, ys.min() - 1) and w.x0 == max(0, xs.min() - 1)
        assert np.array_equal(w.mask, w.plane(labels) == w.label)
    assert {w.label for w in segments.windows(labels)} == set(np.unique(labels)) - {-1} and not list(segments.windows(np.full((2, 2), -1)))


def plain_ramp(t, colors, radial):
    """A ramp, its range and gain by the definition, bin by bin."""
    lo, hi = np.percentile(t, (1, 99))
    u = np.clip((t - lo) / (hi - lo), 0, 1)
    at = np.minimum((u * 10).astype(int), 9)
    listed = {i: np.median(colors[at == i], axis=0) for i in range(10) if (at == i).sum() >= 15}
    at, error = np.floor(u * 8).astype(int), 0.0
    for i in range(8):
        own = colors[at == i]
        if len(own) > 15:
            error += ((own - np.median(own, axis=0)) ** 2).sum()
    return lo, hi, np.array(list(listed.values())), 1 - error / ((colors - colors.mean(axis=0)) ** 2).sum()


def test_ramps_of_all_axes_equal_single_ones():
    rng = np.random.default_rng(3)
    y, x = (v.ravel() for v in np.mgrid[:31, :23])
    for radial in (False, True):
        t = np.hypot(x - 11, y - 15) if radial else x * 0.6 + y * 0.8
        colors = np.round((t[:, None] * [0.02, 0.01, -0.015] + 0.5 + rng.normal(0, 0.01, (len(t), 3))) * 255) / 255
        found = models.fit(y, x, colors)
        assert found["radial"] == radial
        own = np.hypot(x - found["cx"], y - found["cy"]) if radial else np.stack((x - found["cx"], y - found["cy"]), axis=1) @ found["u"]
        lo, hi, values, gain = plain_ramp(own, colors, radial)
        assert (found["lo"], found["hi"]) == (lo, hi) and np.array_equal(found["values"], values)
        assert abs(found["gain"] - gain) < 1e-12 and found["range"] == np.ptp(values, axis=0).max()


def test_all_lines_are_fitted_at_once():
    """Many lines together give the cubics of each line alone, in its order, within the tolerance; ties go to the first point."""
    rng = np.random.default_rng(5)
    lines = [np.cumsum(rng.normal(0.5, 1.0, (n, 2)), axis=0) for n in (2, 3, 4, 9, 40, 150)] + [np.array([[0.0, 0], [0, 0]]), np.stack((np.arange(12.0), np.zeros(12)), axis=1)]
    calls = []
    of, curves.cubic_fits = curves.cubic_fits, lambda *given: (calls.append(1), of(*given))[1]
    try:
        together = curves.fitted_lines(lines, 0.3)
    finally:
        curves.cubic_fits = of
    assert len(calls) <= 9  # one for each depth, however many parts
    for line, made in zip(lines, together, strict=True):
        alone = np.array(curves.fitted(line, 0.3))
        assert np.allclose(alone, made) and np.array_equal(made[0, 0], line[0]) and np.array_equal(made[-1, 3], line[-1])
        assert np.array_equal(made[1:, 0], made[:-1, 3])
    bend = np.array([[0.0, 0], [1, 1], [2, 0.1], [3, 0.1], [4, 1], [5, 0]])  # symmetric: two points are as far
    assert np.array_equal(curves.fitted(bend, 0.01)[0][3], [1, 1])


def test_contours_join_like_cells():
    rng = np.random.default_rng(7)
    for shape in ((1, 1), (1, 6), (9, 7), (24, 31)):
        field = (rng.random(shape) < 0.5).astype(float)
        rings = curves.contours(field)
        assert all(np.array_equal(r[0], r[-1]) and np.abs(np.diff(r, axis=0)).max() <= 1 for r in rings)
        sides = np.abs(np.diff(np.pad(field, 1), axis=0)).sum() + np.abs(np.diff(np.pad(field, 1), axis=1)).sum()
        assert sum(len(r) - 1 for r in rings) == sides
        turn = sum(float(r[:-1, 0] @ r[1:, 1] - r[:-1, 1] @ r[1:, 0]) / 2 for r in rings)
        assert (turn != 0) == bool(field.any())


def test_numbers_round_their_binary_value():
    from fractions import Fraction

    rng = np.random.default_rng(9)
    for v in [*rng.normal(0, 40, 400), *(np.arange(-40, 40) / 8), 0.05, -0.05, 1e-9, 1e16, 0.35, 2.675]:
        for places in (1, 2, 3):
            units = round(Fraction(float(v)) * 10**places)
            assert Fraction(text.fixed(v, places)) == Fraction(units, 10**places) == Fraction(text.compact(v, places))
            assert not text.fixed(v, places).startswith("-0") or float(text.fixed(v, places)) < 0
    assert [text.fixed(v, 0) for v in (0.5, 1.5, 20.0)] == ["0", "2", "20"] and text.compact(-0.25, 2) == "-.25"
