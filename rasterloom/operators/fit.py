"""Gradient models of regions: axes, linear and radial ramps, selection, prediction, residuals, splits.

All are aggregations and windows over labelled pixels with channels in 0..1 (image_id, y, x, label, r, g, b). Candidates of
a region are rows (image_id, label, kind, …), so that a choice among them is one aggregate. Sign of an axis: its first
component that is not zero is positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.regions import CHANNELS, KEY, matched

EPS = 1e-12
LEAST_PIXELS, LEAST_BIN = 200, 15


def scaled(px: DataFrame, by: float = 255.0) -> DataFrame:
    """Channels of 0..255 as 0..1."""
    return px.withColumns({c: F.col(c).cast("double") / by for c in CHANNELS})


def _principal(df: DataFrame, xx: Column, xy: Column, yy: Column) -> DataFrame:
    """ux, uy: the unit eigenvector of the larger eigenvalue of [[xx, xy], [xy, yy]]; (1, 0) if all directions are alike."""
    df = df.withColumns({"_a": xx, "_b": xy, "_d": yy})
    top = (F.col("_a") + F.col("_d")) / 2 + F.sqrt(((F.col("_a") - F.col("_d")) / 2) ** 2 + F.col("_b") ** 2)
    df = df.withColumn("_t", top)
    first = F.col("_b") ** 2 + (F.col("_t") - F.col("_a")) ** 2 >= F.col("_b") ** 2 + (F.col("_t") - F.col("_d")) ** 2
    df = df.withColumn("_x", F.when(first, F.col("_b")).otherwise(F.col("_t") - F.col("_d"))).withColumn("_y", F.when(first, F.col("_t") - F.col("_a")).otherwise(F.col("_b")))
    df = df.withColumn("_n", F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2))
    flat = F.col("_n") <= EPS
    sign = F.when((F.col("_x") < -EPS) | ((F.abs("_x") <= EPS) & (F.col("_y") < 0)), -1.0).otherwise(1.0)
    df = df.withColumn("ux", F.when(flat, 1.0).otherwise(sign * F.col("_x") / F.col("_n"))).withColumn("uy", F.when(flat, 0.0).otherwise(sign * F.col("_y") / F.col("_n")))
    return df.drop("_a", "_b", "_d", "_t", "_x", "_y", "_n")


def pca_axis(px: DataFrame) -> DataFrame:
    """(…, n, cx, cy, ux, uy): the direction along which position and colour vary together most."""
    moments = [F.covar_pop(p, c).alias(f"_{p}{c}") for p in ("x", "y") for c in CHANNELS]
    df = px.groupBy(*KEY).agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), *moments)
    xx, yy = (sum((F.col(f"_{p}{c}") ** 2 for c in CHANNELS), F.lit(0.0)) for p in "xy")
    xy = sum((F.col(f"_x{c}") * F.col(f"_y{c}") for c in CHANNELS), F.lit(0.0))
    return _principal(df, xx, xy, yy).drop(*(f"_{p}{c}" for p in "xy" for c in CHANNELS))


def gradients(px: DataFrame, value: str) -> DataFrame:
    """gx, gy of a column: half the difference of the two neighbours, one-sided at an image's edges."""
    for name, key, along in (("gx", "y", "x"), ("gy", "x", "y")):
        w = Window.partitionBy("image_id", key).orderBy(along)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        both = (after - before) / 2
        px = px.withColumn(name, F.when(before.isNotNull() & after.isNotNull(), both).when(after.isNotNull(), after - F.col(value)).when(before.isNotNull(), F.col(value) - before).otherwise(0.0))
    return px


def tensor_axis(px: DataFrame) -> DataFrame:
    """(…, ux, uy): mean gradient direction weighted by energy; px has gx, gy and energy."""
    df = px.groupBy(*KEY).agg(F.avg(F.col("gx") * F.col("energy")).alias("_gx"), F.avg(F.col("gy") * F.col("energy")).alias("_gy"))
    n = F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2)
    sign = F.when((F.col("_gx") < -EPS) | ((F.abs("_gx") <= EPS) & (F.col("_gy") < 0)), -1.0).otherwise(1.0)
    return df.select(*KEY, F.when(n > EPS, sign * F.col("_gx") / n).otherwise(1.0).alias("ux"), F.when(n > EPS, sign * F.col("_gy") / n).otherwise(0.0).alias("uy"))


def radial_centers(px: DataFrame) -> DataFrame:
    """(…, kind, cx, cy): centroid, middle of the bounding box, and the point nearest to all gradient lines.

    px has gx and gy. The line system is left out where it is nearly singular.
    """
    gx, gy = F.col("gx"), F.col("gy")
    sums = px.groupBy(*KEY).agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), ((F.min("x") + F.max("x")) / 2).alias("bx"), ((F.min("y") + F.max("y")) / 2).alias("by"),
        F.sum(gy * gy).alias("a11"), F.sum(-gx * gy).alias("a12"), F.sum(gx * gx).alias("a22"),
        F.sum(gy * (gy * F.col("x") - gx * F.col("y"))).alias("b1"), F.sum(-gx * (gy * F.col("x") - gx * F.col("y"))).alias("b2"),
    )
    det = F.col("a11") * F.col("a22") - F.col("a12") ** 2
    good = det > 1e-3 * (F.col("a11") + F.col("a22")) ** 2
    line = F.struct(F.lit("lines").alias("kind"), F.when(good, (F.col("a22") * F.col("b1") - F.col("a12") * F.col("b2")) / det).alias("cx"), F.when(good, (F.col("a11") * F.col("b2") - F.col("a12") * F.col("b1")) / det).alias("cy"))
    rows = F.array(F.struct(F.lit("centroid").alias("kind"), F.col("mx").alias("cx"), F.col("my").alias("cy")), F.struct(F.lit("box").alias("kind"), F.col("bx").alias("cx"), F.col("by").alias("cy")), line)
    return sums.select(*KEY, F.explode(rows).alias("s")).select(*KEY, "s.*").where("cx is not null")


def along_axis(px: DataFrame, axes: DataFrame) -> DataFrame:
    """px with t, the position along each region's axis from its centroid (cx, cy, ux, uy)."""
    return matched(px, axes.select(*KEY, "cx", "cy", "ux", "uy")).withColumn("t", (F.col("x") - F.col("cx")) * F.col("ux") + (F.col("y") - F.col("cy")) * F.col("uy")).drop("cx", "cy", "ux", "uy")


def from_center(px: DataFrame, centers: DataFrame) -> DataFrame:
    """px with t, the distance from each region's centre, a row for each candidate kind."""
    return matched(px, centers).withColumn("t", F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)).drop("cx", "cy")


def _normalised(px_t: DataFrame, keys: list[str], least_range: float) -> DataFrame:
    ends = px_t.groupBy(*keys).agg(F.percentile("t", F.array(F.lit(0.01), F.lit(0.99))).alias("e"), F.count("*").alias("n")).select(*keys, "n", F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"))
    ends = ends.where(F.col("hi") - F.col("lo") >= least_range)
    return matched(px_t, ends, keys).withColumn("u", F.least(F.greatest((F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0)))


def ramp_bins(px_t: DataFrame, keys: list[str], stops: int = 10, least_range: float = 4.0) -> DataFrame:
    """(keys, bin, n, r, g, b): channel medians by bin of the normalised position; the last bin is closed; 15 pixels at least."""
    u = _normalised(px_t, keys, least_range).withColumn("bin", F.least(F.floor(F.col("u") * stops), F.lit(stops - 1)).cast("int"))
    return u.groupBy(*keys, "bin").agg(F.count("*").alias("n"), *(F.median(c).alias(c) for c in CHANNELS)).where(F.col("n") >= LEAST_BIN)


def ramp_gain(px_t: DataFrame, keys: list[str], bins: int = 8, least_range: float = 4.0) -> DataFrame:
    """(keys, gain): share of the squared colour error that binned medians remove.

    Bins are half open, so that the far end belongs to none, and count above 15 pixels; the flat error counts all.
    """
    u = _normalised(px_t, keys, least_range)
    flat = u.groupBy(*keys).agg(sum((F.var_pop(c) * F.count("*") for c in CHANNELS), F.lit(0.0)).alias("flat"))
    inside = u.withColumn("bin", F.floor(F.col("u") * bins).cast("int")).where(F.col("bin") < bins)
    middle = inside.groupBy(*keys, "bin").agg(F.count("*").alias("n"), *(F.median(c).alias(f"m_{c}") for c in CHANNELS)).where(F.col("n") > LEAST_BIN)
    error = matched(inside, middle, [*keys, "bin"]).groupBy(*keys).agg(F.sum(sum(((F.col(c) - F.col(f"m_{c}")) ** 2 for c in CHANNELS), F.lit(0.0))).alias("axis"))
    return matched(flat, error, keys, "left").select(*keys, (1 - F.coalesce("axis", F.lit(0.0)) / (F.col("flat") + EPS)).alias("gain"))


def profiles(px_t: DataFrame, keys: list[str], radial: bool, stops: int = 10, bins: int = 8) -> DataFrame:
    """(keys, n, lo, hi, stops, range, gain): a ramp along t. Radial offsets are fractions of hi; two stops at least.

    The bins of ramp_bins and of ramp_gain come from one aggregation: squared errors to a bin's median follow from its sums.
    """
    u = _normalised(px_t, keys, 2.0 if radial else 4.0)
    schemes = F.array(F.struct(F.lit(0).alias("scheme"), F.least(F.floor(F.col("u") * stops), F.lit(stops - 1)).cast("int").alias("bin")), F.struct(F.lit(1).alias("scheme"), F.floor(F.col("u") * bins).cast("int").alias("bin")))
    rows = u.select(*keys, "n", "lo", "hi", *CHANNELS, F.explode(schemes).alias("s")).select("*", "s.scheme", "s.bin").drop("s")
    sums = [x for c in CHANNELS for x in (F.median(c).alias(c), F.sum(c).alias(f"s_{c}"), F.sum(F.col(c) ** 2).alias(f"q_{c}"))]
    binned = rows.groupBy(*keys, "n", "lo", "hi", "scheme", "bin").agg(F.count("*").alias("m"), *sums)
    stop, counted = (F.col("scheme") == 0) & (F.col("m") >= LEAST_BIN), (F.col("scheme") == 1) & (F.col("bin") < bins) & (F.col("m") > LEAST_BIN)
    centre = (F.col("bin") + 0.5) / stops
    offset = (F.col("lo") + centre * (F.col("hi") - F.col("lo"))) / F.col("hi") if radial else centre
    error = sum((F.col(f"q_{c}") - 2 * F.col(c) * F.col(f"s_{c}") + F.col("m") * F.col(c) ** 2 for c in CHANNELS), F.lit(0.0))
    whole = F.col("scheme") == 1
    flat = sum((F.sum(F.when(whole, F.col(f"q_{c}"))) - F.sum(F.when(whole, F.col(f"s_{c}"))) ** 2 / F.first("n") for c in CHANNELS), F.lit(0.0))
    widest = F.greatest(*(F.max(F.when(stop, F.col(c))) - F.min(F.when(stop, F.col(c))) for c in CHANNELS))
    made = binned.groupBy(*keys, "n", "lo", "hi").agg(
        F.array_sort(F.collect_list(F.when(stop, F.struct(offset.alias("offset"), *CHANNELS)))).alias("stops"),
        widest.alias("range"),
        (1 - F.coalesce(F.sum(F.when(counted, error)), F.lit(0.0)) / (flat + EPS)).alias("gain"),
    )
    return made.where(F.size("stops") >= 2)


def fit_gradients(px: DataFrame, axes: DataFrame, centers: DataFrame, min_gain: float = 0.12, min_range: float = 0.004, margin: float = 0.05, stops: int = 10) -> DataFrame:
    """(…, kind, cx, cy, ux, uy, lo, hi, stops, range, gain): each region's chosen model; regions without one are flat and left out.

    axes has kind ('pca', 'tensor'), cx, cy, ux, uy. The better linear candidate is the base. A radial one replaces it if its
    residual is smaller by the margin and it passes range and gain itself; else the linear one must pass.
    """
    keys = [*KEY, "kind"]
    large = px.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PIXELS)
    px = matched(px, large.select(*KEY), how="left_semi")
    linear_t = matched(px, axes.select(*keys, "cx", "cy", "ux", "uy")).withColumn("t", (F.col("x") - F.col("cx")) * F.col("ux") + (F.col("y") - F.col("cy")) * F.col("uy"))
    linear = matched(profiles(linear_t, keys, False, stops), axes.select(*keys, "cx", "cy", "ux", "uy"), keys)
    radial = matched(profiles(from_center(px, centers), keys, True, stops), centers, keys).withColumn("ux", F.lit(None).cast("double")).withColumn("uy", F.lit(None).cast("double"))
    model = ["kind", "cx", "cy", "ux", "uy", "lo", "hi", "stops", "range", "gain"]

    def best(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*KEY).agg(F.max_by(F.struct(*model), F.struct("gain", F.col("kind") == "pca", F.col("kind") == "centroid", "kind")).alias(name))

    both = matched(best(linear, "line"), best(radial, "ring"), how="left")
    passes = lambda s: (F.col(f"{s}.range") >= min_range) & (F.col(f"{s}.gain") >= min_gain)
    ring = F.col("ring").isNotNull() & ((1 - F.col("ring.gain")) < (1 - F.col("line.gain")) * (1 - margin)) & passes("ring")
    chosen = F.when(ring, F.col("ring")).when(passes("line"), F.col("line"))
    return both.select(*KEY, chosen.alias("m")).where("m is not null").select(*KEY, "m.*")


def interpolated(stops: Column, below: Column, t: Column, channel: str) -> Column:
    """The value of a channel on the piecewise linear ramp, constant beyond its ends; so many of the stops, in order, lie at or below t."""
    a, b = F.get(stops, below - 1), F.get(stops, below)
    part = a[channel] + (b[channel] - a[channel]) * (t - a["offset"]) / (b["offset"] - a["offset"])
    return F.when(below == 0, b[channel]).when(below == F.size(stops), a[channel]).otherwise(part)


def predict(px: DataFrame, fills: DataFrame, fits: DataFrame) -> DataFrame:
    """px with p_r, p_g, p_b: the model's colour where its region has one, else the flat fill."""
    attributes = matched(fills.select(*KEY, *(F.col(c).alias(f"f_{c}") for c in CHANNELS)), fits, how="left")
    df = matched(px, attributes)
    line = F.least(F.greatest(((F.col("x") - F.col("cx")) * F.col("ux") + (F.col("y") - F.col("cy")) * F.col("uy") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    ring = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) / F.col("hi")
    df = df.withColumn("_t", F.when(F.col("ux").isNotNull(), line).otherwise(ring))
    # the place among the stops is looked for once and not for each channel
    df = df.withColumn("_below", F.when(F.col("stops").isNotNull(), F.size(F.filter("stops", lambda s: s["offset"] <= F.col("_t")))))
    for c in CHANNELS:
        df = df.withColumn(f"p_{c}", F.when(F.col("stops").isNull(), F.col(f"f_{c}")).otherwise(interpolated(F.col("stops"), F.col("_below"), F.col("_t"), c)))
    return df.select(*px.columns, *(f"p_{c}" for c in CHANNELS))


def residuals(predicted: DataFrame) -> DataFrame:
    """e: the largest, and act: the mean absolute channel difference between observed and predicted."""
    parts = [F.abs(F.col(c) - F.col(f"p_{c}")) for c in CHANNELS]
    return predicted.withColumn("e", F.greatest(*parts)).withColumn("act", (parts[0] + parts[1] + parts[2]) / 3)


def fill_stats(errors: DataFrame, threshold: float = 0.02) -> DataFrame:
    """(…, rms, excess, nbad) of each region's errors e."""
    over = F.greatest(F.col("e") - threshold, F.lit(0.0))
    return errors.groupBy(*KEY).agg(F.sqrt(F.avg(F.col("e") ** 2)).alias("rms"), F.avg(over**2).alias("excess"), F.count_if(F.col("e") > threshold).alias("nbad"))


def needs_refinement(stats: DataFrame, areas: DataFrame, min_area: int = 400) -> DataFrame:
    """Regions whose error asks for a split: enough bad pixels, positive excess, and area for two children."""
    child = max(32, min_area // 4)
    return matched(stats, areas).where((F.col("nbad") >= max(16, child // 2)) & (F.col("excess") > 0) & (F.col("area") >= min_area))


def error_axis(errors: DataFrame) -> DataFrame:
    """(…, cx, cy, ux, uy): the principal direction of where the error lies, weighted by its square."""
    w = F.col("e") ** 2
    sums = errors.withColumn("w", w).groupBy(*KEY).agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"), *(F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in ("xx", "xy", "yy"))).where("sw > 0")
    sums = sums.withColumn("cx", F.col("sx") / F.col("sw")).withColumn("cy", F.col("sy") / F.col("sw"))
    xx, xy, yy = (F.col(f"s{a}{b}") / F.col("sw") - F.col(f"c{a}") * F.col(f"c{b}") for a, b in ("xx", "xy", "yy"))
    return _principal(sums, xx, xy, yy).select(*KEY, "cx", "cy", "ux", "uy")


def weighted_cut(errors: DataFrame, axes: DataFrame) -> DataFrame:
    """(…, cut): the error-weighted median position along the axis, kept between the positions' quartiles."""
    t = along_axis(errors, axes).withColumn("w", F.col("e") ** 2)
    w = Window.partitionBy(*KEY).orderBy("t", "y", "x").rowsBetween(Window.unboundedPreceding, 0)
    run = t.withColumn("upto", F.sum("w").over(w)).withColumn("total", F.sum("w").over(Window.partitionBy(*KEY)))
    cut = F.min(F.when(F.col("upto") >= F.col("total") / 2, F.col("t")))
    found = run.groupBy(*KEY).agg(cut.alias("cut"), F.percentile("t", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    return found.select(*KEY, F.least(F.greatest("cut", F.col("q")[0]), F.col("q")[1]).alias("cut"))


def accepts(before: DataFrame, after: DataFrame, gain: float = 0.2) -> DataFrame:
    """Regions whose children's excess is at most (1 - gain) of theirs while rms grows by 5 % at most."""
    a, b = before.select(*KEY, F.col("excess").alias("e0"), F.col("rms").alias("r0")), after.select(*KEY, F.col("excess").alias("e1"), F.col("rms").alias("r1"))
    return matched(a, b).where((F.col("e1") <= (1 - gain) * F.col("e0")) & (F.col("r1") <= 1.05 * F.col("r0")))


def regroup(px: DataFrame, groups: DataFrame, fits: DataFrame, refit) -> DataFrame:
    """Models after regions were joined: groups is (image_id, label, group) of all regions; fits are the old models.

    A group of one region keeps its model under the group's label; only the pixels of the others go to refit (pixels ->
    models), so that a pass costs what changed.
    """
    members = groups.groupBy("image_id", "group").agg(F.count("*").alias("n"))
    alone = matched(groups, members.where("n = 1"), ["image_id", "group"]).select(*KEY, "group")
    kept = matched(fits, alone).drop("label").withColumnRenamed("group", "label")
    changed = matched(groups, members.where("n > 1"), ["image_id", "group"]).select(*KEY, "group")
    moved = matched(px, changed).drop("label").withColumnRenamed("group", "label")
    return kept.unionByName(refit(moved), allowMissingColumns=True)
