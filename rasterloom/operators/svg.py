"""SVG documents: ordered assembly of layers, counts, slimming and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.color import hex_color
from rasterloom.functions.text import fixed_column, gzip_column, slim_document_column, valid_xml_column
from rasterloom.operators.regions import CHANNELS

LAYERS = ("regions", "strokes", "edges", "shade")


def rect(x: Column, y: Column, w: Column, h: Column, fill: Column) -> Column:
    return F.format_string('<rect x="%d" y="%d" width="%d" height="%d" fill="%s"/>', x, y, w, h, fill)


def path(d: Column, fill: Column) -> Column:
    return F.concat(F.lit('<path d="'), d, F.lit('" fill="'), fill, F.lit('" fill-rule="evenodd"/>'))


def gradient_def(id_: Column, fits: str = "") -> Column:
    """<linearGradient> or <radialGradient> of a model's columns (kind, cx, cy, ux, uy, lo, hi, stops)."""
    f = lambda c: F.col(f"{fits}{c}")
    num = lambda c, p=1: fixed_column(c, F.lit(p))
    stops = F.array_join(F.transform(f("stops"), lambda s: F.concat(F.lit('<stop offset="'), F.format_string("%.3f", s["offset"]), F.lit('" stop-color="'), hex_color(*(s[c] for c in CHANNELS)), F.lit('"/>'))), "")
    line = F.concat(F.lit('<linearGradient id="'), id_, F.lit('" gradientUnits="userSpaceOnUse" x1="'), num(f("cx") + f("ux") * f("lo")), F.lit('" y1="'), num(f("cy") + f("uy") * f("lo")), F.lit('" x2="'), num(f("cx") + f("ux") * f("hi")), F.lit('" y2="'), num(f("cy") + f("uy") * f("hi")), F.lit('">'), stops, F.lit("</linearGradient>"))
    ring = F.concat(F.lit('<radialGradient id="'), id_, F.lit('" gradientUnits="userSpaceOnUse" cx="'), num(f("cx")), F.lit('" cy="'), num(f("cy")), F.lit('" r="'), num(f("hi")), F.lit('">'), stops, F.lit("</radialGradient>"))
    return F.when(f("ux").isNotNull(), line).otherwise(ring)


def line(d: Column, stroke: Column, width: Column, alpha: float) -> Column:
    return F.concat(F.lit('<path d="'), d, F.lit('" fill="none" stroke="'), stroke, F.lit('" stroke-width="'), F.format_string("%.2f", width), F.lit(f'" stroke-opacity="{alpha}"/>'))


def shade_def(id_: Column) -> Column:
    """The radial gradient of a shade layer (columns cx, cy, r, opacity, edge, stops): colours at even shares, opacity falling to 0."""
    last = F.greatest(F.size("stops") - 1, F.lit(1))

    def stop(color: Column, i: Column) -> Column:
        opacity = F.col("opacity") * F.least(F.lit(1.0), (1 - i / last) / F.greatest(1 - F.col("edge"), F.lit(1e-6)))
        return F.concat(F.lit('<stop offset="'), F.format_string("%.3f", i / last), F.lit('" stop-color="'), hex_color(*(color[c] for c in CHANNELS)), F.lit('" stop-opacity="'), F.format_string("%.4f", opacity), F.lit('"/>'))

    head = F.concat(F.lit('<radialGradient id="'), id_, F.format_string('" gradientUnits="userSpaceOnUse" cx="%.1f" cy="%.1f" r="%.1f">', "cx", "cy", "r"))
    return F.concat(head, F.array_join(F.transform("stops", stop), ""), F.lit("</radialGradient>"))


def shade_rect(id_: Column, w: Column, h: Column) -> Column:
    """A shade layer covers the whole canvas; beyond its rim it is transparent."""
    return rect(F.lit(0), F.lit(0), w, h, F.concat(F.lit("url(#"), id_, F.lit(")")))


def documents(parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, svg) from parts (image_id, layer, seq, element[, def][, kind, sub]) and sizes (image_id, w, h[, background]).

    Layers come in their fixed order, elements by kind, seq and sub (0 if not given); the background is a rectangle under
    all. One group an image.
    """
    for number in ("kind", "sub"):
        if number not in parts.columns:
            parts = parts.withColumn(number, F.lit(0))
    if "def" not in parts.columns:
        parts = parts.withColumn("def", F.lit(None).cast("string"))
    if "background" not in sizes.columns:
        sizes = sizes.withColumn("background", F.lit(None).cast("string"))
    order = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer"))
    rows = parts.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("layer"), F.col("kind").cast("long").alias("kind"), "seq", F.col("sub").cast("long").alias("sub"), "element", "def"))).alias("all"))

    def layer(i: int) -> Column:
        own = F.filter("all", lambda p: p["layer"] == i + 1)
        return F.when(F.size(own) > 0, F.concat(F.lit(f'<g id="{LAYERS[i]}">'), F.array_join(F.transform(own, lambda p: p["element"]), ""), F.lit("</g>"))).otherwise("")

    defs = F.array_join(F.filter(F.transform("all", lambda p: p["def"]), lambda d: d.isNotNull()), "")
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d" viewBox="0 0 %d %d">', "w", "h", "w", "h")
    ground = F.when(F.col("background").isNotNull(), rect(F.lit(0), F.lit(0), F.col("w"), F.col("h"), F.col("background"))).otherwise("")
    body = F.concat(head, F.when(defs != "", F.concat(F.lit("<defs>"), defs, F.lit("</defs>"))).otherwise(""), ground, *(layer(i) for i in range(len(LAYERS))), F.lit("</svg>"))
    return sizes.join(rows.hint("merge"), "image_id", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<layer:bigint,kind:bigint,seq:bigint,sub:bigint,element:string,def:string>>"))).select("image_id", body.alias("svg"))


def layer_counts(docs: DataFrame) -> DataFrame:
    """(image_id, layer, n): <path> and <rect> elements within each group."""
    each = [F.struct(F.lit(name).alias("layer"), F.regexp_extract("svg", rf'<g id="{name}"[^>]*>(.*?)</g>', 1).alias("body")) for name in LAYERS]
    rows = docs.select("image_id", F.explode(F.array(*each)).alias("s"))
    return rows.select("image_id", "s.layer", F.regexp_count("s.body", F.lit("<(?:path|rect)")).cast("long").alias("n"))


def slimmed(docs: DataFrame, places: int = 1, stroke_places: int = 1, tight: bool = False, packed: bool = False) -> DataFrame:
    """docs with slim documents; tight rounds to whole numbers and drops clip paths; packed adds svgz, valid the XML check."""
    p, s = (0, 0) if tight else (places, stroke_places)
    out = docs.withColumn("svg", slim_document_column("svg", F.lit(p), F.lit(s), F.lit(tight))).withColumn("valid", valid_xml_column("svg"))
    return out.withColumn("svgz", gzip_column("svg")) if packed else out


