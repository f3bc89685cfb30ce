"""Colour expressions over channels; plain built-in arithmetic, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(c: Column) -> Column:
    """A channel clipped to 0..1."""
    return F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(1.0))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def saturation(r: Column, g: Column, b: Column) -> Column:
    """Largest less smallest channel."""
    return F.greatest(r, g, b) - F.least(r, g, b)


def _linear(c: Column) -> Column:
    return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)


def lab(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """CIE L*, a*, b* (D65, 2 degrees) of sRGB channels in 0..1."""
    lr, lg, lb = _linear(r), _linear(g), _linear(b)
    # fixed values: the sRGB matrix, and the white point
    x = (lr * 0.412453 + lg * 0.357580 + lb * 0.180423) / 0.95047
    y = lr * 0.212671 + lg * 0.715160 + lb * 0.072169
    z = (lr * 0.019334 + lg * 0.119193 + lb * 0.950227) / 1.08883
    fx, fy, fz = (F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0) for t in (x, y, z))
    return {"l": fy * 116 - 16, "a": (fx - fy) * 500, "b": (fy - fz) * 200}


def chroma(r: Column, g: Column, b: Column) -> Column:
    of = lab(r, g, b)
    return F.hypot(of["a"], of["b"])


def packed(r: Column, g: Column, b: Column, bits: int) -> Column:
    """The key of a colour's bucket: the top `bits` bits of each 8-bit channel."""
    s = 8 - bits
    top = [F.shiftright(c.cast("int"), s) for c in (r, g, b)]
    return F.shiftleft(top[0], 2 * bits).bitwiseOR(F.shiftleft(top[1], bits)).bitwiseOR(top[2])


def bucket_level(key: Column, channel: int, bits: int) -> Column:
    """The centre, in 0..1, of a bucket's channel (0 red, 1 green, 2 blue)."""
    part = F.shiftright(key, (2 - channel) * bits).bitwiseAND(F.lit((1 << bits) - 1))
    return (part + 0.5) * float(1 << (8 - bits)) / 255.0


def hex_color(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of channels in 0..1, rounded half to even."""
    parts = [F.lpad(F.lower(F.hex(F.rint(unit(c) * 255).cast("long"))), 2, "0") for c in (r, g, b)]
    return F.concat(F.lit("#"), *parts)


def micro(c: Column) -> Column:
    """A number in whole millionths: what queries report, so that engines agree to the last digit."""
    return F.floor(c * 1000000 + 0.5).cast("long")
