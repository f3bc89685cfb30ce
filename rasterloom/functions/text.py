"""Numbers and path data as text. Rounding follows the binary value (half to even), which JVM formatting does not."""

from __future__ import annotations

import gzip
import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StringType

#: Layers whose paths take the second number of places.
LATER_LAYERS = ("strokes", "edges", "shade")


def fixed(value: float, places: int = 1) -> str:
    """A number with at most `places` decimals, without trailing zeros and without a negative zero."""
    if places > 0 and isinstance(value, float) and math.isfinite(value):  # formatting rounds the binary value, half to even
        text = f"{value:.{places}f}".rstrip("0").rstrip(".")
        return "0" if text == "-0" else text
    units = round(Fraction(value) * 10**places)
    whole, part = divmod(abs(units), 10**places)
    digits = f"{whole}.{part:0{places}d}".rstrip("0").rstrip(".") if part else f"{whole}"
    return f"-{digits}" if units < 0 else digits


def compact(value: float, places: int = 1) -> str:
    """As fixed(), without the zero before a decimal point."""
    text = fixed(value, places)
    return text[1:] if text.startswith("0.") else f"-{text[2:]}" if text.startswith("-0.") else text


#: A number, or a command of path data.
_TOKEN = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[A-Za-z]")


def path_tokens(path: str) -> Iterator[str | float]:
    """Commands (single letters) and numbers of path data; whatever stands between them is passed over."""
    for token in _TOKEN.findall(path):
        yield token if token.isalpha() else float(token)


def slim_path(path: str, places: int = 1) -> str:
    """Path data with compact numbers: one space between numbers, none around letters; Z becomes z."""
    out: list[str] = []
    number = False
    for token in path_tokens(path):
        if isinstance(token, str):
            out.append("z" if token == "Z" else token)
        else:
            out.append((" " if number else "") + compact(token, places))
        number = not isinstance(token, str)
    return "".join(out)


def _attributes(svg: str, name: str, of: Callable[[str], str | None]) -> str:
    """The document with of(value) as the value of each attribute of a name; without the attribute where that is None."""
    out, at, mark = [], 0, f'{name}="'
    while (found := svg.find(mark, at)) >= 0:
        begin = found + len(mark)
        end = svg.find('"', begin)
        if end < 0:
            break
        if found and svg[found - 1].isspace():
            value = of(svg[begin:end])
            out += [svg[at : found - 1]] if value is None else [svg[at:begin], value, '"']
        else:
            out.append(svg[at : end + 1])
        at = end + 1
    return "".join([*out, svg[at:]])


def without_clips(svg: str) -> str:
    """The document without clipPath elements and references to them."""
    out, at = [], 0
    while (found := svg.find("<clipPath", at)) >= 0:
        end = svg.find("</clipPath>", found)
        if end < 0:
            break
        whole = svg[found + len("<clipPath")] in "> \t\r\n/"
        out.append(svg[at:found] if whole else svg[at : end + len("</clipPath>")])
        at = end + len("</clipPath>")
    return _attributes("".join([*out, svg[at:]]), "clip-path", lambda _: None)


def _later_layers(svg: str) -> int:
    """Where the first group of a later layer begins."""
    at = svg.find("<g")
    while at >= 0:
        head = svg[at : svg.find(">", at) + 1 or len(svg)]
        if not head[2:3].isalnum() and any(f' id="{name}"' in head for name in LATER_LAYERS):
            return at
        at = svg.find("<g", at + 2)
    return len(svg)


def slim_document(svg: str, places: int = 1, stroke_places: int = 1, tight: bool = False) -> str:
    """A document with slim path data; layers from 'strokes' on use stroke_places. tight drops clip paths."""
    if tight:
        svg = without_clips(svg)
    at = _later_layers(svg)
    return _attributes(svg[:at], "d", lambda d: slim_path(d, places)) + _attributes(svg[at:], "d", lambda d: slim_path(d, stroke_places))


def valid_xml(svg: str) -> bool:
    try:
        ET.fromstring(svg)
    except ET.ParseError:
        return False
    return True


def gzipped(svg: str) -> bytes:
    """Level 9, no time stamp: the same bytes for the same text."""
    return gzip.compress(svg.encode(), 9, mtime=0)


def _text_udf(of):
    @F.pandas_udf(StringType())
    def run(values: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or (isinstance(v, float) and not math.isfinite(v)) else of(v, int(p)) for v, p in zip(values, places, strict=True)], dtype=object)

    return run


fixed_column, compact_column, slim_path_column = _text_udf(fixed), _text_udf(compact), _text_udf(slim_path)


@F.pandas_udf(StringType())
def slim_document_column(values: pd.Series, places: pd.Series, stroke_places: pd.Series, tight: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else slim_document(v, int(p), int(s), bool(t)) for v, p, s, t in zip(values, places, stroke_places, tight, strict=True)], dtype=object)


@F.pandas_udf(BinaryType())
def gzip_column(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else gzipped(v) for v in values], dtype=object)


@F.pandas_udf(BooleanType())
def valid_xml_column(values: pd.Series) -> pd.Series:
    return pd.Series([v is not None and valid_xml(v) for v in values])


def human_size(n):
    """A byte count in units of 1024."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(F.round(n / 1024, 1).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.round(n / 1024**2, 2).cast("string"), F.lit(" MB")))
