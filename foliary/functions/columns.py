"""Scalar operators as Catalyst expressions, inside whole-stage code generation; only html_text walks in Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..formats.html import text_of

#: Extension to format.
FORMATS = {".doc": "doc", ".docx": "docx", ".xls": "xls", ".xlsx": "xlsx", ".ppt": "ppt", ".pptx": "pptx", ".pdf": "pdf", ".rtf": "rtf", ".ofd": "ofd"}
WIDE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
_trim = r"(?U)^\s+|\s+$"


def trimmed(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, _trim, "")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or the empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def format_of(path: Column) -> Column:
    """Name of the format, null where the extension is unknown."""
    e, out = extension(path), F.lit(None).cast("string")
    for k, v in FORMATS.items():
        out = F.when(e == k, v).otherwise(out)
    return out


def has_native_text(text: Column, least: int = 16) -> Column:
    """Whether a page needs no character recognition: it has that many letters or digits. Null counts as none."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", "")) >= least


def text_width(text: Column, size: Column | float) -> Column:
    """Estimated width: tab 2, other white space 0.5, ASCII 0.55, wide scripts 1, the rest 0.8 of the size each."""
    n = lambda p: F.length(text) - F.length(F.regexp_replace(text, p, ""))
    tabs, spaces, ascii_, wide = n("\t"), n(r"(?U)\s") - n("\t"), n(r"[\x00-\x7f&&[^\s]]"), n(WIDE)
    rest = F.length(text) - tabs - spaces - ascii_ - wide
    return (tabs * 2.0 + spaces * 0.5 + ascii_ * 0.55 + wide * 1.0 + rest * 0.8) * size


def flatten_cell(text: Column) -> Column:
    """One line: pieces between line breaks and tabs, trimmed, joined with a space only between ASCII word characters."""
    parts = F.filter(F.transform(F.split(text, r"[\r\n\t]+"), lambda p: F.regexp_replace(p, _trim, "")), lambda p: p != "")
    glue = lambda a, p: F.when((a == "") | ~(a.rlike("[0-9A-Za-z]$") & p.rlike("^[0-9A-Za-z]")), F.concat(a, p)).otherwise(F.concat_ws(" ", a, p))
    return F.aggregate(parts, F.lit(""), glue)


def _html_texts(sources: pd.Series) -> pd.Series:
    return sources.map(lambda t: None if t is None else text_of(t))


def html_text(source: Column) -> Column:
    """Text of an HTML page, in Arrow batches: tags are walked one by one, which no expression does in linear time."""
    return F.pandas_udf(_html_texts, "string")(source)


def cell_column(ref: Column) -> Column:
    """Zero-based column of a reference such as AB12, at most 16383; 0 for a bad reference."""
    letters = F.upper(F.regexp_extract(ref, "^([A-Za-z]+)[0-9]+$", 1))
    value = F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.least(F.lit(16384), a * 26 + F.ascii(c) - 64))
    return F.when(letters == "", 0).otherwise(value - 1).cast("int")


def cell_row(ref: Column) -> Column:
    digits = F.regexp_extract(ref, "^[A-Za-z]+([0-9]+)$", 1)
    return F.when(digits == "", 0).otherwise(digits.cast("bigint") - 1).cast("int")


def rk_integer(value: Column) -> Column:
    """A packed integer (bit 1 set): shifted right by two with its sign, in hundredths if bit 0 is set. Other packed
    numbers give null; they hold half a double."""
    signed = F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value).cast("long")
    n = F.shiftright(signed, 2).cast("double")
    return F.when(value.bitwiseAND(2) == 0, None).otherwise(F.when(value.bitwiseAND(1) == 1, n / 100).otherwise(n))


def hex_color(r: Column, g: Column, b: Column) -> Column:
    """#RRGGBB of values rounded and clamped to 0..255."""
    c = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v + 0.5))).cast("int")
    return F.format_string("#%02X%02X%02X", c(r), c(g), c(b))


def image_kind(data: Column) -> Column:
    """Image type by the first bytes, or the empty string."""
    head = F.hex(F.substring(data, 1, 4))
    return F.when(head == "89504E47", "png").when(head.startswith("FFD8FF"), "jpg").when(head == "47494638", "gif").when(head.startswith("424D"), "bmp").when(head.isin("49492A00", "4D4D002A"), "tiff").otherwise("")


def has_controls(text: Column) -> Column:
    """Whether a decoded string holds control characters other than tab and line ends."""
    return text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")


def points(value: Column, unit: str) -> Column:
    """Lengths in points from the units of the formats."""
    scale = {"twip": 1 / 20, "emu": 1 / 12700, "mm": 72 / 25.4, "master": 1 / 8, "half": 1 / 2, "hundredth": 1 / 100}[unit]
    return value.cast("double") * scale


def kept_line(text: Column, confidence: Column, least: float = 0.5) -> Column:
    """Whether a recognised line stays: not blank and confident enough."""
    return (trimmed(text) != "") & (confidence >= least)
