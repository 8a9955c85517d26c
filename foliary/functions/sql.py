"""Functions for SQL sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..formats.common import sniff
from ..formats.html import text_of
from ..operators import normalize
from ..operators.tsv import flatten
from ..sources.documents import parse


def _each(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else f(v))

    return run


class ExtractPages:
    """One row per page of a file; a file without pages gives one row with its status."""

    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        d = parse(path, content)
        for p in d["pages"] or [{"number": None, "name": None, "text": None}]:
            yield d["status"], d["error"], d["format"], p["number"], p["name"], p["text"]


def register(spark: SparkSession) -> None:
    """normalize_page, normalize_cell, normalize_identifiers, flatten_cell, html_text, image_kind and the table function
    extract_pages(path, content). Nulls give null."""
    for name, f in {"normalize_page": normalize.page_text, "normalize_cell": normalize.cell_text, "normalize_identifiers": normalize.identifiers, "flatten_cell": flatten, "html_text": text_of}.items():
        spark.udf.register(name, F.pandas_udf(_each(f), "string"))
    spark.udf.register("image_kind", F.pandas_udf(_each(lambda b: sniff(bytes(b))), "string"))
    spark.udtf.register("extract_pages", F.udtf(ExtractPages, returnType="status string, error string, format string, page_no int, name string, text string"))
