"""Queries over whole tables against brute force on a small fixture."""

import re

import pytest

from foliary import catalogue

SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TEXTS = [None, "", "plain text", "a & b > c < d &amp; &lt;p&gt; &nbsp;", "因为送往青云的货物\u3000\n\n\n\n晚了", "Он сказал:\xa0да\n Ещё", "\u2003ไทย\thindi हिन्दी\r\nÉté", "x\t\t1\n2\ny, z\u2028", "汉" * 100, "\n".join(["汉" * 100] * 20), "\n".join(["x"] * 51), "x" * 79]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(TEXTS)), "cell_id long, text string").write.parquet(f"{d}/table_cells.parquet")
    return d


def result(spark, folder, name):
    return {r[0]: r[1] for r in catalogue.queries()[name](spark, folder).collect()}


def test_html_text(spark, folder):
    def brute(t):
        lines = [x.strip(SPACES) for x in (t.replace("\r\n", "\n").replace("\r", "\n") + "\n\nend").split("\n")]
        return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip(SPACES)

    assert result(spark, folder, "html_text") == {i: t if t is None else brute(t) for i, t in enumerate(TEXTS)}


def test_flatten_cell(spark, folder):
    def brute(t):
        out = ""
        for p in re.split("[\r\n\t]+", t):
            p = p.strip(SPACES)
            ascii_word = out and p and re.match("[0-9A-Za-z]", out[-1]) and re.match("[0-9A-Za-z]", p[0])
            out += (" " if ascii_word else "") + p
        return out

    assert result(spark, folder, "flatten_cell") == {i: t if t is None else brute(t) for i, t in enumerate(TEXTS)}


def test_paginate(spark, folder):
    """41 wide characters of 11 points fill a line of 451.28, 50 lines a page; 1 page at least."""
    got = result(spark, folder, "paginate_auto")
    assert set(got) == {i for i, t in enumerate(TEXTS) if t}
    assert {i: n for i, n in got.items() if n != 1} == {9: 2, 10: 2}


def test_cells(spark, folder):
    got = result(spark, folder, "norm_cells")
    assert len(got) == len(TEXTS) and got[0] is None and got[2] == "plain text" and got[3] == TEXTS[3] and got[8] == TEXTS[8]
    assert got[4] == "因为送往青云的货物晚了"
