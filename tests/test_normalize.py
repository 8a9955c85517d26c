import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliary.operators.normalize import cell_text, identifiers, page_text, run_texts, squeeze


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("关 于", "关于"), ("关\n于", "关于"), ("2022 年 1 月 21 日", "2022年1月21日"), ("2017 年 4 月\n24 日", "2017年4月24日"), ("2\t0\t26年", "2026年"),
        ("2 0 2 6 年 9 月", "2026年9月"), ("2026年9月2 9日", "2026年9月29日"), ("2026年1 - 3月", "2026年1-3月"), ("湘政办发〔 2 0 1 7〕 4 1号", "湘政办发〔2017〕41号"),
        ("国令第7 1 1号", "国令第711号"), ("说明书第 8页共 1 4 2页", "说明书第8页共142页"), ("第2 号", "第2号"), ("2 0个工作日", "20个工作日"), ("第9 . 8 . 1\n条", "第9.8.1条"),
        ("证券代码：6 0 0 5 1 9 ", "证券代码：600519 "), ("公告编号：2020－0 12", "公告编号：2020-012"), ("证券简称：S T 茅台", "证券简称：ST茅台"),
        ("证券代码：600519证券简称：ST 茅台", "证券代码：600519 证券简称：ST茅台"),
    ],
)
def test_golden(text, expected):
    assert page_text(text) == expected


@pytest.mark.parametrize("text", ["two words\nand a line", "1. item\n2. item", "0 9 9 9年", "1 3月", "3 2日", "证券代码：60051", "〔 2 0\t1 7〕", "第9条", "a\tb\n中\t国", ""])
def test_left_alone(text):
    assert page_text(text) == text


def test_rows_keep_their_ends():
    assert page_text("表\t一\n中\t国") == "表\t一\n中\t国"
    assert squeeze("中\n国", rows=True) == "中国"


def test_tables_are_protected():
    tsv = "名\n称"
    assert page_text(f"前\n{tsv}\n后", [tsv]) == f"前\n{tsv}\n后"
    assert page_text("含 ROW 名\n称", [tsv]).endswith("名\n称")


def test_runs_across_borders():
    assert run_texts(["中 ", "国", " x"]) == ["中", "国", " x"]


def test_cells_may_lose_tabs_in_dates():
    assert cell_text("2 0\t2 6年") == "2026年"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="中国年月日第号页共条. 0123456789\n\t　证券代码：〔〕公告编号-个工作日a", max_size=40))
def test_only_white_space_goes_and_twice_is_once(text):
    out = squeeze(text, rows=True)
    assert "".join(out.split()) == "".join(text.split())
    assert "".join(identifiers(text).split()) == "".join(text.split()).replace("－", "-") or "公告编号" in text
