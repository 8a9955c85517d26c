"""Queries over text functions: normalization, cells, HTML, references. Inputs are built from columns; the SQL builds
the expected text from the same columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import normalize as rules
from ..operators.tsv import table_tsv


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_normalized(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else rules.page_text(t))


def cells_normalized(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else rules.cell_text(t))


def normalized(df: DataFrame, text: Column, cell: bool = False) -> DataFrame:
    return df.withColumn("text", F.pandas_udf(cells_normalized if cell else pages_normalized, "string")(text))


def spaced(text: Column, gap: str = " ") -> Column:
    """A gap after every character but the last."""
    return F.regexp_replace(text.cast("string"), "(?<=.)(?=.)", gap)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || '年' AS text FROM orders")
def norm_year(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return normalized(o.select("o_orderkey", F.concat(spaced(F.year("o_orderdate"), "\t "), F.lit(" 年")).alias("_t")), F.col("_t")).select("o_orderkey", "text")


@query("SELECT o_orderkey, year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' AS text FROM orders")
def norm_month_day(spark, sf_dir):
    d = F.concat(F.year("o_orderdate").cast("string"), F.lit(" 年 "), spaced(F.month("o_orderdate")), F.lit(" 月\n"), spaced(F.dayofmonth("o_orderdate")), F.lit(" 日"))
    return normalized(table(spark, sf_dir, "orders").select("o_orderkey", d.alias("_t")), F.col("_t")).select("o_orderkey", "text")


@query("SELECT o_orderkey, '2026年' || (1 + month(o_orderdate) % 9) || '-' || (1 + day(o_orderdate) % 12) || '月' AS text FROM orders")
def norm_date_range(spark, sf_dir):
    d = F.concat(F.lit("2026年"), (1 + F.month("o_orderdate") % 9).cast("string"), F.lit(" - "), (1 + F.dayofmonth("o_orderdate") % 12).cast("string"), F.lit("月"))
    return normalized(table(spark, sf_dir, "orders").select("o_orderkey", d.alias("_t")), F.col("_t")).select("o_orderkey", "text")


@query("SELECT p_partkey, p_size || '个工作日' AS text FROM part")
def norm_workday(spark, sf_dir):
    d = F.concat(spaced(F.col("p_size")), F.lit(" 个工 作\n日"))
    return normalized(table(spark, sf_dir, "part").select("p_partkey", d.alias("_t")), F.col("_t")).select("p_partkey", "text")


@query("SELECT s_suppkey, '中国人民' || s_suppkey || ' 号公司 ' || s_suppkey || ' 号' AS text FROM supplier")
def norm_han_space(spark, sf_dir):
    """White space between Chinese characters goes, between a digit and one it stays."""
    k = F.col("s_suppkey").cast("string")
    d = F.concat(F.lit("中 国\n人　民"), k, F.lit(" 号 公 \u00a0司 "), k, F.lit(" 号"))
    return normalized(table(spark, sf_dir, "supplier").select("s_suppkey", d.alias("_t")), F.col("_t")).select("s_suppkey", "text")


@query("SELECT l_orderkey, l_linenumber, '第' || l_linenumber || '页共' || CAST(l_quantity AS INTEGER) || '页' AS text FROM lineitem")
def norm_page_ref(spark, sf_dir):
    d = F.concat(F.lit("第 "), F.col("l_linenumber").cast("string"), F.lit(" 页共 "), spaced(F.col("l_quantity").cast("int")), F.lit("页"))
    return normalized(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", d.alias("_t")), F.col("_t")).select("l_orderkey", "l_linenumber", "text")


@query("SELECT l_orderkey, l_linenumber, '第' || l_linenumber || '.' || CAST(l_quantity AS INTEGER) || '条' AS text FROM lineitem")
def norm_article(spark, sf_dir):
    d = F.concat(F.lit("第"), F.col("l_linenumber").cast("string"), F.lit(" . "), spaced(F.col("l_quantity").cast("int")), F.lit("\n条"))
    return normalized(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", d.alias("_t")), F.col("_t")).select("l_orderkey", "l_linenumber", "text")


@query("SELECT o_orderkey, '第' || (o_orderkey % 1000000) || '号' AS text FROM orders")
def norm_ordinal(spark, sf_dir):
    d = F.concat(F.lit("第 \n"), (F.col("o_orderkey") % 1000000).cast("string"), F.lit(" 号"))
    return normalized(table(spark, sf_dir, "orders").select("o_orderkey", d.alias("_t")), F.col("_t")).select("o_orderkey", "text")


@query("SELECT o_orderkey, '湘政办发〔' || year(o_orderdate) || '〕' || (o_orderkey % 100000) || '号' AS text FROM orders")
def norm_doc_number(spark, sf_dir):
    d = F.concat(F.lit("湘政办发〔 "), spaced(F.year("o_orderdate")), F.lit("〕 "), spaced(F.col("o_orderkey") % 100000), F.lit(" 号"))
    return normalized(table(spark, sf_dir, "orders").select("o_orderkey", d.alias("_t")), F.col("_t")).select("o_orderkey", "text")


@query("SELECT p_partkey, '国令第' || p_partkey % 1000000 || '号' AS text FROM part")
def norm_state_order(spark, sf_dir):
    d = F.concat(F.lit("国令第"), spaced(F.col("p_partkey") % 1000000), F.lit(" 号"))
    return normalized(table(spark, sf_dir, "part").select("p_partkey", d.alias("_t")), F.col("_t")).select("p_partkey", "text")


@query("SELECT c_custkey, '证券代码：' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') AS text FROM customer")
def norm_securities_code(spark, sf_dir):
    d = F.concat(F.lit("证券代码：　"), spaced(F.lpad((F.col("c_custkey") % 1000000).cast("string"), 6, "0")))
    return normalized(table(spark, sf_dir, "customer").select("c_custkey", d.alias("_t")), F.col("_t")).select("c_custkey", "text")


@query("SELECT o_orderkey, '公告编号：' || year(o_orderdate) || '-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS text FROM orders")
def norm_announcement(spark, sf_dir):
    d = F.concat(F.lit("公告编号： "), spaced(F.year("o_orderdate")), F.lit(" － "), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"))
    return normalized(table(spark, sf_dir, "orders").select("o_orderkey", d.alias("_t")), F.col("_t")).select("o_orderkey", "text")


@query("SELECT p_partkey, '证券简称：' || regexp_replace(p_brand, '[^A-Za-z]', '', 'g') || '股份' AS text FROM part")
def norm_securities_name(spark, sf_dir):
    d = F.concat(F.lit("证券简称： "), spaced(F.regexp_replace("p_brand", "[^A-Za-z]", "")), F.lit(" 股份"))
    return normalized(table(spark, sf_dir, "part").select("p_partkey", d.alias("_t")), F.col("_t")).select("p_partkey", "text")


@query("SELECT n_nationkey, '国家' || chr(9) || '日期' || chr(10) || n_name || chr(9) || '2026年1月' || chr(10) || '合计' || chr(9) || '3' AS text FROM nation")
def norm_tsv_guard(spark, sf_dir):
    d = F.concat(F.lit("国 家\t日期\n"), F.col("n_name"), F.lit("\t2026 年 1 月\n合计\t3"))
    return normalized(table(spark, sf_dir, "nation").select("n_nationkey", d.alias("_t")), F.col("_t")).select("n_nationkey", "text")


@query()
def norm_cells(spark, sf_dir):
    """All cells through the post-pass; no SQL can express it."""
    return normalized(table(spark, sf_dir, "table_cells").select("cell_id", F.col("text").alias("_t")), F.col("_t"), cell=True).select("cell_id", "text").distinct()


#: White space of all scripts as SQL, and a list of lines trimmed of it.
_SPACES = " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))


@query(
    f"""SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10) || chr(10) || 'end', chr(10)),
 lambda x: trim(x, {_SPACES})), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), {_SPACES}) AS text FROM documents"""
)
def html_text(spark, sf_dir):
    """Text of pages built from all documents: what was put between the tags comes back, line by line."""
    t = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<html><head><title>t</title></head><body><p>"), t, F.lit("</p><br/><b>end</b></body></html>"))
    return table(spark, sf_dir, "documents").select("doc_id", C.html_text(page).alias("text"))


@query("SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]', '', 'g')) >= 16 AS native FROM documents")
def native_text_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.has_native_text(F.col("text")).alias("native"))


@query(
    """SELECT doc_id, CAST(round((tabs * 2 + sp * 0.5 + asc_ * 0.55 + (n - tabs - sp - asc_ - wide) * 0.8 + wide) * 11, 4) AS DOUBLE) AS width FROM (SELECT doc_id, length(text) AS n,
 length(text) - length(replace(text, chr(9), '')) AS tabs, length(text) - length(regexp_replace(text, '[ \\n\\r\\f\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g')) AS sp,
 length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0e-\\x1f!-\\x7f]', '', 'g')) AS asc_, length(text) - length(regexp_replace(text, '[\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul}]', '', 'g')) AS wide FROM documents WHERE text IS NOT NULL)"""
)
def rune_width(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.round(C.text_width(F.col("text"), 11.0), 4).alias("width"))


@query(
    f"""SELECT doc_id, CASE WHEN p IS NULL THEN NULL WHEN len(p) = 0 THEN '' ELSE list_reduce(p, lambda a, b: CASE WHEN regexp_matches(a, '[0-9A-Za-z]$') AND regexp_matches(b, '^[0-9A-Za-z]') THEN a || ' ' || b ELSE a || b END) END AS text
 FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\\r\\n\\t]+'), lambda x: trim(x, {_SPACES})), lambda x: x <> '') AS p FROM documents)"""
)
def flatten_cell(spark, sf_dir):
    """All documents on one line each."""
    return table(spark, sf_dir, "documents").select("doc_id", C.flatten_cell(F.col("text")).alias("text"))


@query("SELECT n_regionkey, string_agg(n_nationkey || chr(9) || n_name || chr(9), chr(10) ORDER BY n_nationkey) AS tsv FROM nation GROUP BY n_regionkey")
def table_tsv_query(spark, sf_dir):
    """Tables of three columns, the third without cells in any row but spanned by the second."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        rows = [[(0, 1, str(r.n_nationkey)), (1, 2, r.n_name)] for r in f.sort_values("n_nationkey").itertuples()]
        return pd.DataFrame([(key[0], table_tsv(rows))], columns=["n_regionkey", "tsv"])

    return n.groupBy("n_regionkey").applyInPandas(run, "n_regionkey int, tsv string")


@query("SELECT path, CASE WHEN contains(f, '.') THEN lower('.' || list_last(string_split(f, '.'))) ELSE '' END AS extension FROM (SELECT DISTINCT path, list_last(string_split(path, '/')) AS f FROM source_files)")
def format_dispatch(spark, sf_dir):
    return table(spark, sf_dir, "source_files").select("path").distinct().select("path", C.extension(F.col("path")).alias("extension"))


@query("SELECT p_partkey, CAST(p_partkey % 702 AS INTEGER) AS col, CAST(p_size - 1 AS INTEGER) AS row FROM part")
def cell_ref(spark, sf_dir):
    k = F.col("p_partkey") % 702
    first = F.when(k < 26, "").otherwise(F.char((F.floor(k / 26) + 64).cast("int")))
    ref = F.concat(first, F.char((k % 26 + 65).cast("int")), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", C.cell_column(ref).alias("col"), C.cell_row(ref).alias("row"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN v / 100.0 ELSE CAST(v AS DOUBLE) END AS value FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) - 25 AS v FROM lineitem)")
def rk_decode(spark, sf_dir):
    v = F.col("l_quantity").cast("long") - 25
    packed = F.pmod(v * 4, F.lit(1 << 32)) + 2 + F.col("l_linenumber") % 2
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.rk_integer(packed.cast("long")).alias("value"))


@query("SELECT l_orderkey, l_linenumber, printf('#%02X%02X%02X', CAST(l_quantity AS INTEGER), CAST(floor(least(255, l_extendedprice) + 0.5) AS INTEGER), 0) AS color FROM lineitem")
def color_format(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.hex_color(F.col("l_quantity"), F.col("l_extendedprice"), F.lit(-3.0)).alias("color"))


@query("SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'bmp' WHEN 4 THEN 'tiff' ELSE '' END AS kind FROM nation")
def image_sniff(spark, sf_dir):
    heads = ["89504E470D0A", "FFD8FFE000", "474946383961", "424D0000", "49492A0008", "00010203"]
    data = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("n_nationkey") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "nation").select("n_nationkey", C.image_kind(data).alias("kind"))


@query("SELECT DISTINCT run_id, regexp_matches(text, '[\\x00-\\x08\\x0b\\f\\x0e-\\x1f\\x7f-\\x{9f}]') AS controls FROM text_runs WHERE text IS NOT NULL")
def control_runs(spark, sf_dir):
    return table(spark, sf_dir, "text_runs").where("text IS NOT NULL").select("run_id", C.has_controls(F.col("text")).alias("controls")).distinct()


@query("SELECT page_id, regexp_replace(regexp_replace(text, '^[\\s\\x0b\\x{85}\\p{Z}]+', ''), '[\\s\\x0b\\x{85}\\p{Z}]+$', '') AS text FROM (SELECT DISTINCT page_id, text FROM doc_pages WHERE text IS NOT NULL)")
def unicode_trim(spark, sf_dir):
    return table(spark, sf_dir, "doc_pages").where("text IS NOT NULL").select("page_id", C.trimmed(F.col("text")).alias("text")).distinct()


@query("SELECT DISTINCT page_id, round(CASE WHEN page_no % 2 = 0 THEN width * 20 / 20 ELSE height * 12700 / 12700 END, 6) AS points FROM doc_pages WHERE width IS NOT NULL")
def unit_points(spark, sf_dir):
    p = table(spark, sf_dir, "doc_pages").where("width IS NOT NULL")
    return p.select("page_id", F.round(F.when(F.col("page_no") % 2 == 0, C.points(F.col("width") * 20, "twip")).otherwise(C.points(F.col("height") * 12700, "emu")), 6).alias("points")).distinct()


def corpus_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through the post-pass; no SQL can express it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(text=[rules.page_text(t) for t in f["text"]])

    return table(spark, sf_dir, "doc_pages").where("text IS NOT NULL").select("page_id", "text").mapInPandas(run, "page_id long, text string").distinct()


QUERIES["corpus_normalized"] = corpus_normalized
QUERIES["table_tsv"] = QUERIES.pop("table_tsv_query")
SQL["table_tsv"] = SQL.pop("table_tsv_query")
