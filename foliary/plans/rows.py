"""Queries over flat rows: runs, rules, cells, images, sheets and layout, each with its SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import kept_line
from ..ocr import decode, turned
from ..operators import grid
from ..operators import relational as R
from ..operators.paginate import Options, Paragraph, lines_of, paginate
from ..sources.documents import page_totals, summary
from .text import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_runs").drop("loaded_at").dropDuplicates(["run_id"])


_RUNS = "(SELECT DISTINCT ON (run_id) * FROM text_runs)"


@query(
    f"""SELECT path, page_no, string_agg(lead || text, '' ORDER BY seq, run_id) AS text FROM (SELECT *, CASE WHEN lag(seq) OVER w IS NULL THEN ''
 WHEN abs(y - lag(y) OVER w) > 0.55 * greatest(font_size, lag(font_size) OVER w) THEN chr(10) WHEN x - lag(x + width) OVER w > 0.2 * greatest(font_size, lag(font_size) OVER w) THEN ' ' ELSE '' END AS lead
 FROM {_RUNS} WHERE text <> '' WINDOW w AS (PARTITION BY path, page_no ORDER BY seq)) GROUP BY path, page_no"""
)
def pdf_line_text(spark, sf_dir):
    return R.line_text(_runs(spark, sf_dir))


@query(
    f"""SELECT path, page_no, min(seq) AS seq, string_agg(text, '' ORDER BY seq) AS text, round(sum(width), 4) AS width, max(height) AS height FROM (SELECT *, sum(n) OVER (PARTITION BY path, page_no ORDER BY seq) AS g FROM
 (SELECT *, CASE WHEN coalesce(font IS NOT DISTINCT FROM lag(font) OVER w AND font_size IS NOT DISTINCT FROM lag(font_size) OVER w AND color IS NOT DISTINCT FROM lag(color) OVER w
 AND abs(y - lag(y) OVER w) < 0.01 AND abs(lag(x + width) OVER w - x) < 0.01, false) THEN 0 ELSE 1 END AS n FROM (SELECT path, page_no, seq, text, font, font_size, color, width, height, y, 10.0 * seq AS x, 10.0 AS w_
 FROM {_RUNS} WHERE text <> '') WINDOW w AS (PARTITION BY path, page_no ORDER BY seq))) GROUP BY path, page_no, g"""
)
def run_merge(spark, sf_dir):
    """Runs moved so that neighbours of 10 points touch."""
    r = _runs(spark, sf_dir).withColumn("x", 10.0 * F.col("seq"))
    m = R.merged_runs(r)
    return m.select("path", "page_no", "seq", "text", F.round("width", 4).alias("width"), "height")


@query(f"SELECT path, page_no, round(min(x), 4) AS x, round(min(y), 4) AS y, round(max(x + width) - min(x), 4) AS width, round(max(y + height) - min(y), 4) AS height FROM {_RUNS} WHERE width <> 0 OR height <> 0 GROUP BY path, page_no")
def rect_union(spark, sf_dir):
    b = R.bounds(_runs(spark, sf_dir), ["path", "page_no"])
    return b.select("path", "page_no", *(F.round(c, 4).alias(c) for c in ("x", "y", "width", "height")))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments on an exact lattice: the left and upper border of every table cell, in steps of 60 by 20."""
    c = table(spark, sf_dir, "table_cells").select("path", "page_no", "table_id", "row_idx", "col_idx").distinct()
    x, y = F.col("col_idx") * 60.0, F.col("row_idx") * 20.0 + F.col("table_id") * 10000.0
    side = lambda a, b, c_, d: F.struct(a.alias("x1"), b.alias("y1"), c_.alias("x2"), d.alias("y2"))
    return c.select("path", "page_no", F.explode(F.array(side(x, y, x + 60, y), side(x, y + 20, x + 60, y + 20), side(x, y, x, y + 20), side(x + 60, y, x + 60, y + 20))).alias("s")).select("path", "page_no", "s.*").distinct()


_CELLS = "(SELECT DISTINCT path, page_no, table_id, row_idx, col_idx FROM table_cells)"
_SEG = f"""(SELECT DISTINCT path, page_no, x1, y1, x2, y2 FROM (SELECT path, page_no, col_idx * 60e0 AS x, row_idx * 20e0 + table_id * 10000e0 AS y FROM {_CELLS}), LATERAL (
 SELECT x AS x1, y AS y1, x + 60 AS x2, y AS y2 UNION ALL SELECT x, y + 20, x + 60, y + 20 UNION ALL SELECT x, y, x, y + 20 UNION ALL SELECT x + 60, y, x + 60, y + 20))"""
_RULES = f"""(SELECT path, page_no, CASE WHEN abs(y2 - y1) <= 3 AND abs(x2 - x1) >= 4 THEN 'h' ELSE 'v' END AS orientation, CASE WHEN abs(y2 - y1) <= 3 THEN (y1 + y2) / 2 ELSE (x1 + x2) / 2 END AS coordinate,
 CASE WHEN abs(y2 - y1) <= 3 THEN least(x1, x2) ELSE least(y1, y2) END AS start, CASE WHEN abs(y2 - y1) <= 3 THEN greatest(x1, x2) ELSE greatest(y1, y2) END AS stop FROM {_SEG})"""
_MERGED = f"""(SELECT path, page_no, orientation, coordinate, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(n) OVER (PARTITION BY path, page_no, orientation, coordinate ORDER BY start, stop) AS g FROM
 (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY path, page_no, orientation, coordinate ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS n FROM {_RULES})) GROUP BY path, page_no, orientation, coordinate, g)"""


@query(f"SELECT path, page_no, orientation, count(*) AS rules, sum(stop - start) AS length FROM {_RULES} GROUP BY path, page_no, orientation")
def segment_classify(spark, sf_dir):
    return R.classified(_segments(spark, sf_dir)).groupBy("path", "page_no", "orientation").agg(F.count("*").alias("rules"), F.sum(F.col("stop") - F.col("start")).alias("length"))


@query(f"SELECT * FROM {_MERGED}")
def rule_merge(spark, sf_dir):
    return R.merged_rules(R.classified(_segments(spark, sf_dir))).select("path", "page_no", "orientation", "coordinate", "start", "stop")


@query(f'SELECT path, page_no, col_idx * 60e0 AS "left", row_idx * 20e0 + table_id * 10000e0 AS low, col_idx * 60e0 + 60 AS "right", row_idx * 20e0 + table_id * 10000e0 + 20 AS high FROM {_CELLS}')
def grid_cells(spark, sf_dir):
    """Ruled grids give back the cells they were drawn from."""
    return R.grid_cells(R.merged_rules(R.classified(_segments(spark, sf_dir))))


def _lattice_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "table_cells").select("path", "page_no", "table_id", "row_idx", "col_idx").distinct()
    x, y = F.col("col_idx") * 60.0, F.col("row_idx") * 20.0 + F.col("table_id") * 10000.0
    return c.select("path", "page_no", x.alias("left"), y.alias("low"), (x + 60).alias("right"), (y + 20).alias("high"))


@query(f'SELECT path, page_no, table_id * 1000000 + row_idx * 1000 + col_idx AS seq, col_idx * 60e0 AS "left", row_idx * 20e0 + table_id * 10000e0 AS low, 2e0 AS score FROM {_CELLS}')
def run_to_cell(spark, sf_dir):
    """A run inside every cell."""
    c = table(spark, sf_dir, "table_cells").select("path", "page_no", "table_id", "row_idx", "col_idx").distinct()
    x, y = F.col("col_idx") * 60.0, F.col("row_idx") * 20.0 + F.col("table_id") * 10000.0
    runs = c.select("path", "page_no", (F.col("table_id") * 1000000 + F.col("row_idx") * 1000 + F.col("col_idx")).alias("seq"), (x + 5).alias("x"), (y + 4).alias("y"), F.lit(40.0).alias("width"), F.lit(10.0).alias("height"))
    return R.runs_to_cells(runs, _lattice_cells(spark, sf_dir))


_CLIPS = f"(SELECT run_id, path, page_no, x, y, width, height FROM {_RUNS} WHERE width > 0 AND height > 0 UNION ALL SELECT -run_id, path, page_no, x - 1, y - 1, width * 2 + 2, height * 2 + 2 FROM {_RUNS} WHERE width > 0 AND height > 0 AND run_id % 3 = 0)"


@query(
    f"""SELECT run_id FROM {_CLIPS} a WHERE NOT EXISTS (SELECT 1 FROM {_CLIPS} b WHERE a.path = b.path AND a.page_no = b.page_no AND a.run_id <> b.run_id AND a.x <= b.x AND a.y <= b.y
 AND a.x + a.width >= b.x + b.width AND a.y + a.height >= b.y + b.height AND a.width * a.height > 1.5 * b.width * b.height)"""
)
def clip_container_anti(spark, sf_dir):
    r = _runs(spark, sf_dir).where("width > 0 AND height > 0").select("run_id", "path", "page_no", "x", "y", "width", "height")
    outer = r.where("run_id % 3 = 0").select((-F.col("run_id")).alias("run_id"), "path", "page_no", (F.col("x") - 1).alias("x"), (F.col("y") - 1).alias("y"), (F.col("width") * 2 + 2).alias("width"), (F.col("height") * 2 + 2).alias("height"))
    return R.outer_rects(r.unionByName(outer), "run_id").select("run_id")


@query(
    f"""SELECT run_id, arg_min(col_idx, (abs(x - col_idx * 60.0), col_idx)) AS idx FROM {_RUNS} r JOIN (SELECT DISTINCT path, page_no, col_idx FROM table_cells) USING (path, page_no) GROUP BY run_id"""
)
def nearest_grid_line(spark, sf_dir):
    lines = table(spark, sf_dir, "table_cells").select("path", "page_no", F.col("col_idx").alias("idx"), (F.col("col_idx") * 60.0).alias("at")).distinct()
    values = _runs(spark, sf_dir).select("run_id", "path", "page_no", "x")
    return R.nearest_line(values, lines, "x", "at", "idx").select("run_id", "idx")


@query(
    """SELECT path, sheet, string_agg(line, chr(10) ORDER BY row) AS text FROM (SELECT path, sheet, row, regexp_replace(string_agg(coalesce(v, ''), chr(9) ORDER BY c), '\\t+$', '') AS line FROM
 (SELECT p.path, p.sheet, p.row, c.c, t.value AS v FROM (SELECT path, page_no AS sheet, row_idx AS row, max(col_idx) AS m FROM table_cells GROUP BY ALL) p JOIN (SELECT unnest(range(0, 64)) AS c) c ON c.c <= p.m
 LEFT JOIN (SELECT path, page_no AS sheet, row_idx AS row, col_idx AS c, max(text) AS value FROM table_cells WHERE table_id = 1 GROUP BY ALL) t ON t.path = p.path AND t.sheet = p.sheet AND t.row = p.row AND t.c = c.c) GROUP BY path, sheet, row) WHERE line <> '' GROUP BY path, sheet"""
)
def sheet_text(spark, sf_dir):
    c = table(spark, sf_dir, "table_cells").where("table_id = 1").groupBy("path", F.col("page_no").alias("sheet"), F.col("row_idx").alias("row"), F.col("col_idx").alias("col")).agg(F.max("text").alias("value"))
    return R.sheet_text(c)


@query("SELECT p_partkey, CASE WHEN p_partkey % 25 < 20 THEN b.p_brand ELSE CAST(p_partkey % 25 AS VARCHAR) END AS value FROM part LEFT JOIN (SELECT row_number() OVER (ORDER BY p_brand) - 1 AS idx, p_brand FROM (SELECT DISTINCT p_brand FROM part)) b ON b.idx = p_partkey % 25 AND b.idx < 20")
def shared_string_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    brands = p.select("p_brand").distinct().withColumn("idx", F.row_number().over(Window.orderBy("p_brand")) - 1).where("idx < 20").select(F.lit("f").alias("path"), "idx", F.col("p_brand").alias("value"))
    return R.with_shared_strings(p.select("p_partkey", F.lit("f").alias("path"), (F.col("p_partkey") % 25).cast("string").alias("raw")), brands).select("p_partkey", "value")


@query("SELECT p_partkey, CASE WHEN p_size % 10 < 8 THEN 'font' || (p_size % 10) % 5 ELSE 'font0' END AS font_name FROM part")
def style_resolve(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit("f").alias("path"), (F.col("p_size") % 10).alias("style"))
    fixed = lambda n, *cols: spark.range(n).select(F.lit("f").alias("path"), F.col("id").cast("int").alias("idx"), *cols)
    return R.with_fonts(p, fixed(8, (F.col("id") % 5).cast("int").alias("font_idx")), fixed(5, F.concat(F.lit("font"), F.col("id").cast("string")).alias("name"))).select("p_partkey", "font_name")


@query("SELECT kind, size, min(event_id) AS event_id FROM (SELECT event_type AS kind, CAST(floor(value) AS BIGINT) AS size, event_id FROM events) GROUP BY kind, size")
def image_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.floor("value").alias("size"), "event_id")
    return R.first_of(e, ["kind", "size"], "event_id")


@query(
    f"""SELECT run_id FROM (SELECT run_id, w, h, row_number() OVER (PARTITION BY path, page_no ORDER BY w * h DESC, seq) AS r, max(CASE WHEN w >= 512 AND h >= 512 THEN 1 ELSE 0 END) OVER (PARTITION BY path, page_no) AS any_big,
 first(w >= 512 AND h >= 512) OVER (PARTITION BY path, page_no ORDER BY w * h DESC, seq) AS big FROM (SELECT run_id, path, page_no, seq, CAST(abs(run_id) % 900 AS INTEGER) AS w, CAST(seq % 700 + 20 AS INTEGER) AS h FROM {_RUNS}) WHERE w >= 64 AND h >= 32) WHERE r = 1 OR NOT big"""
)
def image_area_top1(spark, sf_dir):
    i = _runs(spark, sf_dir).select("run_id", "path", "page_no", "seq", (F.abs("run_id") % 900).cast("int").alias("width"), (F.col("seq") % 700 + 20).cast("int").alias("height"), F.lit(1).alias("size"))
    return R.recognition_images(i).select("run_id")


@query(
    """SELECT l_orderkey, l_linenumber, round(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 500 / sum(l_quantity) OVER (PARTITION BY l_orderkey), 4) AS "offset"
 FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)"""
)
def table_offsets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity")).withColumn("whole", F.lit(500.0))
    return R.offsets(li, ["l_orderkey"], "l_linenumber", "l_quantity", "whole").select("l_orderkey", "l_linenumber", F.round("offset", 4).alias("offset"))


@query("SELECT user_id, event_id, symbol FROM (SELECT user_id, event_id, symbol, lag(symbol) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 3 AS symbol FROM events)) WHERE symbol <> 0 AND (p IS NULL OR p <> symbol)")
def ctc_collapse(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value") % 3).alias("symbol"))
    return R.collapsed(e, ["user_id"], "event_id", "symbol").select("user_id", "event_id", "symbol")


@query("SELECT vec_id, 1 / (1 + exp(a - b)) >= 0.55 AND b > a AS rotate FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)")
def orientation_softmax(spark, sf_dir):
    """Whether the classifier step turns a crop, from two raw outputs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw = np.array([e[:2] for e in f.embedding], float).reshape(-1, 2)
            yield pd.DataFrame({"vec_id": f.vec_id, "rotate": [bool(turned(x[None], 0.55)[0]) for x in raw]})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, rotate boolean")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN s IS NULL OR CAST(l_extendedprice AS BIGINT) >= s + 500 THEN NULL ELSE CAST(s AS VARCHAR) END AS style FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(floor(CAST(l_extendedprice AS BIGINT) / 1000.0) * 1000 AS BIGINT) AS s FROM lineitem)"""
)
def style_as_of(spark, sf_dir):
    """Intervals of 500 from every thousand on; positions are prices, all of one file."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("f").alias("path"), F.round("l_extendedprice").cast("bigint").alias("fc"))
    top = li.select((F.floor(F.max("fc") / 1000) + 1).alias("n"))
    styles = top.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n"))).alias("k")).select(F.lit("f").alias("path"), (F.col("k") * 1000).alias("start"), (F.col("k") * 1000 + 500).alias("stop"), (F.col("k") * 1000).cast("string").alias("style"))
    spots = li.select("path", "fc").distinct()
    found = R.style_at(spots, styles)
    return li.join(found.select("fc", "style"), "fc", "left").select("l_orderkey", "l_linenumber", "style")


@query()
def paginate_auto(spark, sf_dir):
    """Pages of all documents with text, whose lines may wrap and be of any script; SQL can't wrap lines."""
    return _pages_of(table(spark, sf_dir, "documents").where("text <> ''"))


def _pages_of(d: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "pages": [len(paginate([Paragraph(runs=[_run(x)] if x else []) for x in t.split("\n")])) for t in f.text]})

    return d.select("doc_id", "text").mapInPandas(run, "doc_id long, pages int")


def _run(text: str) -> dict:
    return {"text": text, "font": "", "size": 11.0, "color": "#000000", "bounds": {"x": 0.0, "y": 0.0, "width": 0.0, "height": 0.0}}


@query()
def paginate_target(spark, sf_dir):
    """Documents shared out over a known number of pages, one for every 600 characters."""
    d = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "pages": [len(paginate([Paragraph(runs=[_run(t)])], Options(target_pages=1 + len(t) // 600))) for t in f.text]})

    return d.mapInPandas(run, "doc_id long, pages int")


@query()
def line_wrap(spark, sf_dir):
    """Number and total height of the lines that each document's text fills."""
    d = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [lines_of([Paragraph(runs=[_run(t)])], 451.28) for t in f.text]
            yield pd.DataFrame({"doc_id": f.doc_id, "lines": [len(m) for m in made], "height": [sum(x.height for x in m) for m in made]})

    return d.mapInPandas(run, "doc_id long, lines int, height double")


@query(f"SELECT path, page_no, count(DISTINCT table_id) AS grids, count(*) AS cells FROM {_CELLS} GROUP BY path, page_no")
def connected_cells(spark, sf_dir):
    """Grids of touching cells on each page; tables on the lattice lie far apart."""
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        groups = grid.connected(list(f[["left", "low", "right", "high"]].itertuples(index=False, name=None)), 3.0)
        return pd.DataFrame([(*key, len(groups), sum(map(len, groups)))], columns=["path", "page_no", "grids", "cells"])

    return _lattice_cells(spark, sf_dir).groupBy("path", "page_no").applyInPandas(run, "path string, page_no int, grids long, cells long")


@query(f"SELECT path, page_no, count(DISTINCT table_id) AS tables, count(*) AS cells, sum(CAST(row_idx AS BIGINT)) AS rows_, sum(CAST(col_idx AS BIGINT)) AS cols_ FROM {_CELLS} GROUP BY path, page_no HAVING count(*) > 0")
def ruled_tables(spark, sf_dir):
    """The whole grid detection per page, from segments to tables with rows and columns; upward pages read from the top."""
    style = grid.Style(ascending=True)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        tables, _ = grid.detect([], list(f[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None)), style)
        cells = [c for t in tables for r in t["rows"] for c in r["cells"]]
        return pd.DataFrame([(*key, len(tables), len(cells), sum(c["row"] for c in cells), sum(c["column"] for c in cells))], columns=["path", "page_no", "tables", "cells", "rows_", "cols_"])

    return _segments(spark, sf_dir).groupBy("path", "page_no").applyInPandas(run, "path string, page_no int, tables long, cells long, rows_ long, cols_ long").where("cells > 0")


@query(f"SELECT path, page_no, string_agg(line, chr(10) ORDER BY y) AS text FROM (SELECT path, page_no, y, string_agg(text, '' ORDER BY x, run_id) AS line FROM (SELECT run_id, path, page_no, text, 100.0 * (seq // 3) AS y, 10.0 * (seq % 3) AS x FROM {_RUNS} WHERE text <> '') GROUP BY path, page_no, y) GROUP BY path, page_no")
def ofd_line_text(spark, sf_dir):
    """Anchor lines on an exact grid of three runs a line."""
    r = _runs(spark, sf_dir).where("text <> ''").select("path", "page_no", "run_id", "text", (100.0 * F.floor(F.col("seq") / 3)).alias("y"), (10.0 * (F.col("seq") % 3)).alias("x"))

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        runs = [{"text": t, "size": 10.0, "bounds": {"x": x, "y": y}} for t, x, y in f.sort_values("run_id")[["text", "x", "y"]].itertuples(index=False, name=None)]
        return pd.DataFrame([(*key, grid.lines_by_anchor(runs))], columns=["path", "page_no", "text"])

    return r.groupBy("path", "page_no").applyInPandas(run, "path string, page_no int, text string")


@query("SELECT DISTINCT line_id, regexp_matches(text, '[^\\s\\x0b\\x{85}\\p{Z}]') AND confidence >= 0.5 AS kept FROM ocr_lines")
def confidence_filter(spark, sf_dir):
    return table(spark, sf_dir, "ocr_lines").select("line_id", kept_line(F.col("text"), F.col("confidence")).alias("kept")).distinct()


@query("SELECT path, count(*) AS pages, CAST(sum(CASE WHEN text IS NULL THEN 0 ELSE length(text) END) AS BIGINT) AS characters FROM (SELECT DISTINCT page_id, path, text FROM doc_pages) GROUP BY path")
def document_stats(spark, sf_dir):
    p = table(spark, sf_dir, "doc_pages").select("page_id", "path", "text").distinct()
    return page_totals(p)


@query("SELECT status, count(*) AS files FROM (SELECT DISTINCT path, status FROM source_files) GROUP BY status")
def status_counts(spark, sf_dir):
    return summary(table(spark, sf_dir, "source_files").select("path", "status").distinct()).withColumnRenamed("documents", "files")


@query("SELECT DISTINCT r.path, r.font, f.font_alias, f.encoding FROM (SELECT DISTINCT path, font FROM text_runs) r LEFT JOIN fonts f ON r.path = f.path AND r.font = f.font")
def font_lookup(spark, sf_dir):
    r = table(spark, sf_dir, "text_runs").select("path", "font").distinct()
    return R.with_declared_fonts(r, table(spark, sf_dir, "fonts").select("path", "font", "font_alias", "encoding")).distinct()


@query("""SELECT vec_id, CASE WHEN b > 0 AND b < n - 1 THEN chr(64 + b) WHEN b = 0 THEN '' ELSE ' ' END AS text FROM (SELECT vec_id, CAST(arg_max(i, (v, -i)) AS INTEGER) AS b, CAST(count(*) AS INTEGER) AS n
 FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY vec_id)""")
def step_argmax(spark, sf_dir):
    """The character of a recognition step of one row of scores; of equals the first, class 0 is none, the last a space."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"vec_id": f.vec_id, "text": [decode(np.asarray(e, np.float64)[None], [chr(65 + i) for i in range(len(e) - 2)])[0] for e in f.embedding]})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, text string")


@query()
def luminance(spark, sf_dir):
    """Mean colour of the darker half of each vector's values read as pixels."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..ocr import text_color

        for f in frames:
            yield pd.DataFrame({"vec_id": f.vec_id, "color": [text_color((np.abs(np.asarray(e, np.float32)[: len(e) // 3 * 3]).reshape(1, -1, 3) * 255) % 256) for e in f.embedding]})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, color string")
