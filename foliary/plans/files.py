"""Queries over files: documents are built in memory from table rows, scanned by the real parsers and read back."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures, sinks
from ..sources import documents as D
from .text import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def built(df: DataFrame, key: str, ext: str, make: Callable[[tuple], bytes], *columns: str) -> DataFrame:
    """Files (path = key.ext, content) made of rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": [f"{k}{ext}" for k in f[key]], "content": [make(r) for r in f[list(columns)].itertuples(index=False, name=None)]})

    # a small table is one split; files are worth a task of their own for every core
    spread = df.select(key, *columns).repartition(df.sparkSession.sparkContext.defaultParallelism, key)
    return spread.mapInPandas(run, "path string, content binary")


def texts(files: DataFrame, key: str, normalize: bool = False) -> DataFrame:
    """(key, text) of the files' first pages."""
    p = D.pages(D.extract(files, normalize=normalize)).where("number = 1")
    return p.select(F.regexp_extract("path", "^([^.]*)", 1).cast("long").alias(key), "text")


#: Rows of plain words: three lines of every part.
_LINES = "p_partkey, p_name || ' ' || p_partkey AS a, p_brand AS b, p_type AS c"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_partkey").alias("a"), F.col("p_brand").alias("b"), F.col("p_type").alias("c"))


_LINED = f"SELECT p_partkey, a || chr(10) || b || chr(10) || c AS text FROM (SELECT {_LINES} FROM part)"
_TABBED = f"SELECT p_partkey, a || chr(9) || b || chr(10) || c AS text FROM (SELECT {_LINES} FROM part)"


def _round_trip(name: str, ext: str, make: Callable[[tuple], bytes], sql: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return texts(built(_parts(spark, sf_dir), "p_partkey", ext, make, "a", "b", "c"), "p_partkey")

    QUERIES[name], SQL[name] = f, sql


_round_trip("rtf_roundtrip", ".rtf", fixtures.rtf, _LINED)
_round_trip("docx_roundtrip", ".docx", fixtures.docx, _LINED)
_round_trip("pptx_roundtrip", ".PPTX", lambda r: fixtures.pptx([r]), _LINED)
_round_trip("pdf_roundtrip", ".pdf", fixtures.pdf, _LINED)
_round_trip("ofd_roundtrip", ".ofd", fixtures.ofd, _LINED)
_round_trip("ppt_roundtrip", ".ppt", lambda r: fixtures.ppt([r]), _LINED)
_round_trip("doc_roundtrip", ".doc", fixtures.doc, _LINED)
_round_trip("html_doc_scan", ".doc", fixtures.html, _LINED)
_round_trip("xlsx_roundtrip", ".xlsx", lambda r: fixtures.xlsx([r[:2], r[2:]]), _TABBED)
_round_trip("xls_roundtrip", ".xls", lambda r: fixtures.xls([r[:2], r[2:]]), _TABBED)
_round_trip("docx_table", ".docx", lambda r: fixtures.docx([], [r[:2], r[2:]]), _TABBED)


def pdf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a ruled table drawn in a page description."""
    files = built(_parts(spark, sf_dir), "p_partkey", ".pdf", lambda r: fixtures.pdf(["Parts"], [["name", "brand"], [r[0], r[1]]], width=300), "a", "b")
    c = D.cells(D.extract(files, normalize=False)).where("row = 1")
    return c.select(F.regexp_extract("path", "^([^.]*)", 1).cast("long").alias("p_partkey"), "column", "text")


QUERIES["pdf_table"] = pdf_table
SQL["pdf_table"] = f"SELECT p_partkey, 0 AS \"column\", a AS text FROM (SELECT {_LINES} FROM part) UNION ALL SELECT p_partkey, 1, b FROM (SELECT {_LINES} FROM part)"


def pages_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text in all its languages through a rich-text file; lines may wrap at the page width, so only
    letters and digits are compared."""
    p = table(spark, sf_dir, "doc_pages").where("text IS NOT NULL").select("page_id", "text").distinct()
    d = D.extract(built(p, "page_id", ".rtf", lambda r: fixtures.rtf(r[0].split("\n")), "text"), normalize=False)
    whole = F.array_join(F.transform("pages", lambda x: x["text"]), "")
    return d.select(F.regexp_extract("path", "^([^.]*)", 1).cast("long").alias("page_id"), F.md5(F.regexp_replace(whole, r"[^\p{L}\p{Nd}]", "")).alias("letters"))


QUERIES["pages_as_files"] = pages_as_files
SQL["pages_as_files"] = "SELECT DISTINCT page_id, md5(regexp_replace(text, '[^\\p{L}\\p{Nd}]', '', 'g')) AS letters FROM doc_pages WHERE text IS NOT NULL"


def pdf_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken page descriptions: a row each, no failed task."""
    files = spark.createDataFrame([(f"{k}.pdf", v) for k, v in sorted(fixtures.MALFORMED.items())], "path string, content binary")
    return D.extract(files).select("path", F.col("status").isin("ok", "failed").alias("survived"))


QUERIES["pdf_malformed"] = pdf_malformed
SQL["pdf_malformed"] = "SELECT unnest([" + ", ".join(f"'{k}.pdf'" for k in sorted(fixtures.MALFORMED)) + "]) AS path, true AS survived"


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by status: every third file is cut short, every fifth has an unknown extension."""
    p = _parts(spark, sf_dir)
    files = built(p, "p_partkey", ".rtf", fixtures.rtf, "a", "b", "c").withColumn("k", F.regexp_extract("path", "^([^.]*)", 1).cast("long"))
    files = files.select(F.when(F.col("k") % 5 == 0, F.concat("path", F.lit(".xyz"))).otherwise(F.col("path")).alias("path"), F.when(F.col("k") % 3 == 0, F.unhex(F.lit("00"))).otherwise(F.col("content")).alias("content"))
    return D.summary(D.extract(files))


QUERIES["status_summary"] = status_summary
SQL["status_summary"] = "SELECT CASE WHEN p_partkey % 5 = 0 THEN 'skipped' WHEN p_partkey % 3 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS documents FROM part GROUP BY 1"


def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, images, tables and characters of generated documents with a table."""
    s = D.statistics(D.extract(built(_parts(spark, sf_dir), "p_partkey", ".docx", lambda r: fixtures.docx([r[0]], [r[1:]]), "a", "b", "c"), normalize=False))
    return s.select(F.regexp_extract("path", "^([^.]*)", 1).cast("long").alias("p_partkey"), "pages", "images", "tables", "characters")


QUERIES["file_stats"] = file_stats
SQL["file_stats"] = f"SELECT p_partkey, 1 AS pages, 0 AS images, 1 AS tables, CAST(length(a) + length(b) + length(c) + 2 AS INTEGER) AS characters FROM (SELECT {_LINES} FROM part)"


def _shared(spark: SparkSession) -> str:
    """A new folder that all executors share: below the session's folder for checkpoints; a temporary one only where all
    runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return posixpath.join(folder or tempfile.mkdtemp(prefix="foliary-"), f"files-{uuid.uuid4().hex}")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("a"), F.col("s_nationkey").cast("string").alias("b"))
    return built(s, "s_suppkey", ".docx", lambda r: fixtures.docx([r[0]], [r]), "a", "b")


def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a real folder, an empty and an unknown file among them, in the mode that leaves failed ones out."""
    folder = _shared(spark)
    more = spark.createDataFrame([("empty.docx", b""), ("note.xyz", b"x")], "path string, content binary")
    sinks.write_raw(_suppliers(spark, sf_dir).union(more), folder).write.format("noop").mode("overwrite").save()
    p = D.pages(D.read_documents(spark, folder, mode="DROPMALFORMED", normalize=False))
    return p.select(F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long").alias("s_suppkey"), F.col("number").alias("page_no"), "text")


QUERIES["folder_scan"] = folder_scan
SQL["folder_scan"] = "SELECT s_suppkey, CAST(1 AS INTEGER) AS page_no, s_name || chr(10) || s_name || chr(9) || s_nationkey AS text FROM supplier"


def folder_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of a folder has a row, whatever becomes of it."""
    folder = _shared(spark)
    more = spark.createDataFrame([("empty.docx", b""), ("note.xyz", b"x"), (".hidden.docx", b"")], "path string, content binary")
    sinks.write_raw(_suppliers(spark, sf_dir).union(more), folder).write.format("noop").mode("overwrite").save()
    return D.summary(D.read_documents(spark, folder))


QUERIES["folder_status"] = folder_status
SQL["folder_status"] = "SELECT 'ok' AS status, count(*) AS documents FROM supplier UNION ALL SELECT 'failed', 1 UNION ALL SELECT 'skipped', 1"


def written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the file sink writes of each document: its page and its table."""
    w = sinks.write_files(D.extract(_suppliers(spark, sf_dir), normalize=False), _shared(spark))
    return w.select(F.regexp_extract("path", "^([^.]*)", 1).cast("long").alias("s_suppkey"), "file", "bytes")


QUERIES["written_files"] = written_files
SQL["written_files"] = """SELECT s_suppkey, 'page_1.txt' AS file, CAST(octet_length(encode(s_name || chr(10) || s_name || chr(9) || s_nationkey)) AS BIGINT) AS bytes FROM supplier
 UNION ALL SELECT s_suppkey, 'page_1_table_1.tsv', CAST(octet_length(encode(s_name || chr(9) || s_nationkey)) AS BIGINT) FROM supplier"""


def pdf_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of page descriptions: 8-bit samples with a soft mask come out as a picture file with its size."""
    size = b"/Subtype /Image /Width %d /Height 1 /BitsPerComponent 8 /Filter /FlateDecode "

    def make(r: tuple) -> bytes:
        n = 1 + int(r[0]) % 40
        return fixtures.pdf(["x"], pictures=[(size % n + b"/ColorSpace /DeviceRGB /SMask 7 0 R", zlib.compress(bytes(range(3 * n)))), (size % n + b"/ColorSpace /DeviceGray", zlib.compress(bytes(n)))])

    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("a"))
    p = D.pages(D.extract(built(s, "s_suppkey", ".pdf", make, "a"), normalize=False))
    im = p.select(F.regexp_extract("path", "^([^.]*)", 1).cast("long").alias("s_suppkey"), F.explode("images").alias("i"))
    return im.select("s_suppkey", F.col("i.name").alias("name"), F.col("i.format").alias("format"), F.col("i.width").alias("width"))


QUERIES["pdf_pictures"] = pdf_pictures
SQL["pdf_pictures"] = "SELECT s_suppkey, name, format, CAST(1 + s_suppkey % 40 AS INTEGER) AS width FROM supplier, (VALUES ('I6', 'png'), ('I7', 'png')) t(name, format)"
