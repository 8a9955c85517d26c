"""Reading files: a binary scan, one parser per format, one row per document."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from datetime import datetime
from importlib import import_module

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..formats.common import document, image, page
from ..functions.columns import FORMATS
from ..operators import normalize as rules
from ..operators.tsv import table_tsv
from ..schema import DOCUMENT


def normalized(doc: dict) -> dict:
    """White space, dates and identifiers of all page, run and cell texts."""
    for p in doc["pages"]:
        tsv = [table_tsv([[(c["column"], c["col_span"], c["text"]) for c in r["cells"]] for r in t["rows"]]) for t in p["tables"]]
        p["text"] = rules.page_text(p["text"], tsv)
        cells = [c for t in p["tables"] for r in t["rows"] for c in r["cells"]]
        for runs in (p["runs"], *(c["runs"] for c in cells)):
            for r, text in zip(runs, rules.run_texts([r["text"] for r in runs]), strict=True):
                r["text"] = text
        for c in cells:
            c["text"] = rules.cell_text(c["text"])
    return doc


#: Pictures are documents of one page where there is a recognizer; else they are skipped.
IMAGES = (".png", ".jpg", ".jpeg")


def picture(path: str, data: bytes) -> dict:
    pg = page(1)
    pg["images"] = [image(path, data)]
    return document(posixpath.splitext(path)[1][1:].lower(), "single-flow", [pg])


def parse(path: str, data: bytes | None, normalize: bool = True, recognize: Callable[[dict], None] | None = None) -> dict:
    """One document row. Unknown extensions are skipped; a parser error or any other failure on a file makes the row
    failed, without pages; it never ends the job. recognize(document) may add text to pages before normalization."""
    row = {"path": path, "format": None, "pagination": None, "status": "skipped", "error": None, "pages": []}
    ext = posixpath.splitext(path or "")[1].lower()
    fmt = FORMATS.get(ext) or (ext[1:] if recognize and ext in IMAGES else None)
    if fmt is None:
        return row | {"error": "unsupported file format"}
    row |= {"format": fmt, "status": "failed"}
    if data is None:
        return row | {"error": "no content"}
    try:
        doc = picture(path, bytes(data)) if ext in IMAGES else import_module(f"foliary.formats.{fmt}").parse(bytes(data))
        if recognize:
            recognize(doc)
        if normalize:
            doc = normalized(doc)
    except Exception as e:  # noqa: BLE001 - broken input must not end the task
        return row | {"error": f"{type(e).__name__}: {e}"}
    return row | doc | {"status": "ok"}


#: Bytes of one Arrow batch of files.
BATCH_BYTES = 64 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def extract(files: DataFrame, path: str = "path", content: str = "content", normalize: bool = True, recognize: Callable[[dict], None] | None = None) -> DataFrame:
    """Documents of rows with a path and the file's bytes; map-only. A batch holds at most BATCH_BYTES besides its last
    file, and files are parsed one at a time; the binary source reads files up to 2 GB."""
    schema = to_arrow_schema(DOCUMENT)
    conf = files.sparkSession.conf
    if conf.get(_BATCH).rstrip("bB") == str((1 << 31) - 1):  # without a bound of the session's own
        conf.set(_BATCH, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, d in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield pa.RecordBatch.from_pylist([parse(p, d.as_py(), normalize, recognize)], schema=schema)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, DOCUMENT)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder (not below it) or a single file, without dot files: path, modificationTime, length, content.
    Spark plans no split for a file of no bytes, so those come from the folder's list; it is read on the driver, as
    Spark itself does to plan the scan."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    empty = _empty_files(spark, path)
    if empty:
        rows = spark.createDataFrame(empty, "path string, modificationTime timestamp, length long")
        found = found.unionByName(rows.withColumn("content", F.unhex(F.lit("")))).select(*found.columns)
    return found.where(~F.element_at(F.split("path", "/"), -1).startswith("."))


def _empty_files(spark: SparkSession, path: str) -> list[tuple]:
    """Files of no bytes that a path or pattern names, or that stand in a folder which it names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for top in fs.globStatus(where) or []:
        for s in fs.listStatus(top.getPath()) if top.isDirectory() else [top]:
            if s.isFile() and s.getLen() == 0:
                out.append((s.getPath().toString(), datetime.fromtimestamp(s.getModificationTime() / 1000), 0))
    return out


def read_documents(spark: SparkSession, path: str, mode: str = "PERMISSIVE", **options) -> DataFrame:
    """Documents under a path. mode FAILFAST raises on the first failed or skipped file, DROPMALFORMED leaves them out."""
    docs = extract(scan(spark, path), **options)
    if mode == "FAILFAST":
        return docs.withColumn("status", F.when(F.col("status") == "ok", F.col("status")).otherwise(F.raise_error(F.concat_ws(": ", "path", "error"))))
    return docs.where("status = 'ok'") if mode == "DROPMALFORMED" else docs


def pages(docs: DataFrame) -> DataFrame:
    """One row per page: path, format and the page's fields."""
    return docs.select("path", "format", F.explode("pages").alias("p")).select("path", "format", "p.*")


def runs(docs: DataFrame) -> DataFrame:
    """Flat runs with their place in the page."""
    p = pages(docs).select("path", F.col("number").alias("page_no"), F.posexplode("runs").alias("seq", "r"))
    return p.select("path", "page_no", "seq", "r.text", "r.font", F.col("r.size").alias("font_size"), "r.color", "r.bounds.*")


def cells(docs: DataFrame) -> DataFrame:
    """Flat table cells; table_id counts from 1 within a page."""
    t = pages(docs).select("path", F.col("number").alias("page_no"), F.posexplode("tables").alias("_t", "t")).select("path", "page_no", (F.col("_t") + 1).alias("table_id"), F.explode("t.rows").alias("r"))
    return t.select("path", "page_no", "table_id", F.explode("r.cells").alias("c")).select("path", "page_no", "table_id", "c.row", "c.column", "c.row_span", "c.col_span", "c.text", "c.bounds.*")


def page_totals(pages: DataFrame) -> DataFrame:
    """Pages and characters of each file, from flat pages (path, text)."""
    return pages.groupBy("path").agg(F.count("*").alias("pages"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("characters"))


def summary(docs: DataFrame) -> DataFrame:
    """Number of documents by status."""
    return docs.groupBy("status").agg(F.count("*").alias("documents"))


def statistics(docs: DataFrame) -> DataFrame:
    """Pages, images, tables and characters of each document."""
    total = lambda f: F.aggregate("pages", F.lit(0), lambda a, p: a + f(p))
    return docs.select("path", "status", F.size("pages").alias("pages"), total(lambda p: F.size(p["images"])).alias("images"), total(lambda p: F.size(p["tables"])).alias("tables"), total(lambda p: F.length(p["text"])).alias("characters"))
