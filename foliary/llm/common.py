"""Shared helpers of the training-data operators: tables, record views, durable cut-offs."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public tokenizer files are looked for when no path is given.
TOKENIZER_DIRS = ("/opt/tokenizers",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and cells as (record_kind, record_id, text); nulls stay, later deliveries stay (same id and text)."""
    pages = table(spark, sf_dir, "doc_pages").select(F.lit("page").alias("record_kind"), F.col("page_id").alias("record_id"), "text")
    cells = table(spark, sf_dir, "table_cells").select(F.lit("cell").alias("record_kind"), F.col("cell_id").alias("record_id"), "text")
    return pages.unionByName(cells)


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is read from spark.checkpoint.dir. Where the session has none, a temporary one is set if all runs on one
    machine (tests); on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="foliary-checkpoint-"))
    return df.checkpoint(eager)


def tokenizer_path(name: str, path: str | None = None) -> str:
    """The file of a public tokenizer: `path` itself if it is a file, else looked up in it and in TOKENIZER_DIRS."""
    for base in ([path] if path else []) + list(TOKENIZER_DIRS):
        if os.path.isfile(base):
            return base
        if os.path.isfile(os.path.join(base, name)):
            return os.path.join(base, name)
    raise FileNotFoundError(name)


def sample(df: DataFrame, key: str, text: str, size: int, n: int | None = None, where: Column | None = None) -> list[str]:
    """Texts of about `size` rows (at most twice as many), chosen by the hash of their key; all rows if there are no
    more. Null texts are left out, and rows that don't meet `where`; n: their number, if known. Only the chosen rows
    reach the driver."""
    keep = F.col(text).isNotNull() if where is None else F.col(text).isNotNull() & where
    n = df.where(keep).count() if n is None else n
    rows = df
    if n > size:
        # the cheap test first
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(size / n * (1 << 30)))
    rows = rows.where(keep).select(F.xxhash64(key).alias("h"), F.col(text).alias("t"))
    return [r.t for r in sorted(rows.limit(2 * size).collect(), key=lambda r: (r.h, r.t))]
