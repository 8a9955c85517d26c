"""Writing page texts, table TSVs and images to files, named as a person would look for them."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .formats.common import sniff
from .operators.grid import tsv_of


def folder_name(path: str) -> str:
    """Stem of the file and a short hash of its whole path, so that equal stems don't share a folder."""
    return posixpath.splitext(posixpath.basename(path))[0] + "-" + hashlib.sha1(path.encode()).hexdigest()[:8]


def attempt() -> int:
    """Number of the running attempt of a task; two attempts of one task differ."""
    task = TaskContext.get()
    return task.taskAttemptId() if task else 0


def put(target: str, folder: str, path: str, name: str, data: bytes) -> tuple[str, str, int]:
    """Writes one file into a folder under the target, under a name of its own until it is whole."""
    store, base = fs.FileSystem.from_uri(target) if "://" in target else (fs.LocalFileSystem(), target)
    folder = posixpath.join(base, folder)
    store.create_dir(folder, recursive=True)
    own = posixpath.join(folder, f".{name}.{attempt()}")
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, posixpath.join(folder, name))
    return path, name, len(data)


def write_raw(files: DataFrame, target: str) -> DataFrame:
    """Copies files (path, content) into the target under their own names; (path, file, bytes), one row per file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [put(target, "", p, posixpath.basename(p), bytes(c)) for p, c in zip(f["path"], f["content"], strict=True)]
            yield pd.DataFrame(out, columns=["path", "file", "bytes"])

    return files.select("path", "content").mapInPandas(run, "path string, file string, bytes long")


def write_files(docs: DataFrame, target: str) -> DataFrame:
    """Writes page_N.txt, page_N_table_K.tsv and image_I.<type> of each document into its folder under `target`, a folder
    that all executors share or the address of a store that Arrow knows, and returns (path, file, bytes), one row per
    file. Writing is idempotent: a repeated task writes the same files, each under a name of its own until it is whole.
    Empty tables and images without data are skipped; failed documents write nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, pages in zip(f["path"], f["pages"], strict=True):
                images = 0
                for p in pages:
                    out.append(put(target, folder_name(path), path, f"page_{p['number']}.txt", p["text"].encode()))
                    for im in p["images"]:
                        if im["data"] is not None and len(im["data"]):
                            images += 1
                            data = bytes(im["data"])
                            out.append(put(target, folder_name(path), path, f"image_{images}.{sniff(data) or im['format'] or 'bin'}", data))
                    for k, t in enumerate(p["tables"], 1):
                        tsv = tsv_of(t)
                        if tsv:
                            out.append(put(target, folder_name(path), path, f"page_{p['number']}_table_{k}.tsv", tsv.encode()))
            yield pd.DataFrame(out, columns=["path", "file", "bytes"])

    return docs.where("status = 'ok'").select("path", "pages").mapInPandas(run, "path string, file string, bytes long")
