"""Problem 8: encoding of a text column with a public byte-level BPE, and its streaming inverse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import transducer
from .common import table, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"


def _kept(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in keep)


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, ids: str = "ids", vocabulary: str | None = None, count_only: bool = False) -> DataFrame:
    """Token ids (array<int>, or with count_only their number) of every row's text, beside the columns `keep`.

    Map-only. Null and empty texts give [] (0). Every row stays, also repeated ones. Columns named as the result are
    not kept twice: `ids` must not be among `keep`.
    """
    keep = [c for c in df.columns if c not in (text, ids)] if keep is None else keep
    path = tokenizer_path(VOCABULARY, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for b in batches:
            coded = [machine.encode(t) for t in b.column(len(keep)).to_pylist()]
            sizes = np.fromiter(map(len, coded), np.int32, len(coded))
            if count_only:
                out = pa.array(sizes)
            else:
                flat = np.fromiter((i for x in coded for i in x), np.int32, int(sizes.sum()))
                out = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), out], names=[*keep, ids])

    kind = "int" if count_only else "array<int>"
    return df.select(*(df[c] for c in keep), df[text]).mapInArrow(run, _kept(df, keep) + f"`{ids}` {kind}")


def decode(df: DataFrame, ids: str = "ids", keep: list[str] | None = None, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The text of every row's ids; a null list gives the empty text, broken UTF-8 the replacement character."""
    keep = [c for c in df.columns if c not in (text, ids)] if keep is None else keep
    path = tokenizer_path(VOCABULARY, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for b in batches:
            texts = pa.array([machine.decode(x or ()) for x in b.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), texts], names=[*keep, text])

    return df.select(*(df[c] for c in keep), df[ids]).mapInArrow(run, _kept(df, keep) + f"`{text}` string")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep=["doc_id"])


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip through the ids; equals the text itself."""
    return decode(p8_ids(spark, sf_dir))


QUERIES = {"p8_ids": p8_ids, "p8_decoded": p8_decoded}
SQL = {"p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
