"""Files as a stream: new files of a folder are extracted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.documents import extract

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def stream_documents(spark: SparkSession, path: str, files_per_trigger: int = 100, **options) -> DataFrame:
    """Documents of the files that appear in a folder. A file counts once; memory holds one file per task."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return extract(files.where(~F.element_at(F.split("path", "/"), -1).startswith(".")), **options)


def status_counts(docs: DataFrame) -> DataFrame:
    """Running number of documents by status."""
    return docs.groupBy("status").agg(F.count("*").alias("documents"))
