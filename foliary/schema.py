"""The nested model of a document as Spark types. Units are points; sheets use (column, row, 1, 1)."""

from __future__ import annotations

from pyspark.sql import types as T

RECT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "width", "height")])
RUN = T.StructType([T.StructField("text", T.StringType()), T.StructField("bounds", RECT), T.StructField("font", T.StringType()), T.StructField("size", T.DoubleType()), T.StructField("color", T.StringType())])
IMAGE = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("format", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("bounds", RECT), T.StructField("data", T.BinaryType())]
)
CELL = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("row", "column", "row_span", "col_span")] + [T.StructField("bounds", RECT), T.StructField("text", T.StringType()), T.StructField("runs", T.ArrayType(RUN))]
)
TABLE = T.StructType([T.StructField("bounds", RECT), T.StructField("rows", T.ArrayType(T.StructType([T.StructField("cells", T.ArrayType(CELL))])))])
PAGE = T.StructType(
    [
        T.StructField("number", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()),
        T.StructField("text", T.StringType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("images", T.ArrayType(IMAGE)), T.StructField("tables", T.ArrayType(TABLE)),
    ]
)
DOCUMENT = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("format", T.StringType()), T.StructField("pagination", T.StringType()), T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), T.StructField("pages", T.ArrayType(PAGE))]
)
