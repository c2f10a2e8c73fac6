"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

DATASET = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("input", T.StringType(), False),
        T.StructField("reference", T.StringType(), False),
    ]
)

OUTPUTS = T.StructType(
    [
        T.StructField("inference_id", T.StringType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("output", T.StringType()),
    ]
)

SCORES = T.StructType(
    [
        T.StructField("inference_id", T.StringType(), False),
        T.StructField("evaluation_id", T.StringType()),
        T.StructField("id", T.StringType(), False),
        T.StructField("parsed", T.StringType()),
        T.StructField("metric", T.StringType(), False),
        T.StructField("value", T.DoubleType()),
    ]
)

EVALUATION_ROW = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("parsed", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.FloatType())),
        T.StructField("parsedVector", T.ArrayType(T.LongType())),
        T.StructField("referenceVector", T.ArrayType(T.LongType())),
    ]
)

EVALUATION = T.StructType(
    [
        T.StructField("evaluation_id", T.StringType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("rows", T.ArrayType(EVALUATION_ROW)),
        T.StructField("aggregate", T.MapType(T.StringType(), T.FloatType())),
    ]
)

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("s", T.IntegerType()),
            T.StructField("e", T.IntegerType()),
            T.StructField("label", T.StringType()),
        ]
    )
)
