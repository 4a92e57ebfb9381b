"""Table layouts shared by the operators."""

from pyspark.sql import types as T

REPORT = T.StructType([
    T.StructField("now", T.DoubleType()),
    T.StructField("hex", T.StringType()),
    T.StructField("r", T.StringType()),
    T.StructField("flight", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("alt_baro", T.StringType()),
    T.StructField("gs", T.DoubleType()),
    T.StructField("track", T.DoubleType()),
    T.StructField("squawk", T.StringType()),
    T.StructField("emergency", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("baro_rate", T.LongType()),
    T.StructField("dbFlags", T.LongType()),
])

REGION = T.StructType([
    T.StructField("layer", T.IntegerType(), False),
    T.StructField("file", T.StringType(), False),
    T.StructField("idx", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("min_alt", T.LongType(), False),
    T.StructField("max_alt", T.LongType(), False),
    T.StructField("hdg0", T.DoubleType(), False),
    T.StructField("hdg1", T.DoubleType(), False),
    T.StructField("ring", T.ArrayType(T.StructType([
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ])), False),
])

EVENT = T.StructType([
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("datetime_utc", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("alt_ft", T.LongType()),
    T.StructField("alt_band", T.StringType()),
    T.StructField("flight1", T.StringType()),
    T.StructField("flight2", T.StringType()),
    T.StructField("lateral_nm", T.DoubleType()),
    T.StructField("alt_sep_ft", T.DoubleType()),
    T.StructField("duration_s", T.DoubleType()),
    T.StructField("quality", T.StringType()),
    T.StructField("quality_explanation", T.StringType()),
    T.StructField("animation_path", T.StringType()),
    T.StructField("track1", T.StringType()),
    T.StructField("track2", T.StringType()),
])
