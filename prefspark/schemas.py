"""Column layouts shared by all operators.

Ids are 64-bit, preference values are stored as 32-bit floats and computed with
as doubles. No column is nullable in meaning: a missing fact is a missing row.
"""

from pyspark.sql import types as T

PREFERENCES = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("preference", T.FloatType()),
    ]
)

PREFERENCE_LOG = T.StructType(
    PREFERENCES.fields
    + [
        T.StructField("ts", T.TimestampType()),
        T.StructField("ingest_seq", T.LongType()),
    ]
)

CANDIDATES = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("item_id", T.LongType())]
)

SIMILARITIES = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("similar_item_id", T.LongType()),
        T.StructField("similarity", T.DoubleType()),
    ]
)

FACTORS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("features", T.ArrayType(T.DoubleType())),
    ]
)

ARTICLES = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("training_set", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

TOPICS = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("topics", T.ArrayType(T.DoubleType())),
    ]
)

CENTROIDS = T.StructType(
    [
        T.StructField("centroid_id", T.LongType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("dim", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)

TUNING_RESULTS = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("features", T.IntegerType()),
        T.StructField("iterations", T.IntegerType()),
        T.StructField("alpha", T.DoubleType()),
        T.StructField("lambda", T.DoubleType()),
        T.StructField("error", T.DoubleType()),
    ]
)

HALVING_RESULTS = T.StructType([*TUNING_RESULTS.fields, T.StructField("spent", T.LongType())])

DEFAULT_HOW_MANY = 10
