"""Fixed schemas. Ids are strings everywhere; ``seq`` orders messages
oldest-first (ascending = chronological) within a scope."""

from pyspark.sql import types as T

MESSAGES = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("author_id", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("channel", T.StringType(), True),
])

MEMBERS = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("pos", T.LongType(), True),
])

RAW_MEMBERS = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
])

PAYLOAD = T.StructType([
    T.StructField("inputs", T.StructType([
        T.StructField("past_user_inputs", T.ArrayType(T.StringType()), True),
        T.StructField("generated_responses", T.ArrayType(T.StringType()), True),
        T.StructField("text", T.StringType(), True),
    ]), True),
])

RESPONSE = T.StructType([
    T.StructField("generated_text", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("estimated_time", T.DoubleType(), True),
])

SCORES = T.StructType([
    T.StructField("metric", T.StringType(), False),
    T.StructField("value", T.DoubleType(), True),
])
