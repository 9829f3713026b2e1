"""Fixed schemas of the tables that enter and leave the library."""

from pyspark.sql import types as T

GEN = T.StructType([
    T.StructField("batch_index", T.LongType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("model", T.StringType()),
    T.StructField("generated_at", T.TimestampType()),
    T.StructField("raw_output", T.StringType()),
    T.StructField("reasoning", T.StringType()),
])

PROMPT = T.StructType([
    T.StructField("subtopic", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("target_adversarial_level", T.IntegerType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("_status", T.StringType()),
    T.StructField("_gen", GEN),
    T.StructField("adversarial_level", T.IntegerType()),
    T.StructField("surface_topic", T.StringType()),
])

ACTIVATION = T.StructType([
    T.StructField("sample_id", T.LongType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("layer", T.IntegerType()),
    T.StructField("step", T.IntegerType()),
    T.StructField("h", T.ArrayType(T.FloatType())),
])

SAE_WEIGHTS = T.StructType([
    T.StructField("layer", T.IntegerType()),
    T.StructField("feature_id", T.IntegerType()),
    T.StructField("w", T.ArrayType(T.FloatType())),
    T.StructField("b_enc", T.FloatType()),
    T.StructField("threshold", T.FloatType()),
])

SAE_BIAS = T.StructType([
    T.StructField("layer", T.IntegerType()),
    T.StructField("b_dec", T.ArrayType(T.FloatType())),
])
