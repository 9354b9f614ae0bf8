"""Row layouts that the operators share."""

from pyspark.sql import types as T

TEXT_MAP = T.MapType(T.StringType(), T.StringType())

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("type", T.StringType()),
        T.StructField("data", TEXT_MAP),
        T.StructField("source", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("pid", T.IntegerType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField("dedup_key", T.StringType()),
        T.StructField("metadata", TEXT_MAP),
        T.StructField("acknowledged", T.BooleanType()),
        T.StructField("acknowledged_at", T.DoubleType()),
        T.StructField("resolved", T.BooleanType()),
        T.StructField("resolved_at", T.DoubleType()),
        T.StructField("version", T.IntegerType()),
    ]
)

ATTEMPT_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("ip", T.StringType()),
    ]
)

RULE_ALERT_SCHEMA = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("rule_order", T.IntegerType()),
        T.StructField("key", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("ip", T.StringType()),
        T.StructField("metric", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("message", T.StringType()),
    ]
)

IP_STATE_SCHEMA = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("state_json", T.StringType()),
        T.StructField("last_updated", T.DoubleType()),
    ]
)

BASELINE_HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("history_json", T.StringType()),
        T.StructField("last_updated", T.DoubleType()),
    ]
)

CHANGE_LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("op_type", T.IntegerType()),
        T.StructField("key", T.StringType()),
        T.StructField("value_json", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("checksum", T.StringType()),
    ]
)
