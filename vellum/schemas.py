"""Explicit schemas of the document store's records."""

from pyspark.sql import types as T

SUBSCRIPTION = T.StructType([T.StructField("type", T.StringType()), T.StructField("status", T.StringType())])

PAYMENT = T.StructType(
    [
        T.StructField("billed_at", T.TimestampType()),
        T.StructField("period_start", T.TimestampType()),
        T.StructField("period_end", T.TimestampType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ]
)

ACCOUNT_INFO = T.StructType(
    [
        T.StructField("org_id", T.StringType()),
        T.StructField("subscription", SUBSCRIPTION),
        T.StructField("payments", T.ArrayType(PAYMENT)),
        T.StructField("org_address", T.StringType()),
        T.StructField("multi_level_share", T.BooleanType()),
        T.StructField("sharable_orgs", T.ArrayType(T.StringType())),
    ]
)

#: Seconds and nanoseconds since 1970, as instants travel on the wire.
WIRE_INSTANT = T.StructType([T.StructField("seconds", T.LongType()), T.StructField("nanos", T.IntegerType())])

FREQUENCIES = ("MONTHLY", "YEARLY")

#: The driver's events table, for readers that take no schema from the files.
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
