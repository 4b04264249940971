"""Column layout of raw lines and of parsed entries."""

from pyspark.sql import types as T

ENTRY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("ingest_time", T.TimestampType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("severity", T.StringType()),
    T.StructField("severity_rank", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("process", T.StringType()),
    T.StructField("pid", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("line_number", T.LongType()),
])

ENTRY_COLUMNS = tuple(ENTRY_SCHEMA.fieldNames())
