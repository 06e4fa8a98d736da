"""Fixed schemas of the audit-log data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The nine source cells, in file order.
BASE_COLUMNS = [
    "user_id", "id", "subseq_id", "message", "audit_time",
    "action_raw", "type", "label", "version",
]

# The eleven derived columns appended after the nine cells.
DERIVED_COLUMNS = [
    "recipe_id", "recipe_name", "material_name", "material_id",
    "name1", "name2", "username", "action_derived",
    "session_start", "session_end", "session_duration",
]

AUDIT_COLUMNS = BASE_COLUMNS + DERIVED_COLUMNS

TIMESTAMP_COLUMNS = ("audit_time", "session_start", "session_end")
INT_COLUMNS = ("session_duration",)

# The typed log table: 16 strings, 3 timestamps, 1 integer (all nullable).
AUDIT_LOG_SCHEMA = T.StructType([
    T.StructField(c, T.TimestampType() if c in TIMESTAMP_COLUMNS
                  else T.IntegerType() if c in INT_COLUMNS
                  else T.StringType(), True)
    for c in AUDIT_COLUMNS
])

QUERY_EVENT_SCHEMA = T.StructType([
    T.StructField("ts", T.StringType()),
    T.StructField("user_query", T.StringType()),
    T.StructField("sql", T.StringType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("row_count", T.LongType()),
    T.StructField("rows_sample", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("error", T.StringType()),
    T.StructField("model_raw_phase_a", T.StringType()),
    T.StructField("model_raw_phase_b", T.StringType()),
    T.StructField("elapsed_human", T.StringType()),
    T.StructField("elapsed_seconds", T.DoubleType()),
])
