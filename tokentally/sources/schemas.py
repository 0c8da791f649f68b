"""Table schemas of the usage store."""

from pyspark.sql import types as T

TOKENS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ts", T.LongType()),            # epoch seconds
    T.StructField("session", T.StringType()),
    T.StructField("input", T.LongType()),
    T.StructField("output", T.LongType()),
    T.StructField("cache_read", T.LongType()),
    T.StructField("cache_write", T.LongType()),
    T.StructField("ctx_pct", T.LongType()),
    T.StructField("model", T.StringType()),
])
TOKEN_COLUMNS = [f.name for f in TOKENS.fields]

CHATS = T.StructType([
    T.StructField("session", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("ctx_size", T.LongType()),
    T.StructField("first_ts", T.LongType()),
    T.StructField("last_ts", T.LongType()),
    T.StructField("total_input", T.LongType()),
    T.StructField("total_output", T.LongType()),
    T.StructField("cache_read", T.LongType()),
    T.StructField("cache_write", T.LongType()),
])
CHAT_COLUMNS = [f.name for f in CHATS.fields]

LEDGER = T.StructType([T.StructField("session", T.StringType())])

# transcript lines: session key, file-order position, raw text
LINES = T.StructType([
    T.StructField("session", T.StringType()),
    T.StructField("pos", T.StructType([
        T.StructField("blk", T.LongType()),
        T.StructField("seq", T.LongType()),
    ])),
    T.StructField("value", T.StringType()),
])

# one live usage event, as received (JSON)
USAGE_STRUCT = T.StructType([
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("cache_read_input_tokens", T.LongType()),
    T.StructField("cache_creation_input_tokens", T.LongType()),
])
LIVE_EVENT = T.StructType([
    T.StructField("model", T.StructType([
        T.StructField("display_name", T.StringType()),
        T.StructField("id", T.StringType()),
    ])),
    T.StructField("context_window", T.StructType([
        T.StructField("context_window_size", T.LongType()),
        T.StructField("current_usage", USAGE_STRUCT),
    ])),
])
