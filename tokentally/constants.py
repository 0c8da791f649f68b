"""Fixed values that must equal the metered tool's for results to agree.

Kept together, plainly, in natural order.
"""

# --- fixed values: price per million tokens, in US cents -------------------
# family: (input, cache_write, cache_read, output)
PRICE_CENTS_PER_MTOK = {
    "opus": (1500, 1875, 150, 7500),
    "sonnet": (300, 375, 30, 1500),
    "haiku": (80, 100, 8, 400),
}
# family tests are case-sensitive substring tests, in this order; anything
# else (blank and unknown names included) is the default family.
FAMILY_ORDER = ("opus", "haiku")
DEFAULT_FAMILY = "sonnet"

# --- fixed values: rolling periods (label, seconds back from as_of) --------
# None = no lower bound ("all").
PERIODS = (
    ("1h", 3600),
    ("6h", 21600),
    ("24h", 86400),
    ("7d", 604800),
    ("30d", 2592000),
    ("all", None),
)

# --- fixed values: dashboard charts (label, bucket width in seconds) -------
# 30 buckets each; the span of a chart is 30 * width.
CHARTS = (
    ("1h", 120),
    ("24h", 2880),
    ("7d", 20160),
    ("30d", 86400),
)
CHART_SLOTS = 30
DOT_LEVELS = 16          # 4 text rows x 4 dots
BAR_LEVELS = 7           # 8 block glyphs: levels 0..7

# --- fixed values: defaults --------------------------------------------------
DEFAULT_CONTEXT_SIZE = 200000
HISTORY_KEEP = 50
CHAT_LIST_LIMIT = 100
TOP_SESSIONS = 3
TITLE_MAX = 30
TITLE_KEEP = 27
UNTITLED = "(untitled)"
LIVE_DISPLAY_DEFAULT = "?"
SPARK_WIDTH_MIN, SPARK_WIDTH_MAX = 16, 40

# transcript keys whose integer values are summed over every occurrence
TOKEN_KEYS = (
    ("input", "input_tokens"),
    ("output", "output_tokens"),
    ("cache_read", "cache_read_input_tokens"),
    ("cache_write", "cache_creation_input_tokens"),
)
AGENT_FILE_PREFIX = "agent-"

# fixed reporting instant used by the driver-table queries: 2024-01-31T00:00:00Z
FIXTURE_AS_OF = 1706659200
