"""tokentally: usage and cost analytics for language-model traffic on Spark.

Everything is expressed as DataFrame / SQL / Structured Streaming jobs made of
native Column expressions; no Python UDF runs in any hot path.
"""

from tokentally.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
