"""Chat formatting: quotation linking.

Every line of a message has a quote level (the number of leading ``>``).
Quoted lines are normalised and hashed; a quoted line belongs to the earliest
message of the conversation that says it without quoting, if that is before
the quoting message.  A message answers the earlier message that most of its
shallowest linked quotes come from (ties: the latest).  Conversations are
rebuilt from the messages without quotes: a thread starts at a message that
answers none, and messages follow in order of thread and turn, each after the
one that it answers.

All steps are DataFrame operations.  Original lines are reduced to (conversation,
hash, first turn) before the join, so a line said or quoted any number of times
never meets itself in pairs; no step gathers a conversation.  Roots and depths
come from pointer doubling, a number of rounds that is the logarithm of the
longest chain of answers.

Defined cases: null text counts as empty; null conv_id or turn -> the message is
kept, links to nothing and starts its own thread; repeated (conv_id, turn) rows
share links; quotes without a known origin are cut but link nothing; empty
tables and further columns work (only the four named columns are used).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.llm.sources import materialize

#: Leading quote marks of a line, with white space between them.
QUOTE = r"^[ \t]*((?:>[ \t]?)+)"
#: Line that introduces a quotation; it goes with the quote.
INTRO = r"(?i)^[ \t]*(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)[ \t]*:[ \t]*$"


def _normal(line):
    """Lower case, runs of anything but letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, lines): every line with its level, said text and normal hash (null if empty)."""
    def one(line):
        marks = F.regexp_extract(line, QUOTE, 1)
        said = F.regexp_replace(line, QUOTE, "")
        normal = _normal(said)
        return F.struct(F.length(F.regexp_replace(marks, r"[^>]", "")).alias("level"), said.alias("said"),
                        F.when(normal != "", F.xxhash64(normal)).alias("hash"), F.length(normal).alias("size"))
    return messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.transform(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\r?\n"), one).alias("lines"))


def quote_links(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, quoted_chars): the message that each quoting message answers."""
    flat = (lines.where("conv_id is not null and turn is not null")
            .select("conv_id", "turn", F.explode("lines").alias("l"))
            .select("conv_id", "turn", "l.level", "l.hash", "l.size").where("hash is not null"))
    quoted = (flat.where("level > 0").groupBy("conv_id", "turn", "level", "hash")
              .agg(F.sum("size").alias("size")))
    origin = (flat.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin")))
    found = quoted.join(origin, ["conv_id", "hash"]).where("origin < turn")
    votes = found.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("size").alias("chars"))
    return (votes.groupBy("conv_id", "turn")
            .agg(F.max(F.struct((-F.col("level")).alias("near"), "chars", "origin")).alias("best"))
            .select("conv_id", "turn", F.col("best.origin").alias("reply_to"),
                    F.col("best.chars").alias("quoted_chars")))


def thread_roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, quoted_chars, root, depth) of the answering messages by pointer doubling."""
    state = materialize(links.select("*", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")),
                        "quote-roots")
    while True:
        up = state.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"),
                          F.col("root").alias("far"), F.col("depth").alias("more"))
        joined = state.join(up, (F.col("conv_id") == F.col("c2")) & (F.col("root") == F.col("t2")), "left")
        state = materialize(
            joined.select("conv_id", "turn", "reply_to", "quoted_chars",
                          F.coalesce("far", "root").alias("root"),
                          (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                          F.col("far").isNotNull().alias("moved")), "quote-roots")
        if state.where("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row a message: its text without quotes, what it answers, and its place (root, turn) in reply order."""
    lines = parsed(messages)
    roots = thread_roots(quote_links(lines)).alias("r")
    m = lines.alias("m")
    said = F.filter("m.lines", lambda l: (l["level"] == 0) & ~l["said"].rlike(INTRO))
    quotes = F.size(F.filter("m.lines", lambda l: l["level"] > 0))
    kept = F.when(quotes > 0, said).otherwise(F.col("m.lines"))
    body = F.concat_ws("\n", F.transform(kept, lambda l: l["said"]))
    return (m.join(roots, [F.col("m.conv_id") == F.col("r.conv_id"), F.col("m.turn") == F.col("r.turn")], "left")
            .select("m.conv_id", "m.turn", "m.role",
                    F.regexp_replace(F.trim(body), r"\n{3,}", "\n\n").alias("text"),
                    quotes.alias("quoted_lines"), F.array_max(F.transform("m.lines", lambda l: l["level"])).alias("quote_depth"),
                    "r.reply_to", F.coalesce("r.root", "m.turn").alias("thread_root"),
                    F.coalesce("r.depth", F.lit(0)).cast("long").alias("thread_depth"))
            .withColumn("chat", F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"),
                                         F.col("text"), F.lit("\n"))))


def write_chat(messages: DataFrame, path: str) -> None:
    """The conversations in reply order: files sorted by conversation, thread and turn."""
    (link_quotes(messages).repartitionByRange("conv_id", "thread_root", "turn")
     .sortWithinPartitions("conv_id", "thread_root", "turn").write.mode("overwrite").parquet(path))


def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of all conversations, linked and without quotes."""
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
