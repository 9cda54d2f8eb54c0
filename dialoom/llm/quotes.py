"""Quotation linking: nested quote levels, passages joined to the messages they quote, and conversations in reply order.

A line's quote level is the number of `>` marks at its start, with blanks among them. Neighbouring lines of one level, up to
a blank line or the line that introduces a quotation ("On ..., X wrote:"), are a passage. A passage is normalised (lower
case, letters and digits only, single blanks) and hashed. Each message offers its own level-0 passages, and its whole own
text, as originals; quoted passages look for them. A passage links to the latest earlier turn of its conversation that has
it, or else, with `min_words` words or more, to the first message of any other conversation that has it.

Originals are reduced to one row per conversation and hash and turn, and to one row per hash across conversations, before
any join, so a passage that very many messages have or quote is one row on the side of originals, and Spark may split the
other side. In a conversation, "latest earlier" is found by a running maximum over (conversation, hash), among the turns
that have or quote this very passage.

A message replies to the original of its first least nested passage that links in its conversation; without quotations it
replies to nothing. Threads are the connected components of these links, named by their first turn. Ordered by (conv_id,
thread_turn, turn), every message follows what it replies to: a reply's turn is above its original's. Bodies are the own
lines, without quoted lines and introductions.

Defined results: null and empty texts have no passages and an empty body; messages with a null conversation or turn link to
nothing and are quoted by nothing; rows that repeat a conversation and turn are one node of the thread and one row each;
a message never links to itself; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.llm.components import connected_components
from dialoom.llm.shared import Scratch, table

MIN_WORDS = 1
MARKS = r"^[\x20\t]*(?:>[\x20\t]*)+"
#: A line that introduces a quotation, in its own level.
WROTE = r"(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió|-+\s*original message\s*-+)\s*:?\s*$"


def lines_of(text: Column) -> Column:
    """Array of (level, text without marks, introduces a quotation)."""

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        bare = F.regexp_replace(line, MARKS, "")
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), bare.alias("line"), bare.rlike(WROTE).alias("wrote"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), one)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


#: Marks that set passages apart while a text is taken to pieces; no letters, so they never belong to a passage.
_PASSAGE, _HEAD = "\x01", "\x02"


def passages(messages: DataFrame) -> DataFrame:
    """messages (node, conv, turn, text) -> node, conv, turn, at, level, norm: one row per passage that has letters or digits."""
    lines = lines_of(F.translate(F.coalesce(F.col("text"), F.lit("")), _PASSAGE + _HEAD, "  "))
    rows = messages.select("node", "conv", "turn", F.transform(lines, lambda x: F.struct(x["level"].alias("level"), x["line"].alias("line"), (x["wrote"] | (F.trim(x["line"]) == "")).alias("gap"))).alias("lines"))

    def marked(x: Column, i: Column) -> Column:
        """A line with the head of a passage before it, if one begins here."""
        before = F.get("lines", i - 1)
        new = F.coalesce((before["level"] != x["level"]) | before["gap"], F.lit(True))
        head = F.concat(F.lit(_PASSAGE), x["level"].cast("string"), F.lit(":"), i.cast("string"), F.lit(_HEAD))
        return F.when(x["gap"], "").when(new, F.concat(head, x["line"])).otherwise(x["line"])

    found = rows.select("node", "conv", "turn", F.explode(F.split(F.array_join(F.transform("lines", marked), "\n"), _PASSAGE)).alias("passage"))
    found = found.withColumns({"head": F.split(F.substring_index("passage", _HEAD, 1), ":"), "norm": normalised(F.substring_index("passage", _HEAD, -1))})
    found = found.where(F.col("passage").contains(_HEAD) & (F.col("norm") != ""))
    return found.select("node", "conv", "turn", F.col("head")[1].cast("int").alias("at"), F.col("head")[0].cast("int").alias("level"), "norm")


def body_of(text: Column) -> Column:
    """A message's own lines."""
    own = F.filter(lines_of(text), lambda x: (x["level"] == 0) & ~x["wrote"])
    body = F.array_join(F.transform(own, lambda x: x["line"]), "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"^\s+|\s+$", ""), r"\n{3,}", "\n\n"))


def _key(norm: Column) -> Column:
    """128 bits of a normalised passage."""
    return F.unhex(F.md5(norm))


def links(messages: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """messages (node, conv, turn, text) -> node, conv, turn, at, level, norm_words, to_conv, to_turn for every quoted passage; to_* null if unlinked."""
    quoting = messages.where(F.col("text").rlike(r"(?m)^[\x20\t]*>"))
    found = scratch.table(passages(quoting).withColumns({"key": _key(F.col("norm")), "norm_words": F.size(F.split("norm", " "))}).drop("norm"), "passages")
    quoted = found.where("level > 0").select("node", "conv", "turn", "at", "level", "norm_words", "key")
    # what messages offer: their own passages, and their whole own text; only keys that are quoted somewhere are wanted
    offered = passages(messages.where("conv IS NOT NULL AND turn IS NOT NULL")).where("level = 0").select("conv", "turn", _key(F.col("norm")).alias("key"))
    whole = messages.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn", normalised(body_of(F.col("text"))).alias("norm")).where("norm <> ''")
    offered = offered.unionAll(whole.select("conv", "turn", _key(F.col("norm")).alias("key")))
    wanted = quoted.select("key").distinct()
    offered = scratch.table(offered.join(wanted, "key", "left_semi").distinct(), "offered")

    # within a conversation: the latest earlier turn among those that have the passage, by a running maximum
    quotes = quoted.withColumn("has", F.lit(None).cast("long"))
    both = quotes.unionByName(offered.select("conv", "turn", "key", F.col("turn").alias("has")), allowMissingColumns=True).where("conv IS NOT NULL AND turn IS NOT NULL")
    before = Window.partitionBy("conv", "key").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("has").over(before)).where("node IS NOT NULL").select("node", "at", "near")
    first = offered.groupBy("key").agg(F.min(F.struct("conv", "turn")).alias("first"), F.max("conv").alias("last_conv"))
    # the first message of another conversation: the least of all, or, where that is this conversation, the least of the others
    others = offered.join(first, "key").where(F.col("conv") != F.col("first.conv")).groupBy("key").agg(F.min(F.struct("conv", "turn")).alias("second"))
    far = first.select("key", "first").join(others, "key", "left")
    out = quoted.join(near, ["node", "at"], "left").join(far, "key", "left")
    far_one = F.when(F.col("norm_words") >= min_words, F.when(F.col("first.conv").eqNullSafe(F.col("conv")), F.col("second")).otherwise(F.col("first")))
    return out.select(
        "node", "conv", "turn", "at", "level", "norm_words",
        F.when(F.col("near").isNotNull(), F.col("conv")).otherwise(far_one["conv"]).alias("to_conv"),
        F.when(F.col("near").isNotNull(), F.col("near")).otherwise(far_one["turn"]).alias("to_turn"),
    )


def link_quotations(messages: DataFrame, min_words: int = MIN_WORDS, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Per row of messages: conv_id, turn, role, body, quote_depth, n_quoted, n_linked, reply_conv, reply_turn, thread_turn.

    reply_*: what the message answers, in its conversation or, if there is nothing there, in another one; thread_turn: the
    first turn of its thread. Sort by conv_id, thread_turn and turn for conversations in reply order.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    rows = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = scratch.table(rows.withColumn("node", F.monotonically_increasing_id()), "rows")
    found = scratch.table(links(rows, scratch, min_words), "links")
    linked = F.when(F.col("to_turn").isNotNull(), F.struct((F.col("to_conv") != F.col("conv")).alias("away"), "level", "at", "to_conv", "to_turn"))
    per = found.groupBy("node").agg(
        F.max("level").alias("quote_depth"), F.count("*").alias("n_quoted"), F.count("to_turn").alias("n_linked"), F.min(linked).alias("reply")
    )
    out = rows.join(per, "node", "left")
    # threads: links within conversations, whose nodes are texts that sort as their turns do
    name = lambda turn: F.concat_ws(":", F.col("conv").cast("string"), F.lpad((F.col(turn) + F.lit(1 << 62)).cast("string"), 20, "0"))
    edges = out.where("reply IS NOT NULL AND NOT reply.away").select("conv", "turn", F.col("reply.to_turn").alias("to"))
    classes = connected_components(scratch, edges.select(name("turn").alias("u"), name("to").alias("v")))
    classes = classes.select("node", (F.substring_index("component", ":", -1).cast("long") - F.lit(1 << 62)).alias("thread")).withColumnRenamed("node", "name")
    out = out.withColumn("name", name("turn")).join(classes, "name", "left")
    return out.select(
        F.col("conv").alias("conv_id"), "turn", "role", body_of(F.col("text")).alias("body"),
        F.coalesce("quote_depth", F.lit(0)).alias("quote_depth"), F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.col("reply.to_conv").alias("reply_conv"), F.col("reply.to_turn").alias("reply_turn"), F.coalesce("thread", "turn").alias("thread_turn"),
    )


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))
