r"""Chat formatting by prefix-target expansion (operator 13).

Every assistant turn becomes an example of its own: all preceding turns as
context, then that reply, which alone is trainable.  A conversation that does
not end in an assistant turn gets one more example, the whole conversation
without a trainable part, so no turn is lost.

Template, one block a turn: ``### <role>: <text></turn>`` and a line feed.
The role is URL-encoded.  In a text a backslash is doubled, a backslash is
put between two number signs and ``</turn>`` becomes ``<\/turn>``; so ``##``
and ``</turn>`` stand nowhere but in the template, blocks are found by
splitting, and ``unescape`` gives back the text.

Only built-in functions run on the data.  Blocks of a conversation meet in one
row, as an example is one text: a conversation (and its longest example) must
fit a row of Spark, 2 GB.  Conversations of one text, however many, are rows
of their own.  The examples of a conversation are as long as its prefixes
together, which is what the method asks for.

Defined results: a null text or role is an empty one; turns are ordered by
turn (null first), then role and text, so repeated rows are turns like any
other and ties do not depend on the partitions; rows with a null conv_id form
one conversation; an empty table gives no rows.  Texts are taken whole.  Extra
columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm.common import materialize, read_table

TURN_END = "</turn>"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for _ in range(2):  # the second pass meets the pairs that overlapped
        out = F.replace(out, F.lit("##"), F.lit("#\\#"))
    return F.replace(out, F.lit(TURN_END), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/])", "$1")


def conversation_blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, blocks): the template's parts of each turn, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("_turn"))
    block = lambda t: F.struct(
        (t["role"] == TARGET_ROLE).alias("target"),
        F.concat(F.lit("### "), F.url_encode(t["role"]), F.lit(": ")).alias("head"),
        escape(t["text"]).alias("body"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("_turn")), block).alias("blocks"))


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example_no, text, loss_start, loss_end, whole): an example for
    each assistant turn, and one without loss for turns after the last of them.

    The loss span is in code points of ``text``, end exclusive; ``whole`` marks
    the example that holds the complete conversation.
    """
    cut = conversation_blocks(turns).withColumn("_n", F.size("blocks"))
    ends = F.filter(F.sequence(F.lit(1), F.col("_n")),
                    lambda i: F.element_at("blocks", i)["target"] | (i == F.col("_n")))
    rows = cut.select("conv_id", "blocks", "_n", F.posexplode(ends).alias("example_no", "_end"))
    whole = lambda b: F.concat(b["head"], b["body"], F.lit(f"{TURN_END}\n"))
    last = F.element_at("blocks", F.col("_end"))
    context = F.array_join(F.transform(F.slice("blocks", F.lit(1), F.col("_end") - 1), whole), "")
    rows = rows.select("conv_id", "example_no", last.alias("_b"), context.alias("_context"), (F.col("_end") == F.col("_n")).alias("whole"))
    start = F.char_length("_context") + F.char_length("_b.head")
    target = F.col("_b.target")
    return rows.select(
        "conv_id", "example_no", F.concat("_context", whole(F.col("_b"))).alias("text"),
        F.when(target, start).alias("loss_start"), F.when(target, start + F.char_length("_b.body")).alias("loss_end"), "whole")


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    parts = F.split(text, f"{TURN_END}\n")
    blocks = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(blocks, lambda b: F.struct(
        F.url_decode(F.regexp_extract(b, r"^### ([^:]*): ", 1)).alias("role"),
        unescape(F.regexp_replace(b, r"^### [^:]*: ", "")).alias("text")))


def read_loss(rows: DataFrame) -> Column:
    """The unescaped text under an example's loss mask (empty without one)."""
    start, end = F.coalesce("loss_start", F.lit(0)), F.coalesce("loss_end", F.lit(0))
    return unescape(F.substr(rows["text"], start + 1, end - start))


def digests(formatted: DataFrame) -> DataFrame:
    """What written examples hold, per conversation."""
    rows = formatted.select(
        "conv_id", "example_no", read_loss(formatted).alias("_loss"), F.char_length("text").alias("_chars"),
        F.when(F.col("whole"), read_turns(F.col("text"))).alias("_turns"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = rows.select("conv_id", "example_no", "_loss", "_chars", F.size("_turns").cast("bigint").alias("_n"),
                       F.sha2(said, 256).alias("_said"))
    losses = F.transform(F.sort_array(F.collect_list(F.struct("example_no", "_loss"))), lambda x: x["_loss"])
    return rows.groupBy("conv_id").agg(
        F.max("_n").alias("n_turns"), F.max("_said").alias("turns_sha256"),
        F.sum(F.char_length("_loss")).cast("bigint").alias("loss_chars"), F.sha2(F.array_join(losses, ""), 256).alias("loss_sha256"),
        F.sum("_chars").cast("bigint").alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples"))


#: The further conversation of the registered query.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: format all conversations and the probe, write the examples, read them back."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TARGET_ROLE).alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return digests(materialize(examples(turns.unionByName(probe)), "chat"))
