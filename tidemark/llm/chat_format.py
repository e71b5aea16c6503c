"""Collapse of cumulative conversation logs, then rendering.

A chat service that logs the whole conversation after every turn writes many conversations that are prefixes of a longer one.
Rolling hashes over the turns name every prefix of a conversation; a conversation whose own hash is a proper prefix of another
is dropped by an anti-join, and of equal conversations the smallest id stays. The rest is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`conv_id, turns, marks`: the turns in order and the hash of each prefix. A conversation is one record and must fit a row."""
    one = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    grouped = turns.select(F.col(conv_col).alias("conv_id"), one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    once = F.filter("all", lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(F.col("all"), i - 1)))
    rows = grouped.select("conv_id", once.alias("turns"))

    def roll(acc: Column, x: Column) -> Column:
        turn = F.concat_ws(":", F.length(x["role"]).cast("string"), x["role"], x["text"])
        mark = F.substring(F.sha2(F.concat(acc["last"], F.sha2(turn.cast("binary"), 256)).cast("binary"), 256), 1, 40)
        return F.struct(mark.alias("last"), F.concat(acc["marks"], F.array(mark)).alias("marks"))

    begin = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("marks"))
    return rows.withColumn("marks", F.aggregate("turns", begin, roll, lambda acc: acc["marks"]))


def render(turns: Column) -> Column:
    """The conversation as one text. Markers inside a text are defused, so they cannot open or close a turn."""
    def one(x: Column) -> Column:
        safe = F.replace(x["text"], F.lit("<|"), F.lit("<\\|"))
        return F.concat(F.lit(START), F.replace(x["role"], F.lit("<|"), F.lit("<\\|")), F.lit("\n"), safe, F.lit(STOP + "\n"))

    return F.array_join(F.transform(turns, one), "")


def collapse(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The maximal conversations: `conv_id, n_turns, n_copies, text`.

    Turns are ordered by turn number (null first), role, text; rows repeated in full count once, and rows that share a turn
    number are all turns. A null role or text counts as empty. Rows without a conversation id form one conversation with a null
    id. `n_copies` is the number of conversations with exactly these turns; the smallest id stays, null last. A conversation
    that is a proper prefix of another is dropped. Other columns are not read, and an empty table gives no rows.
    """
    convs = conversations(turns, conv_col, turn_col, role_col, text_col)
    size = F.size("marks")
    inner = convs.select(F.explode(F.slice("marks", F.lit(1), F.greatest(size - 1, F.lit(0)))).alias("full")).distinct()
    keys = convs.select("conv_id", F.element_at("marks", -1).alias("full"))
    equal = keys.groupBy("full").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    kept = equal.join(inner, "full", "left_anti").select(F.col("conv_id").alias("id"), "n_copies", "full")
    texts = convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.element_at("marks", -1).alias("own"), render(F.col("turns")).alias("text"))
    joined = texts.join(kept, texts["conv_id"].eqNullSafe(kept["id"]) & (texts["own"] == kept["full"]))
    return joined.select("conv_id", "n_turns", "n_copies", "text")
