"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gather_turns(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: conv_id, turns array<struct<role,text>> in order of turn, then role, then text.

    Null roles and texts become empty. Rows without a conversation id form one conversation with a null id. Repeated
    rows are turns of their own.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(turn))
    return rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(turns: Column, template: str = "<|%s|>\n%s<|end|>\n") -> Column:
    return F.array_join(F.transform(turns, lambda t: F.format_string(template, t["role"], t["text"])), "")


def loss_spans(turns: Column, role: str = "assistant", head: int = 5, tail: int = 8) -> Column:
    """[start, end) code-point spans of the rendered `turns` on which the loss is taken: the texts of `role`.

    `head` and `tail` are what the template writes around role and text: "<|" and "|>\\n", "<|end|>\\n".
    """
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["role"]) + head
        end = begin + F.length(t["text"])
        span = F.array(F.struct(begin.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        return F.struct((end + tail).cast("bigint").alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of leading turns, role and text, that both conversations share."""
    same = F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b) & a.isNotNull() & b.isNotNull())
    first_other = F.array_position(same, False)
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int")


def preference_format(pairs: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Format pairs (pair_id, chosen, rejected: arrays of struct<role,text>) for preference training.

    Returns pair_id, n_prompt_turns, prompt, chosen, rejected (rendered completions after the longest common turn
    prefix) and chosen_spans, rejected_spans: where in each completion the loss counts. The prompt is rendered once
    and is never trained on. All of it is Spark expressions over one row: no shuffle, no Python.

    A null conversation counts as one without turns. If one conversation is a prefix of the other, its completion is
    empty and has no spans; if both are equal, both are. Repeated pairs give repeated rows. Other columns are ignored.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    filled = lambda c: F.transform(F.coalesce(F.col(c), none), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    df = pairs.select("pair_id", filled("chosen").alias("c"), filled("rejected").alias("r"))
    df = df.withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.size(c))
    df = df.select("pair_id", F.col("n").alias("n_prompt_turns"), F.slice("c", 1, F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return df.select(
        "pair_id", "n_prompt_turns", render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"),
        loss_spans(F.col("c"), loss_role).alias("chosen_spans"), loss_spans(F.col("r"), loss_role).alias("rejected_spans"),
    )


def degraded_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: rejected is chosen with its later assistant turns in reverse word order.

    From turn floor(n / 2) on, a conversation's assistant texts are reversed by word, which keeps their words and
    length and spoils their sense; the earlier turns stay, so they are the common prefix.
    """
    backwards = lambda t: F.array_join(F.reverse(F.split(t, " ")), " ")
    spoilt = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when((t["role"] == "assistant") & (i >= F.floor(F.size("turns") / 2)), backwards(t["text"])).otherwise(t["text"]).alias("text")))
    return conversations.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), spoilt.alias("rejected"))


def spans_text(spans: Column) -> Column:
    """Spans as text 'start-end,...', for digests and comparison across engines."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
