"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted by (turn, role, text), adjacent turns of one role are merged
into a block, and blocks are concatenated:

    [INST]role[ROLE]text[AND]text[/INST]        any role but assistant
    <s>text[AND]text</s>                        assistant; only its texts are under the loss mask

The six control strings are escaped inside roles and texts by one backslash after their first character (strings that
already have backslashes there get one more), so that the output can be read back exactly.

Defined results: null text or role counts as empty; a null turn sorts first; equal turn numbers sort by role, then
text; repeated rows are repeated turns; a null conversation id is a conversation of its own; no rows give no rows;
other columns are ignored. A conversation becomes one value, so one conversation's text has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import renamed

_TAIL = r"(/?s>|/?INST\]|ROLE\]|AND\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


def _segment(text: Column, loss: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(loss).alias("loss"))


def _segments(block: Column) -> Column:
    texts = block["texts"]
    spoken = F.flatten(
        F.transform(
            texts,
            lambda t, i: F.when(i == 0, F.array(_segment(t, True))).otherwise(
                F.array(_segment(F.lit("[AND]"), False), _segment(t, True))
            ),
        )
    )
    other = F.concat(F.lit("[INST]"), block["role"], F.lit("[ROLE]"), F.array_join(texts, "[AND]"), F.lit("[/INST]"))
    return F.when(
        block["role"] == "assistant",
        F.concat(F.array(_segment(F.lit("<s>"), False)), spoken, F.array(_segment(F.lit("</s>"), False))),
    ).otherwise(F.array(_segment(other, False)))


def format_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id, formatted string, segments array<struct<text, loss>> whose texts concatenate to formatted."""
    rows = renamed(rows, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    turn = F.struct("turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # sorted as given, then escaped
    escaped = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    turns = turns.select("conv_id", escaped.alias("turns"))
    role = lambda i: F.get(F.col("turns"), i)["role"]
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role(i) != role(F.greatest(i - 1, F.lit(0))))
    )
    end = lambda k: F.coalesce(F.get(F.col("starts"), k + 1), F.size("turns"))
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            role(s).alias("role"),
            F.transform(F.slice("turns", s + 1, end(k) - s), lambda t: t["text"]).alias("texts"),
        ),
    )
    segments = F.flatten(F.transform("blocks", _segments))
    return (
        turns.withColumn("starts", starts)
        .withColumn("blocks", blocks)
        .select("conv_id", segments.alias("segments"))
        .select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>> and loss_text, both parsed from `formatted`, and its length."""
    blocks = F.filter(F.split("formatted", r"(?<=\[/INST\])|(?<=</s>)", -1), lambda b: F.length(b) > 0)

    def parsed(b: Column) -> Column:
        said = F.startswith(b, F.lit("<s>"))
        inner = F.when(said, F.substring(b, F.lit(4), F.length(b) - 7)).otherwise(
            F.substring(b, F.lit(7), F.length(b) - 13)
        )
        role = F.when(said, F.lit("assistant")).otherwise(unescape(F.substring_index(inner, "[ROLE]", 1)))
        body = F.when(said, inner).otherwise(F.substring_index(inner, "[ROLE]", -1))
        return F.transform(
            F.split(body, r"\[AND\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    turns = formatted.select(
        "conv_id", F.flatten(F.transform(blocks, parsed)).alias("turns"), F.length("formatted").cast("long").alias("formatted_chars")
    )
    said = F.filter("turns", lambda t: t["role"] == "assistant")  # the one role whose blocks are under the loss mask
    loss = F.array_join(F.transform(said, lambda t: t["text"]), "")
    return turns.select("conv_id", "turns", loss.alias("loss_text"), "formatted_chars")
