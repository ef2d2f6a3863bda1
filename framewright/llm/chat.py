"""Multi-party perspective rotation: every conversation rendered once for each of its participants.

Only DataFrame functions run here. A conversation may hold any number of messages: it is rendered in
parts of PART messages, whose character offsets run on, so no row gathers a whole conversation. Its messages do
pass through one task's sort, which spills, to be numbered and to add up their offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Messages in one rendered row.
PART = 256
#: Speakers who take no perspective and keep their role in all of them.
NARRATORS = ("system",)


# How a mark begins and ends, with the backslashes that a text may have in between, and the same with one more.
_MARKS = ((r"<(\\*)\|", r"<\\$1|"), (r"\|(\\*)>", r"|\\$1>"))
# The same for a speaker's end, which stands before "|>".
_END = (r"<(\\*)\z", r"<\\$1")


def _escaped(text: Column, *marks: tuple[str, str]) -> Column:
    for mark, safe in marks:
        text = F.regexp_replace(text, mark, safe)
    return text


def perspectives(messages: DataFrame, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """(conv_id, perspective, seq, speaker, chat_role, segment, start, body_start, end, trained) of every message from every seat.

    A participant is a speaker with a message in the conversation and not a narrator. For each, that
    speaker is "assistant", narrators keep their role, and all others are "user" with their name. A
    segment is "<|role name=speaker|>\\n", the text and "<|end|>\\n"; start, body_start and end are its
    offsets in characters in the whole rendering, and trained says whether text and end mark are a
    target: they are for the perspective's own messages.

    No text or speaker can forge a mark: "<|" in either, and "|>" in a speaker, get a backslash in between (`<\\|`, `|\\>`;
    one more where there are some already, so that the texts can be told back), and so does a speaker's last "<", which "|>" follows.

    Messages stand by turn, ties by speaker and then text; a null turn comes first, a null speaker is
    "unknown", a null text is empty. Repeated rows are messages of their own. A conversation of
    narrators alone has no perspective and so no rows. Other columns don't matter.
    """
    told = messages.select(
        "conv_id",
        "turn",
        _escaped(F.coalesce(F.col("role"), F.lit("unknown")), *_MARKS, _END).alias("speaker"),
        _escaped(F.coalesce(F.col("text"), F.lit("")), _MARKS[0]).alias("body"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "speaker", "body")
    told = told.withColumn("seq", F.row_number().over(order).cast("long") - 1)
    seats = told.filter(~F.col("speaker").isin(*narrators)).groupBy("conv_id", F.col("speaker").alias("perspective")).agg(F.count(F.lit(1)).alias("own"))
    seats = seats.withColumnRenamed("conv_id", "seat_conv")
    seen = told.join(seats, F.col("conv_id").eqNullSafe(F.col("seat_conv"))).drop("seat_conv", "own")
    trained = F.col("speaker") == F.col("perspective")
    role = F.when(trained, "assistant").when(F.col("speaker").isin(*narrators), F.col("speaker")).otherwise("user")
    name = F.when(role == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise("")
    seen = seen.withColumns({"chat_role": role, "head": F.concat(F.lit("<|"), role, name, F.lit("|>\n")), "trained": trained})
    seen = seen.withColumn("segment", F.concat("head", "body", F.lit("<|end|>\n")))
    running = Window.partitionBy("conv_id", "perspective").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("end", F.sum(F.char_length("segment").cast("long")).over(running))
    return seen.withColumn("start", F.col("end") - F.char_length("segment")).withColumn("body_start", F.col("start") + F.char_length("head")).select(
        "conv_id", "perspective", "seq", "speaker", "chat_role", "segment", "start", "body_start", "end", "trained"
    )


def rotate(messages: DataFrame, narrators: tuple[str, ...] = NARRATORS, part: int = PART) -> DataFrame:
    """(conv_id, perspective, part, first_char, n_messages, text, mask) of every conversation from every seat.

    text is the rendering of up to `part` messages, beginning at character first_char of the whole;
    mask lists the trained stretches as [from, to) in characters of this row's text. The parts of one
    perspective, joined in order, are its whole rendering. See `perspectives` for the rules.
    """
    rows = perspectives(messages, narrators).withColumn("part", F.floor(F.col("seq") / part).cast("long"))
    item = F.struct("seq", "segment", "start", "body_start", "end", "trained")
    held = rows.groupBy("conv_id", "perspective", "part").agg(F.sort_array(F.collect_list(item)).alias("m"))
    first = F.col("m")[0]["start"]
    spans = F.transform(F.filter("m", lambda x: x["trained"]), lambda x: F.array(x["body_start"] - first, x["end"] - first))
    return held.select(
        "conv_id",
        "perspective",
        "part",
        first.alias("first_char"),
        F.size("m").cast("long").alias("n_messages"),
        F.array_join(F.transform("m", lambda x: x["segment"]), "").alias("text"),
        spans.alias("mask"),
    )
