"""Chat formatting in budgeted windows, with DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings that are escaped inside texts, those of common other templates too.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_RESTS = "|".join(re.escape(c[1:]) for c in CONTROLS)


def escape(text: Column) -> Column:
    """One more backslash after the first character of each control string; control strings with backslashes there count too."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({_RESTS})", "$1\\\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_RESTS})", "$1$2$3")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_conversations(turns: DataFrame, budget: int = 1024, history: int = 128, history_turns: int = 2, learned: str = "assistant") -> DataFrame:
    """Windows of conversations as text: (conv_id, window, formatted, tokens, over_budget, fresh, loss_spans).

    ``turns`` has conv_id, turn, role, text; a null role or text is empty, turns go by (turn, role, text) with
    null turns first, and rows of a null conv_id are one conversation. A turn's tokens are a quarter
    of its characters and 8 for its marks. Prefix sums of tokens, divided by a stride, deal turns
    into windows at turn bounds; the stride leaves room in ``budget`` for the leading system turn,
    which every window repeats, for ``history``, and for the conversation's longest turn. A window
    begins with at most ``history_turns`` last turns of the window before, of ``history`` tokens at
    most. A window with a turn of over half the budget may exceed it, and says so. ``fresh`` tells
    for each turn of the window whether it isn't a repetition; ``loss_spans`` (start, length in
    characters) cover the texts of fresh ``learned`` turns. An empty table gives no rows.
    """
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    by_pos = Window.partitionBy("conv_id").orderBy("pos")  # equal rows count one after another
    whole = Window.partitionBy("conv_id")
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    marked = plain.withColumn("pos", F.row_number().over(in_order)).select(
        "conv_id",
        "turn",
        "role",
        "text",
        "pos",
        ((F.col("pos") == 1) & (F.col("role") == "system")).alias("head"),
        (F.col("role") == learned).alias("learned"),
        _escape_role(F.col("role")).alias("out_role"),
        escape(F.col("text")).alias("out_text"),
    )
    marked = marked.withColumn("tokens", F.ceil(F.length("out_text") / 4.0) + 8)
    body = F.when(F.col("head"), 0).otherwise(F.col("tokens"))
    sized = marked.withColumn("before", F.sum(body).over(by_pos) - body)
    sized = sized.withColumn("room", F.lit(budget - history) - F.max(F.when(F.col("head"), F.col("tokens")).otherwise(0)).over(whole))
    sized = sized.withColumn("stride", F.greatest(F.col("room") - F.max(body).over(whole), F.ceil(F.col("room") / 4.0), F.lit(64)))
    sized = sized.withColumn("slot", F.floor(F.col("before") / F.col("stride")))
    sized = sized.withColumn("new", (F.col("slot") != F.coalesce(F.lag("slot").over(by_pos), F.col("slot"))).cast("int"))
    sized = sized.withColumn("span", F.sum("new").over(by_pos))
    sized = sized.withColumn("last", F.max("span").over(whole))
    back = Window.partitionBy("conv_id", "span").orderBy(F.col("pos").desc())
    sized = sized.withColumn("back", F.sum("tokens").over(back)).withColumn("rank", F.row_number().over(back))
    again = (F.col("back") <= history) & (F.col("rank") <= history_turns) & (F.col("span") < F.col("last"))

    def place(window: Column, part: int, fresh) -> Column:
        return F.struct(window.cast("long").alias("window"), F.lit(part).alias("part"), fresh.alias("fresh"))

    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda w: place(w, 0, w == 0))
    own = F.array_compact(F.array(place(F.col("span"), 2, F.lit(True)), F.when(again, place(F.col("span") + 1, 1, F.lit(False)))))
    dealt = sized.withColumn("at", F.explode(F.when(F.col("head"), every).otherwise(own)))
    fields = F.struct("at.part", "pos", "out_role", "out_text", "at.fresh", "learned", "tokens")
    windows = dealt.groupBy("conv_id", F.col("at.window").alias("window")).agg(F.sort_array(F.collect_list(fields)).alias("turns"))

    def shown(t: Column) -> Column:
        return F.concat(F.lit(OPEN), t["out_role"], F.lit("\n"), t["out_text"], F.lit(CLOSE))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + len(OPEN) + F.length(t["out_role"]) + 1
        size = F.length(t["out_text"])
        span = F.when(t["fresh"] & t["learned"], F.array(F.struct(start.cast("long").alias("start"), size.cast("long").alias("length")))).otherwise(F.lit(None))
        spans = F.concat(state["spans"], F.coalesce(span, F.array().cast("array<struct<start:bigint,length:bigint>>")))
        return F.struct((start + size + len(CLOSE)).cast("long").alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    total = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["tokens"])
    return windows.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", shown), "").alias("formatted"),
        total.alias("tokens"),
        (total > budget).alias("over_budget"),
        F.transform("turns", lambda t: t["fresh"]).alias("fresh"),
        F.aggregate("turns", zero, step, lambda s: s["spans"]).alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, window, chars, turns, loss_text) from the formatted text of each window: fresh turns and text under the mask, unescaped."""
    pieces = F.split("formatted", re.escape(CLOSE), -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column, fresh: Column) -> Column:
        inside = F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece))
        role = F.substring_index(inside, "\n", 1)
        text = F.substring(inside, F.length(role) + 2, F.length(inside))
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"), fresh.alias("fresh"))

    turns = F.filter(F.zip_with(pieces, "fresh", turn), lambda t: t["fresh"])
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return windows.select("conv_id", "window", F.length("formatted").cast("long").alias("chars"), turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """One row a conversation, from what its windows read back; texts of a conversation meet in one row."""
    back = read_back(windows)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.select("conv_id", "chars", F.size("turns").alias("n"), F.struct("window", said.alias("said"), "loss_text").alias("part"))
    joined = back.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts"))
    said, loss = F.array_join(F.col("parts.said"), ""), F.array_join(F.col("parts.loss_text"), "")
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
