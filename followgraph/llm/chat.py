"""Chat transcripts as training text, with Spark expressions only.

The template, for every run of turns of one role:

    ### role</role>
    first text</part>next text of the same role</turn>

Inside roles and texts a backslash is doubled, ``##`` becomes ``#\\#`` and
``</`` becomes ``<\\/``. So neither ``###`` nor any of the closing marks occurs
there, and dropping each backslash but keeping what follows it restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = "### "
ROLE = "</role>\n"
PART = "</part>"
TURN = "</turn>\n"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """``text`` without control strings; ``unescaped`` undoes it."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("##"), F.lit("#\\#"))
    return F.replace(out, F.lit("</"), F.lit("<\\/"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_spans), one row per conversation.

    ``turns`` has conv_id, turn, role and text. Turns are sorted by turn, rows
    of equal turn by role, then text; adjacent turns of one role share one
    header. ``loss_spans`` is an array of (start, stop), in code points of
    ``formatted``, one for each text of ``loss_role``; marks are outside.

    A null text or role is empty and sorts as such; a null turn sorts first;
    rows without a conv_id form one conversation. Repeated rows count as
    often as they occur. No turns, no rows. Other columns are ignored. A
    conversation becomes one value, so one conversation must fit in memory;
    rows of different conversations never meet in one value.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").cast("bigint").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    n = F.size("ts")

    def piece(t: Column, i: Column) -> Column:
        before = F.get(F.col("ts"), i - 1)["role"]
        after = F.get(F.col("ts"), i + 1)["role"]
        opens = (i == 0) | (before != t["role"])
        closes = (i == n - 1) | (after != t["role"])
        return F.struct(
            F.when(opens, F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(ROLE))).otherwise("").alias("head"),
            escaped(t["text"]).alias("body"),
            F.when(closes, F.lit(TURN)).otherwise(F.lit(PART)).alias("tail"),
            (t["role"] == loss_role).alias("loss"),
        )

    pieces = sorted_turns.select("conv_id", F.transform("ts", piece).alias("ps"))
    lengths = F.transform(
        "ps",
        lambda p: F.struct(
            F.length(p["head"]).alias("head"),
            F.length(p["body"]).alias("body"),
            F.length(p["tail"]).alias("tail"),
            p["loss"].alias("loss"),
        ),
    )
    nothing = F.lit(None).cast("array<struct<start:int,stop:int>>")
    first = F.struct(F.lit(0).alias("at"), F.coalesce(nothing, F.array()).alias("spans"))

    def step(done: Column, p: Column) -> Column:
        start = done["at"] + p["head"]
        stop = start + p["body"]
        span = F.struct(start.alias("start"), stop.alias("stop"))
        spans = F.when(p["loss"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct((stop + p["tail"]).alias("at"), spans.alias("spans"))

    text = F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return pieces.select(
        "conv_id",
        text.alias("formatted"),
        F.aggregate(lengths, first, step, lambda done: done["spans"]).alias("loss_spans"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted) from ``formatted`` output alone.

    ``turns`` is an array of (role, text) in order; ``loss_texts`` are the
    texts cut out of ``formatted`` by ``loss_spans``.
    """

    def block(b: Column) -> Column:
        body = F.split(b, ROLE, 2)
        role = unescaped(F.substring(F.get(body, F.lit(0)), len(OPEN) + 1, 1 << 30))
        return F.transform(
            F.split(F.get(body, F.lit(1)), PART),
            lambda part: F.struct(role.alias("role"), unescaped(part).alias("text")),
        )

    blocks = F.filter(F.split("formatted", TURN), lambda b: b != "")
    cut = F.transform(
        "loss_spans",
        lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])),
    )
    return chats.select(
        "conv_id",
        F.flatten(F.transform(blocks, block)).alias("turns"),
        cut.alias("loss_texts"),
        "formatted",
    )


def digests(chats: DataFrame) -> DataFrame:
    """Counts and hashes of what ``read_back`` finds in ``formatted`` output."""
    loss = F.array_join("loss_texts", "")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(chats).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
