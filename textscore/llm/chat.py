"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, its text
alone trainable. A conversation that does not end with an assistant turn also gives one
example without a target, so that no turn is lost. The template writes a turn as

    [role]text</s>

and escapes the four characters that it needs inside roles and texts: ``\\0`` stands for
a backslash, ``\\1`` for ``<``, ``\\2`` for ``[`` and ``\\3`` for ``]``. No control string
can therefore occur inside a text, and ``unescape`` gives every text back.

Column functions only. A NULL text or role counts as empty. Turns are ordered by number
(NULL first), then role, then text, so that repeated rows and ties give one result. Rows
with a NULL conversation form one conversation. Other columns are ignored. An empty table
gives no example. A conversation is one value of its output and so has to fit in a task;
its rows are gathered once, and all that follows stays in that partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET = "assistant"
_ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("]", "\\3"))
_STOP = "</s>"


def escape(text: Column) -> Column:
    """``text`` without the template's own characters."""
    for plain, written in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    for plain, written in reversed(_ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, example, n_turns, formatted, loss_start, loss_chars), one row per assistant turn and open end.

    ``example`` numbers a conversation's examples from 0. ``loss_start`` is the offset in
    ``formatted``, in code points, of the one span of ``loss_chars`` under the loss mask;
    an example without a target has an empty span at the end.
    """
    read = turns.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
        ).alias("it"),
    )
    whole = read.groupBy("conv").agg(F.array_sort(F.collect_list("it")).alias("turns"))
    written = F.transform(
        "turns",
        lambda t: F.struct(F.concat(F.lit("["), escape(t["role"]), F.lit("]")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == TARGET).alias("target")),
    )
    ends = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.element_at("w", i)["target"] | (i == F.size("w")))
    one = F.element_at("w", F.col("end"))
    before = F.array_join(F.transform(F.slice("w", 1, F.col("end") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(_STOP))), "")
    return (
        whole.select("conv", written.alias("w"))
        .select("conv", "w", F.posexplode(ends).alias("example", "end"))
        .select("conv", "example", F.col("end").alias("n_turns"), before.alias("before"), one.alias("one"))
        .select(
            F.col("conv").alias(conv),
            "example",
            "n_turns",
            F.concat("before", "one.head", "one.body", F.lit(_STOP)).alias("formatted"),
            (F.length("before") + F.length("one.head") + F.when(F.col("one.target"), 0).otherwise(F.length("one.body") + len(_STOP))).alias("loss_start"),
            F.when(F.col("one.target"), F.length("one.body")).otherwise(0).alias("loss_chars"),
        )
    )


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The unescaped text under the loss mask, read back from a formatted example."""
    return unescape(F.substring(formatted, start + 1, chars))


def turns_of(formatted: Column) -> Column:
    """array(struct(role, text)) of the turns, read back from a formatted example."""
    pieces = F.split(formatted, _STOP)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(2), F.locate("]", p) - 2)).alias("role"),
            unescape(F.substring(p, F.locate("]", p) + 1, F.length(p))).alias("text"),
        ),
    )


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its examples: turns, text under the loss mask, characters written."""
    read = formatted.select(
        conv,
        "example",
        F.length("formatted").cast("long").alias("chars"),
        F.struct("example", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("text")).alias("loss"),
        F.struct("example", "formatted").alias("last"),
    )
    whole = read.groupBy(conv).agg(F.array_sort(F.collect_list("loss")).alias("loss"), F.max("last").alias("last"), F.sum("chars").alias("formatted_chars"))
    named = whole.select(conv, "formatted_chars", turns_of(F.col("last.formatted")).alias("turns"), F.array_join(F.col("loss.text"), "").alias("trained"))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return named.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled.cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
