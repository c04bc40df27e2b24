"""Chat formatting with relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template.  A block is opened, role, body, closed; texts of one block
#: are divided by the inner mark.
OPEN, BODY, INNER, CLOSE = "<turn>", "<body>", "<and>", "</turn>\n"

TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    r"""No ``<`` is left, so no template mark can be: ``\`` becomes ``\b``, ``<`` ``\l``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One training string per conversation, with the spans that carry loss.

    Input columns conv_id, turn, role, text; others are ignored.  Turn structs are
    collected and sorted by (turn, role, text), adjacent turns of one role become one block
    by an array aggregate, and blocks are concatenated.  Output: conv_id, formatted, and
    loss_spans, an array of (start, length) in code points, 1-based, one per text of the
    trained role.

    Null texts and roles are empty; a null turn sorts first; repeated rows stay; a null
    conv_id is a conversation of its own.  An empty table gives no rows.  A conversation is
    one output string and so meets in one task; that bounds its size, as it must fit a row.
    """
    empty = F.lit("")
    collected = (
        turns.select(
            "conv_id",
            F.struct(
                F.col("turn").cast("long").alias("turn"),
                escaped(F.coalesce("role", empty)).alias("role"),
                escaped(F.coalesce("text", empty)).alias("text"),
            ).alias("one"),
        )
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("one")).alias("turns"))
    )
    # The blocks: same role as the one before extends the last block.
    start = F.expr("cast(array() as array<struct<role: string, texts: array<string>>>)")

    def add(blocks: Column, one: Column) -> Column:
        last = F.element_at(blocks, -1)
        grown = F.struct(
            last["role"].alias("role"), F.array_append(last["texts"], one["text"]).alias("texts")
        )
        fresh = F.struct(one["role"].alias("role"), F.array(one["text"]).alias("texts"))
        kept = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))
        same = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == one["role"])
        return F.when(same, F.array_append(kept, grown)).otherwise(F.array_append(blocks, fresh))

    blocks = collected.select("conv_id", F.aggregate("turns", start, add).alias("blocks"))
    # Pieces in output order: marks and texts, each with a flag for loss.
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.flatten(
                F.array(
                    F.array(
                        F.struct(
                            F.concat(F.lit(OPEN), b["role"], F.lit(BODY)).alias("piece"),
                            F.lit(False).alias("loss"),
                        )
                    ),
                    F.flatten(
                        F.transform(
                            b["texts"],
                            lambda t, i: F.array(
                                F.struct(
                                    F.when(i > 0, F.lit(INNER)).otherwise("").alias("piece"),
                                    F.lit(False).alias("loss"),
                                ),
                                F.struct(
                                    t.alias("piece"),
                                    (b["role"] == escaped(F.lit(trained_role))).alias("loss"),
                                ),
                            ),
                        )
                    ),
                    F.array(F.struct(F.lit(CLOSE).alias("piece"), F.lit(False).alias("loss"))),
                )
            ),
        )
    )
    located = blocks.select("conv_id", pieces.alias("pieces")).select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.aggregate(
            "pieces",
            F.struct(
                F.lit(1).alias("at"),
                F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("spans"),
            ),
            lambda held, p: F.struct(
                (held["at"] + F.length(p["piece"])).alias("at"),
                F.when(
                    p["loss"],
                    F.array_append(
                        held["spans"],
                        F.struct(
                            held["at"].alias("start"), F.length(p["piece"]).alias("length")
                        ),
                    ),
                )
                .otherwise(held["spans"])
                .alias("spans"),
            ),
        )["spans"].alias("loss_spans"),
    )
    return located


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order: an array of (role, text)."""
    blocks = F.filter(F.split(formatted, OPEN, -1), lambda b: b != "")

    def texts(block: Column) -> Column:
        role = F.substring_index(block, BODY, 1)
        body = F.substr(block, F.length(role) + F.lit(1 + len(BODY)))
        body = F.left(body, F.length(body) - F.lit(len(CLOSE)))
        return F.transform(
            F.split(body, INNER, -1),
            lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, texts))


def trained_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss spans, unescaped, in order."""
    return F.transform(
        spans, lambda s: unescaped(F.substr(formatted, s["start"], s["length"]))
    )
