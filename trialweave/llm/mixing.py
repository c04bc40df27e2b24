"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.common import count_words, free_name, running_total
from trialweave.session import materialise

#: Blocks of the shuffled order of a source, and slots of one unit of virtual time.
BLOCKS = 4096
SLOTS = 4096
#: Virtual time beyond which slots widen with the logarithm, so their number is bounded.
EVEN_UNTIL = 4


def source_targets(
    sizes: DataFrame, weights: Sequence[int], budget: float, most: int
) -> DataFrame:
    """Words each source should give: source, rank, source_size, weight, target.

    ``sizes`` has one row (source, source_size) per source.  Sources by code point, null
    last, take the weights in turn.  ``budget`` times all words are shared by weight; a
    source gives at most ``most`` times its size and the rest is shared again until none is
    above.  That level is found in one ordered pass: sources sorted by how soon they fill.
    The windows see one row per source.
    """
    each = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1))
    ranked = sizes.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ).withColumn("weight", each.cast("long"))
    by_fill = Window.orderBy(
        (F.col("full").cast("double") / F.col("weight").cast("double")), "rank"
    )
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    zero = F.lit(0).cast("long")
    levelled = (
        ranked.withColumn("full", F.col("source_size") * most)
        .withColumns({
            "place": F.row_number().over(by_fill),
            "filled": F.coalesce(F.sum("full").over(before), zero),
            "weight_left": F.sum("weight").over(everything)
            - F.coalesce(F.sum("weight").over(before), zero),
            "share": F.sum("source_size").over(everything).cast("double") * F.lit(float(budget)),
        })
        .withColumn(
            "level",
            (F.col("share") - F.col("filled").cast("double"))
            / F.col("weight_left").cast("double"),
        )
        .withColumn(
            "open", F.col("level") * F.col("weight") < F.col("full").cast("double")
        )
        .withColumn(
            "first_open",
            F.min(F.when(F.col("open"), F.struct("place", "level"))).over(everything),
        )
    )
    target = F.when(
        F.col("first_open").isNull() | (F.col("place") < F.col("first_open.place")),
        F.col("full").cast("double"),
    ).otherwise(F.col("first_open.level") * F.col("weight"))
    return levelled.select("source", "rank", "source_size", "weight", target.alias("target"))


def mix_copies(
    documents: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    budget: float = 1.5,
    most: int = 2,
    seed: str = "mix",
    blocks: int = BLOCKS,
    slots: int = SLOTS,
) -> DataFrame:
    """Every copy a document may give, with its virtual finish time and the words taken.

    Needs doc_id, source and text.  Documents of a source are shuffled by the MD5 of their
    id; a copy's finish time is the words its source has given up to its end, divided by the
    source's target.  Copies of all sources are ordered by finish time, and the mix takes
    whole copies until the next would exceed the sum of the targets.  So every source is
    within one document of its share at any point of the mix.

    One row per document and copy: doc_id, source, size, source_size, target, copy (0 to
    ``most`` - 1), finish, start_word (words of the mix before it), taken.  Equal finish
    times are ordered by source, shuffle key, doc_id, size and copy.  A null text has no
    words; documents without words and sources without words give nothing; repeated rows
    are documents of their own; an empty table gives no rows; other columns are ignored.

    Shuffles move ids and counts only.  A source is cut into blocks of its shuffled order
    and virtual time into slots, so neither a large source nor the mix meets in one task.
    """
    sized = materialise(
        documents.select("doc_id", "source", count_words(F.col("text")).alias("size")), "sized"
    )
    targets = materialise(
        source_targets(
            sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most
        ),
        "targets",
    )
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))
    lead = F.conv(F.substr(F.col("shuffle"), F.lit(1), F.lit(6)), 16, 10).cast("long")
    ranked = (
        sized.join(targets, sized["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .withColumn("shuffle", key)
        .withColumn("block", F.floor(lead * blocks / F.lit(1 << 24)))
    )
    order = [F.col("shuffle"), F.col("doc_id"), F.col("size")]
    ranked = ranked.withColumn("one", F.lit(1).cast("long"))
    placed = running_total(
        ranked, ["rank"], "block", order, {"before": "size", "ordinal": "one"}
    ).drop("one")
    copies = placed.withColumn(
        "copy", F.explode(F.array(*[F.lit(k) for k in range(most)]))
    ).withColumn(
        "finish",
        F.when(
            (F.col("target") > 0) & (F.col("size") > 0),
            (F.col("before") + F.col("size") + F.col("copy") * F.col("source_size")).cast("double")
            / F.col("target"),
        ),
    )
    slot = F.when(F.col("finish") < EVEN_UNTIL, F.floor(F.col("finish") * slots)).otherwise(
        F.lit(EVEN_UNTIL * slots) + F.floor(F.log2(F.col("finish")) * 64)
    )
    copies = materialise(copies.withColumn("slot", slot), "copies")
    queued = running_total(
        copies.filter("slot is not null").withColumn("zero", F.lit(0)),
        ["zero"],
        "slot",
        [F.col("finish"), F.col("rank"), F.col("ordinal"), F.col("copy")],
        {"start_word": "size"},
    )
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    whole = F.col("start_word") + F.col("size") <= F.lit(min(budget, most) * total)
    taken = queued.withColumn(
        "taken", F.when(whole, F.col("size")).otherwise(F.lit(0).cast("long"))
    )
    unqueued = copies.filter("slot is null").withColumns({
        "start_word": F.lit(None).cast("long"), "taken": F.lit(0).cast("long")
    })
    columns = [
        "doc_id", "source", "size", "source_size", "target", "rank", "ordinal", "copy", "finish",
        "start_word", "taken",
    ]
    return taken.select(*columns).unionByName(unqueued.select(*columns))


def mix(documents: DataFrame, **options) -> DataFrame:
    """Words taken of each document: one row per input row; see ``mix_copies``."""
    copies = mix_copies(documents, **options)
    return (
        copies.groupBy("rank", "ordinal", "doc_id", "source", "size", "source_size", "target")
        .agg(F.sum("taken").alias("taken"), F.min("finish").alias("first_finish"))
        .drop("rank", "ordinal")
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents the mix takes, each as often as it is taken, with all their columns.

    doc_id must identify a document; rows that repeat an id share its count.
    """
    own, copies, copy = (free_name(documents, n) for n in ("_id", "_copies", "_copy"))
    taken = (
        mix(documents.select("doc_id", "source", "text"), **options)
        .filter("taken > 0")
        .groupBy(F.col("doc_id").alias(own))
        .agg(F.max(F.col("taken") / F.col("size")).cast("int").alias(copies))
    )
    held = documents.join(taken, F.col("doc_id").eqNullSafe(F.col(own)))
    return held.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(
        *documents.columns
    )
