"""Spelling variants by permuterm rotations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.session import materialise

#: Marks the end of a word inside its rotations; words do not hold it.
END = "\x00"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, lower))


def text_runs(documents: DataFrame, letters: str, least: int = 1) -> DataFrame:
    """doc_id and run: every maximal run of at least ``least`` letters, A-Z lower-cased.

    ``letters`` is the inside of a character class.  Null and empty texts have no runs;
    runs that occur several times give several rows.
    """
    found = F.regexp_extract_all(
        F.coalesce("text", F.lit("")), F.lit(f"[{letters}]{{{least},}}"), F.lit(0)
    )
    return documents.select("doc_id", F.explode(found).alias("run")).select(
        "doc_id", ascii_lower(F.col("run")).alias("run")
    )


def rotations(words: DataFrame) -> DataFrame:
    """The prefix ranges of every word's rotations: key, last, first, n.

    A word and its terminator have a rotation from every place.  The row with an empty
    ``last`` has the whole rotation as its key.  The others leave out the rotation's last
    character, which is the edited one: words that differ in that character share the key,
    and the word without it has the key as a whole rotation.  ``first`` marks the first of
    a run of equal characters, as leaving out any of them gives the same word.
    """
    turned = words.select(
        "word", "n", F.explode(F.sequence(F.lit(0), F.length("word") * 2)).alias("k")
    )
    word, size = F.col("word"), F.length("word")
    skips = F.col("k") > size
    at = F.when(skips, F.col("k") - size).otherwise(F.col("k"))
    turned = turned.select("word", "n", skips.alias("skips"), at.alias("at"))
    at, skips, one = F.col("at"), F.col("skips"), F.lit(1)
    head = word.substr(one, at - F.when(skips, 1).otherwise(0))
    last = F.when(skips, word.substr(at, one)).otherwise("")
    before = F.when(at > 1, word.substr(at - 1, one)).otherwise("")
    return turned.select(
        F.concat(word.substr(at + 1, size), F.lit(END), head).alias("key"),
        last.alias("last"),
        (skips & (last != before)).alias("first"),
        "n",
    )


def nearest_words(words: DataFrame) -> DataFrame:
    """word, n_near (words one edit away) and the commonest of them: near_n, near.

    ``words`` has distinct words and their counts n.  Rotations are sorted by key and
    scanned group by group.  A group holds at most one word per letter and the word without
    that letter, however many words there are.  Members are not paired: a member needs
    only how many others there are and the best of them, which is the group's first, or for
    the first the second.  Ties of n go to the smaller word in code-point order.
    """
    spread = rotations(words).repartition("key")
    word = F.concat(
        F.substring_index("key", END, -1), F.col("last"), F.substring_index("key", END, 1)
    )
    spread = spread.withColumns({
        "word": word,
        "least": -F.col("n"),
        "whole": F.col("last") == "",
    })
    scan = Window.partitionBy("key").orderBy("least", "word")
    group = scan.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct("least", "word")
    number = lambda flag: F.sum(flag.cast("long")).over(group)
    scanned = spread.select(
        "word", "whole", "first",
        number(~F.col("whole")).alias("edited"),
        number(F.col("whole")).alias("shorter"),
        number(F.col("first")).alias("longer"),
        F.when(F.row_number().over(scan) == 1, F.lead(me).over(scan))
        .otherwise(F.first(me).over(group)).alias("best"),
    ).filter("best is not null")
    shorter = F.when(F.col("first"), F.col("shorter")).otherwise(0)
    near = F.when(F.col("whole"), F.col("longer")).otherwise(F.col("edited") - 1 + shorter)
    return (
        scanned.groupBy("word")
        .agg(F.sum(near).alias("n_near"), F.min("best").alias("best"))
        .select("word", "n_near", (-F.col("best.least")).alias("near_n"),
                F.col("best.word").alias("near"))
    )


def variant_groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """Each word's form (its commonest near word, if ``ratio`` times as common) and root.

    ``words`` has distinct words and counts n; other columns are ignored.  Near words
    differ by one inserted, deleted or replaced code point.  Columns word, form, root, n,
    n_near, form_n; form and form_n are null for words without one, whose root is the word
    itself.  Null words are left out; an empty table gives no rows.

    Counts grow by ``ratio`` with each step to a form, so there are no circles and a chain
    has at most log(largest n) steps; roots come by doubling, with a join per doubling.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    held = materialise(
        words.filter("word is not null").select("word", F.col("n").cast("long").alias("n")),
        "words",
    )
    formed = F.col("near_n") >= ratio * F.col("n")
    near = materialise(
        held.join(nearest_words(held), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(formed, F.col("near")).alias("form"),
            F.when(formed, F.col("near_n")).alias("form_n"),
        ),
        "near-words",
    )
    most = held.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, ratio)))
    jumps = near.filter("form is not null").select("word", F.col("form").alias("to"))
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        onward = jumps.select(F.col("word").alias("to"), F.col("to").alias("next"))
        jumps = materialise(
            jumps.join(onward, "to", "left").select(
                "word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("on")
            ),
            "roots",
        )
        if not jumps.filter("on").take(1):
            break
        jumps = jumps.drop("on")
    return near.join(jumps.select("word", F.col("to").alias("root")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
