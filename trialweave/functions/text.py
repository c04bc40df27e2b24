"""Text columns: markup, titles, identifiers, DOIs, abstracts, labels."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities replaced without leaving the JVM; "&amp;" goes last so that
# an escaped entity is decoded once only.
COMMON_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&nbsp;": " ",
    "&middot;": "·",
    "&copy;": "©",
    "&amp;": "&",
}


def decode_entities(text: Column) -> Column:
    """HTML entities to characters.

    Rows that hold only common entities stay in the JVM.  The others go through an
    Arrow batch of the standard library's decoder; rows that do not need it send a
    null across.
    """

    @F.pandas_udf("string")
    def rare(batch: pd.Series) -> pd.Series:
        return batch.map(html.unescape, na_action="ignore")

    # Not copied into inferred null filters: each branch sends its rows across once.
    rare = rare.asNondeterministic()
    known = "|".join(COMMON_ENTITIES)
    needs_rare = F.contains(F.regexp_replace(text, known, ""), F.lit("&"))
    decoded = text
    for entity, char in COMMON_ENTITIES.items():
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return F.coalesce(rare(F.when(needs_rare, text)), decoded)


def squeeze(text: Column) -> Column:
    """Runs of white space (Unicode) to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_markup(text: Column) -> Column:
    """Tags out, entities decoded, blanks squeezed; nothing left gives null."""
    plain = squeeze(decode_entities(F.regexp_replace(text, r"<[^>]+>", " ")))
    return F.when(plain != "", plain)


def normalized_title(title: Column) -> Column:
    """Key under which two spellings of one title meet."""
    plain = F.lower(F.regexp_replace(decode_entities(title), r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(plain, r"[^a-z0-9]+", " "))


def bare_doi(doi: Column) -> Column:
    return F.regexp_replace(doi, r"(?i)^https?://(?:dx\.)?doi\.org/", "")


def stable_paper_id(doi: Column, source: Column, source_id: Column) -> Column:
    has_doi = doi.isNotNull() & (doi != "")
    return F.when(has_doi, F.lower(doi)).otherwise(F.concat_ws(":", source, source_id))


def abstract_from_positions(inverted: Column) -> Column:
    """Text from a word -> positions map, built inside the row."""
    pairs = F.flatten(
        F.transform(
            F.map_entries(inverted),
            lambda e: F.transform(
                e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word"))
            ),
        )
    )
    words = F.transform(F.sort_array(pairs), lambda x: x["word"])
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def positions_of_words(words: Column) -> Column:
    """Word -> positions map of a list of words, built inside the row: the inverse of
    ``abstract_from_positions``.  The list is sorted once and cut where the word changes."""

    def entries(placed: Column) -> Column:
        size = F.size(placed)
        starts = F.filter(
            F.sequence(F.lit(1), size),
            lambda i: (i == 1) | (F.get(placed, i - 1)["word"] != F.get(placed, i - 2)["word"]),
        )
        # The next start of each start; the arrays bound by a lambda are evaluated once.
        cuts = F.transform(
            F.array(starts),
            lambda s: F.zip_with(
                s,
                F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(size + 1)),
                lambda a, b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
        return F.transform(
            F.filter(F.get(cuts, F.lit(0)), lambda c: c["a"].isNotNull()),
            lambda c: F.struct(
                F.get(placed, c["a"] - 1)["word"],
                F.transform(F.slice(placed, c["a"], c["b"] - c["a"]), lambda p: p["at"]),
            ),
        )

    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))
    filled = F.get(F.transform(F.array(placed), entries), F.lit(0))
    return F.when(F.size(words) > 0, F.map_from_entries(filled))


def first_of(values: Column) -> Column:
    return F.get(values, F.lit(0))


def year_of_parts(date_parts: Column) -> Column:
    """Year from nested [[year, month, day]]; null where absent."""
    return F.get(F.get(date_parts, F.lit(0)), F.lit(0)).cast("int")


def joined_names(people: Column) -> Column:
    """given + family per person, blanks skipped, persons without a name dropped."""
    full = F.transform(
        people,
        lambda p: F.array_join(
            F.filter(F.array(p["given"], p["family"]), lambda part: part != ""), " "
        ),
    )
    return F.filter(full, lambda name: name != "")


def artifact_identifier(value: Column) -> Column:
    """Lower case, blanks to underscores; null where the result is not a safe name."""
    name = F.replace(F.lower(F.trim(value)), F.lit(" "), F.lit("_"))
    return F.when(name.rlike(SAFE_NAME), name)


def path_identifier(value: Column) -> Column:
    """Every character outside letters, digits, dot, dash, underscore to underscore."""
    name = F.regexp_replace(value, r"[^A-Za-z0-9._-]", "_")
    return F.when(name != "", name)


# Fixed value: shape of a safe artifact name.
SAFE_NAME = r"^[a-z0-9][a-z0-9_.-]{0,127}$"


def optional_double(text: Column) -> Column:
    """Blank and null-like words to null; any other text must be a number."""
    bare = F.lower(F.trim(text))
    return F.when(~bare.isin(*NULL_WORDS), text).cast("double")


# Words that stand for "no value" in numeric sidecar fields.
NULL_WORDS = ("", "n/a", "unknown")


def finite_or_null(value: Column) -> Column:
    infinite = F.abs(value) == F.lit(float("inf"))
    return F.when(~(F.isnan(value) | infinite), value)


def natural_order(label: Column) -> list[Column]:
    """Sort keys: all-digit labels by number first, then the others by text."""
    digits = label.rlike(r"^[0-9]+$")
    return [
        F.when(digits, 0).otherwise(1),
        F.when(digits, label.cast("decimal(38,0)")),
        label,
    ]


def path_entity(path: Column, entity: str) -> Column:
    """Value of the first ``entity-value`` folder or file part of a path."""
    value = F.regexp_extract(path, rf"(?:^|/){entity}-([^/]*)", 1)
    return F.when(path.rlike(rf"(?:^|/){entity}-"), value)


def declared_identity(path: Column, pattern: str, group: str) -> Column:
    """Named group of a declared pattern searched in a path; null where no match.

    Declared patterns use ``(?P<name>...)``; Java writes ``(?<name>...)`` and Spark
    extracts by position, so the group's number is counted from the pattern.
    """
    java = pattern.replace("(?P<", "(?<")
    return F.when(path.rlike(java), F.regexp_extract(path, java, _group_number(java, group)))


def _group_number(pattern: str, group: str) -> int:
    at = pattern.find(f"(?<{group}>")
    if at < 0:
        raise ValueError(f"pattern has no group named {group!r}: {pattern}")
    number, escaped, in_class = 0, False, False
    for i, ch in enumerate(pattern[: at + 1]):
        if escaped:
            escaped = False
        elif ch == "\\":
            escaped = True
        elif ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        elif ch == "(" and not in_class:
            rest = pattern[i + 1 : i + 4]
            named = rest.startswith("?<") and rest[2:3] not in ("=", "!")
            number += 1 if named or not rest.startswith("?") else 0
    return number


def paradigm_family(task_name: Column, semantic_text: Column, keywords: Column) -> Column:
    """``motor_imagery`` when text or keywords say so, else a name from the task."""
    imagery = F.lit("motor imagery")
    # \p{N} beside \p{L}: letters and numbers of any script stay.
    task = F.regexp_replace(
        F.trim(F.regexp_replace(F.lower(task_name), r"[^\p{L}\p{N}]+", " ")), " ", "_"
    )
    named = F.when(task != "", task).otherwise("unspecified")
    return F.when(
        F.contains(semantic_text, imagery) | F.array_contains(keywords, imagery),
        "motor_imagery",
    ).otherwise(F.concat(F.lit("bids_task_"), named))


def mentions(text: Column, phrase: str) -> Column:
    return F.contains(F.lower(text), F.lit(phrase))


def event_code_text(code: Column) -> Column:
    """Numeric event codes as text; whole numbers lose their fraction (1.0 -> 1)."""
    return F.when(code == F.floor(code), F.floor(code).cast("string")).otherwise(
        code.cast("string")
    )


def prompt_size_estimate(text: Column) -> Column:
    """Upper estimate of prompt tokens: a third of the UTF-8 bytes, at least one."""
    return F.greatest(F.lit(1), F.floor((F.octet_length(text) + 2) / 3)).cast("long")
