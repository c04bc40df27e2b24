"""URL rules through a cascade of Bloom filters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import free_name
from trialweave.session import materialise

#: Largest filter a plan carries (words of 63 bits); beyond it keys are parted by hash.
MOST_WORDS = 1 << 17
PER_WORD = 63
#: Bits per key of the first filter and of the later ones.
FIRST_BITS, NEXT_BITS = 12.0, 2.0


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as words of 63, and its hashes."""

    words: tuple[int, ...]
    bits: int
    hashes: int
    salt: int


def _places(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    """Bit places of a key: double hashing of two seeded hashes."""
    one = F.pmod(F.xxhash64(F.lit(2 * salt), key), F.lit(bits))
    two = F.pmod(F.xxhash64(F.lit(2 * salt + 1), key), F.lit(bits - 1)) + 1
    return [F.pmod(one + two * k, F.lit(bits)) for k in range(hashes)]


def build_level(keys: DataFrame, count: int, salt: int, bits_per_key: float) -> Level:
    """A filter over the column ``key`` of distinct keys; its words are bounded."""
    bits = max(PER_WORD, math.ceil(count * bits_per_key / PER_WORD) * PER_WORD)
    if bits // PER_WORD > MOST_WORDS:
        raise ValueError(f"{count} keys need more than {MOST_WORDS} words: split the list")
    hashes = max(1, round(bits_per_key * math.log(2)))
    places = keys.select(F.explode(F.array(*_places(F.col("key"), bits, hashes, salt))).alias("at"))
    bit = F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(PER_WORD)).cast("int")
    )
    words = (
        places.groupBy(F.floor(F.col("at") / PER_WORD).cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("held"))
        .toLocalIterator()
    )
    held = [0] * (bits // PER_WORD)
    for row in words:
        held[row["word"]] = row["held"]
    return Level(tuple(held), bits, hashes, salt)


def in_level(key: Column, level: Level) -> Column:
    """Whether a filter lets a key pass.  The words are one folded array literal."""
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    return _all(
        F.getbit(
            F.element_at(words, (F.floor(at / PER_WORD) + 1).cast("int")),
            F.pmod(at, F.lit(PER_WORD)).cast("int"),
        )
        == 1
        for at in _places(key, level.bits, level.hashes, level.salt)
    )


def _all(tests) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def build_cascade(
    listed: DataFrame, universe: DataFrame, first_bits: float = FIRST_BITS, next_bits: float = NEXT_BITS
) -> list[Level]:
    """Filters that together decide exactly which keys of the universe are listed.

    Level 0 holds the listed keys.  Level 1 holds the keys of the universe that pass it
    without being listed, level 2 the listed keys that pass level 1, and so on until a
    level lets none of the other side through.  Both inputs have one column ``key`` and no
    nulls; ``listed`` need not lie inside ``universe``.
    """
    listed = materialise(listed.select("key").distinct(), "listed")
    others = universe.select("key").distinct().join(listed, "key", "left_anti")
    sides = [listed, materialise(others, "unlisted")]
    levels: list[Level] = []
    while True:
        holds = sides[len(levels) % 2]
        count = holds.count()
        if count == 0 and levels:
            return levels
        bits = first_bits if not levels else next_bits
        levels.append(build_level(holds, count, len(levels), bits))
        other = len(levels) % 2
        sides[other] = materialise(
            sides[other].filter(in_level(F.col("key"), levels[-1])), "passed"
        )


def in_cascade(key: Column, levels: Sequence[Level]) -> Column:
    """Exact membership of a universe key: the first level it fails decides by parity."""
    out = F.lit(len(levels) % 2 == 1)
    for depth in range(len(levels) - 1, -1, -1):
        out = F.when(in_level(key, levels[depth]), out).otherwise(F.lit(depth % 2 == 1))
    return out


def cascade_parts(listed: int, universe: int) -> int:
    """Into how many parts keys are dealt so that no filter outgrows ``MOST_WORDS``.

    The first filter holds the listed keys, the second those of the universe that pass it by
    chance; twice their expected number is allowed for, and four deviations of a part's size.
    """
    by_chance = 2 * universe * 0.6185**FIRST_BITS

    def parts(keys: float, bits: float) -> int:
        most = MOST_WORDS * PER_WORD / bits - 1
        return math.ceil(keys / (math.sqrt(4 + most) - 2) ** 2)

    return max(1, parts(listed, FIRST_BITS), parts(by_chance, NEXT_BITS))


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts))


def build_cascades(listed: DataFrame, universe: DataFrame, parts: int) -> list[list[Level]]:
    """A cascade per part of the keys, for lists and universes of any size."""
    if parts == 1:
        return [build_cascade(listed, universe)]
    mine = [part_of(F.col("key"), parts) == k for k in range(parts)]
    return [build_cascade(listed.filter(m), universe.filter(m)) for m in mine]


def in_cascades(key: Column, cascades: Sequence[Sequence[Level]]) -> Column:
    """Exact membership of a universe key, by the cascade of its part."""
    if len(cascades) == 1:
        return in_cascade(key, cascades[0])
    part, out = part_of(key, len(cascades)), F.lit(False)
    for k, levels in enumerate(cascades):
        out = F.when(part == k, in_cascade(key, levels)).otherwise(out)
    return out


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains and the start of a path."""

    verdict: str
    host: str
    path: str


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both are empty without ``://``.

    The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    the path from there to ``?``, ``#`` or the end.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def _marks(keys: Column, cascades: Sequence[Sequence[Level]], verdict: str) -> Column:
    """The listed keys among a url's keys, longest last in order of their structs."""
    return F.transform(
        F.filter(keys, lambda k: in_cascades(k, cascades)),
        lambda k: F.struct(
            F.length(k).alias("size"), k.alias("rule"), F.lit(verdict).alias("verdict")
        ),
    )


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url"
) -> DataFrame:
    """Add host, path, rule and verdict to pages.

    A url's keys are its host and each parent domain, each with every start of the path
    that is as long as some rule's path.  The distinct keys of the whole table are the
    universe of a cascade per verdict, so the verdict of each key is exact and no row is
    joined with the rules.  The longest listed key wins; a url without one gets ``default``.

    Null urls and urls without ``://`` have empty host and path and get ``default``.
    Repeated rows are judged alike; an empty table gives no rows.  Rules are configuration;
    where they or the universe outgrow one filter, keys are dealt by hash over several
    cascades.  The columns host, path, rule and verdict of the input, if any, are replaced.
    ``pages`` is read twice.
    """
    spark = pages.sparkSession
    lengths = sorted({len(r.path) for r in rules})
    host, path = parse_url(F.col(url))
    parsed = pages.withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.", -1)
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    starts = F.filter(
        F.array(*[
            F.when(F.length("path") >= n, F.left(F.col("path"), F.lit(n))) for n in lengths
        ]),
        lambda p: p.isNotNull(),
    ) if lengths else F.expr("cast(array() as array<string>)")
    # Rule text is host + path; a host has no slash, and a path starts with one or is empty.
    keys = F.flatten(
        F.transform(domains, lambda d: F.transform(starts, lambda p: F.concat(d, p)))
    )
    held, best = free_name(parsed, "_keys"), free_name(parsed, "_best")
    keyed = parsed.withColumn(held, F.when(F.col("host") == "", F.array()).otherwise(keys))
    # Hosts and short path starts repeat: reduce to distinct (host, starts) before exploding.
    universe = materialise(
        keyed.select(held).distinct().select(F.explode(held).alias("key")).distinct(),
        "url-keys",
    )
    marks, size = [], universe.count()
    for verdict in sorted({r.verdict for r in rules}):
        names = sorted({r.host + r.path for r in rules if r.verdict == verdict})
        listed = spark.createDataFrame([(n,) for n in names], "key string")
        cascades = build_cascades(listed, universe, cascade_parts(len(names), size))
        marks.append(_marks(F.col(held), cascades, verdict))
    if not marks:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    return (
        keyed.withColumn(best, F.array_max(F.concat(*marks)))
        .withColumns({
            "rule": F.col(best)["rule"],
            "verdict": F.coalesce(F.col(best)["verdict"], F.lit(default)),
        })
        .drop(held, best)
    )
