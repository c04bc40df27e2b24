"""Quality rules with robust multivariate outliers, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.session import materialise

#: White space between words, symbols, and the shape of the base rules.
SPACE = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Statistics are kept as whole steps of 1/200, so sums are exact in any order.
STEPS = 200
#: Least standard deviation per statistic, in steps: differences below it are no signal.
FLOOR = (200, 60, 30, 30, 30)
SIZE = len(FLOOR)
#: Words every text is taken to hold besides its own, with their code points and capitals.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_UPPER = 20, 5, 3
#: Fixed value: median of the chi-square distribution with five degrees of freedom.
CHI_MEDIAN = 4.351


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words found twice or more in the text."""

    def covered(hashes: Column) -> Column:
        # Sorted (hash, place): equal windows are neighbours.
        ranked = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        )

        def count(s: Column) -> Column:
            last = F.size(s) - 1
            again = F.filter(
                F.transform(
                    s,
                    lambda x, j: F.when(
                        ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"]))
                        | ((j < last) & (F.get(s, F.least(j + 1, last))["h"] == x["h"])),
                        x["i"],
                    ),
                ),
                lambda p: p.isNotNull(),
            )
            return F.aggregate(
                F.sort_array(again),
                F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
                lambda held, p: F.struct(
                    (held["total"] + p + window - F.greatest(p, held["end"])).alias("total"),
                    (p + window).alias("end"),
                ),
            )["total"]

        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, let(ranked, count)).otherwise(F.lit(0))

    def windows(hashed: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(hashed) - (window - 1))
        return let(
            F.transform(places, lambda i: F.xxhash64(F.slice(hashed, i, window))), covered
        )

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= window, let(hashed, windows)).otherwise(F.lit(0)).cast("long")


def text_statistics(documents: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_upper.

    Counts of the whole text: words, their code points, symbols, lines with a word equal to
    an earlier line, words in repeated 8-word windows, exclamation marks, capitals A-Z.
    Windows are compared by 64-bit hashes of their words' hashes.  A null text has none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(SOLID))
    return documents.withColumn(
        "_counts",
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).alias("n_repeat_words"),
            ),
        ),
    ).withColumns({
        "n_words": F.col("_counts.n_words"),
        "word_chars": F.col("_counts.word_chars"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(
            lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")
        ),
        "n_repeat_words": F.col("_counts.n_repeat_words"),
        "n_marks": F.regexp_count(text, F.lit("!")).cast("long"),
        "n_upper": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
    }).drop("_counts")


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words")
    )


def _vector() -> list[Column]:
    """The transformed statistics of a text with words, in whole steps.

    Repeated words are left to the base rule.  Rates of short texts vary more; ``PRIOR_WORDS`` ordinary words are added to each text.
    """
    words = F.col("n_words") + PRIOR_WORDS
    chars = F.col("word_chars") + PRIOR_WORDS * PRIOR_CHARS
    values = [
        F.log1p(F.col("n_words")),
        chars / words,
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt((F.col("n_upper") + PRIOR_UPPER) / chars),
        F.sqrt(F.col("n_marks") / words),
    ]
    return [F.least(F.round(v * STEPS), F.lit(20.0 * STEPS)).cast("long") for v in values]


def _distance(rows: DataFrame) -> DataFrame:
    """Add ``d2``: squared distance under the joined centre m and Cholesky factor l."""
    for i in range(SIZE):
        rest = F.col(f"z{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    total = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, SIZE)),
                F.col("y0") * F.col("y0"))
    return rows.withColumn("d2", total).drop(*[f"y{i}" for i in range(SIZE)])


def _rank() -> Column:
    """The distance in whole logarithmic steps of about 1.6 %: few distinct values."""
    return F.round(F.log1p(F.col("d2")) * 64).cast("long")


def _factored(moments: DataFrame, keep: list[str]) -> DataFrame:
    """Centre and Cholesky factor from sums s, p over n rows, variances floored."""
    for i in range(SIZE):
        moments = moments.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    for i in range(SIZE):
        for j in range(i + 1):
            value = F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
            if i == j:
                value = value + float(FLOOR[i] ** 2)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(value, F.lit(1.0))) if i == j else value / F.col(f"l{j}{j}")
            moments = moments.withColumn(f"l{i}{j}", value)
    return moments.select(*keep, *PARAMETERS)


PARAMETERS = [f"m{i}" for i in range(SIZE)] + [
    f"l{i}{j}" for i in range(SIZE) for j in range(i + 1)
]


def covariance_estimates(
    vectors: DataFrame, keep_share: float = 0.75, steps: int = 3
) -> DataFrame:
    """Minimum-covariance-determinant estimates per scope.

    ``vectors`` has scope and z0..z4 (whole numbers).  The start is the median and the
    quartile range of each statistic.  A concentration step ranks a scope's rows by distance,
    keeps the ``keep_share`` that are nearest and takes their mean and covariance, which
    never raises the determinant; ``steps`` of them are made.  Distances are scaled so that
    their median is that of the chi-square distribution.  One row per scope: n (all rows),
    m*, l*, scale.  Sums and quantiles are over few distinct whole numbers and combine
    before the shuffle, so no scope is gathered anywhere.
    """
    quartiles = vectors.groupBy("scope").agg(
        *[F.percentile(f"z{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}")
          for i in range(SIZE)]
    )
    for i in range(SIZE):
        spread = (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349
        quartiles = quartiles.withColumn(f"m{i}", F.col(f"q{i}")[1]).withColumn(
            f"l{i}{i}", F.greatest(spread, F.lit(float(FLOOR[i])))
        )
    fit = quartiles.select(
        "scope",
        *[F.col(p) if p in quartiles.columns else F.lit(0.0).alias(p) for p in PARAMETERS],
    )
    for _ in range(steps):
        fit = materialise(fit, "estimates")
        ranked = _distance(vectors.join(fit, "scope")).select(
            "scope", *[f"z{i}" for i in range(SIZE)], _rank().alias("rank")
        )
        limits = materialise(
            ranked.groupBy("scope").agg(F.percentile("rank", keep_share).alias("limit")), "limits"
        )
        moments = ranked.join(limits, "scope").filter("rank <= limit").groupBy("scope").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(f"z{i}").alias(f"s{i}") for i in range(SIZE)],
            *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"p{i}{j}")
              for i in range(SIZE) for j in range(i + 1)],
        )
        fit = _factored(moments, ["scope"])
    fit = materialise(fit, "estimates")
    medians = (
        _distance(vectors.join(fit, "scope"))
        .groupBy("scope")
        .agg(F.count(F.lit(1)).alias("n"), F.percentile(_rank(), 0.5).alias("middle"))
        .withColumn("scale", F.lit(CHI_MEDIAN) / F.greatest(F.exp(F.col("middle") / 64) - 1,
                                                          F.lit(0.5)))
    )
    return materialise(fit.join(medians.select("scope", "n", "scale"), "scope"), "estimates")


def judge_quality(
    documents: DataFrame,
    cutoff: float = 85.0,
    least_group: int = 30,
    keep_share: float = 0.75,
    steps: int = 3,
) -> DataFrame:
    """Base statistics, base_failed and kept of every whole text.

    Needs doc_id, text, lang and source; other columns are ignored.  A document is kept if it
    passes the base rules and its vector of transformed statistics lies within ``cutoff``
    (squared robust Mahalanobis distance) of its language and source.  Estimates come from
    the documents that pass the base rules.  Only where five dimensions cannot be estimated
    does a wider group decide: a language and source with fewer than ``least_group`` such
    documents is judged by its language, and a language with fewer by all.

    Null and empty texts fail the base rules; null languages and sources are groups of their
    own; repeated rows count and are judged each; an empty table gives no rows.
    """
    counted = text_statistics(documents.select("doc_id", "text", "lang", "source"))
    vector = {f"z{i}": v for i, v in enumerate(_vector())}
    stored = materialise(
        counted.drop("text")
        .withColumn("base_failed", base_failed())
        .withColumns({
            **{k: F.when(~F.col("base_failed"), v) for k, v in vector.items()},
            "narrow": F.to_json(F.struct("lang", "source")),
            "wide": F.to_json(F.struct("lang", F.lit("any").alias("all_sources"))),
        })
        .drop("lang", "source"),
        "statistics",
    )
    passed = stored.filter(~F.col("base_failed"))
    names = [f"z{i}" for i in range(SIZE)]
    vectors = passed.select(
        F.explode(F.array("narrow", "wide", F.lit("all"))).alias("scope"), *names
    )
    fits = covariance_estimates(vectors, keep_share, steps)
    sizes = fits.select("scope", "n")
    pairs = passed.select("narrow", "wide").distinct()
    chosen = (
        pairs.join(sizes.select(F.col("scope").alias("narrow"), F.col("n").alias("n0")), "narrow")
        .join(sizes.select(F.col("scope").alias("wide"), F.col("n").alias("n1")), "wide")
        .select(
            "narrow",
            F.when(F.col("n0") >= least_group, F.col("narrow"))
            .when(F.col("n1") >= least_group, F.col("wide"))
            .otherwise("all")
            .alias("scope"),
        )
        .join(fits, "scope")
        .drop("scope", "n")
    )
    judged = _distance(stored.join(materialise(chosen, "chosen"), "narrow", "left"))
    near = F.coalesce(F.col("d2") * F.col("scale") <= cutoff, F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & near).alias("kept"),
        F.when(~F.col("base_failed"), F.col("d2") * F.col("scale")).alias("distance"),
    )
