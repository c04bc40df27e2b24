"""Source divergence audit by sorted word-start pointers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.words import LETTERS, Words, words_of
from trialweave.session import materialise

#: Text bytes whose pointers are sorted together, and pairs compared in one numpy step.
SLICE_BYTES = 4 << 20
PAIRS = 1 << 20
#: Fixed value: shares of a group's words are counted in billionths.
SHARES = 1_000_000_000

RUNS = "lang string, source string, term string, n bigint, docs bigint"


def sort_pointers(words: Words, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word pointers in order of (group, word), and where each run of equal words begins.

    A multikey quicksort whose characters are eight bytes: all runs of one depth are parted
    at once, and only runs of several words that go on past that depth are sorted again.
    ``group`` must not decrease.  Equal words keep their order.
    """
    count = len(words.starts)
    order = np.arange(count, dtype=np.int32)
    begins = np.zeros(count, bool)
    run, todo, depth = group, order.copy(), 0
    while len(todo):
        key = words.piece(order[todo], depth)
        own = run[todo]
        placed = np.lexsort((key, own))
        order[todo] = order[todo][placed]
        key = key[placed]
        begins[todo[0]] = True
        begins[todo[1:]] |= (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        run = np.cumsum(begins, dtype=np.int32)
        depth += 1
        more = (words.lengths[order] >= 8 * depth) & (np.bincount(run)[run] > 1)
        todo = np.flatnonzero(more)
    return order, np.flatnonzero(begins)


def _runs_of_slice(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.RecordBatch:
    """n and docs of each (lang, word, source) of one slice, from runs of equal pointers."""
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    lang_of = langs.indices.to_numpy(zero_copy_only=False)
    source_of = sources.indices.to_numpy(zero_copy_only=False)
    # Texts by (lang, source), so that stable runs list their sources and texts in order.
    by_group = np.lexsort((source_of, lang_of))
    words = words_of(text.take(pa.array(by_group)), LETTERS)
    lang_of, source_of = lang_of[by_group], source_of[by_group]
    order, begins = sort_pointers(words, lang_of[words.rows])
    row = words.rows[order]
    if not len(order):
        cuts = ends = new_row = np.zeros(0, np.int64)
    else:
        here = source_of[row]
        edge = np.zeros(len(order), bool)
        edge[begins] = True
        edge[1:] |= here[1:] != here[:-1]
        cuts = np.flatnonzero(edge)
        ends = np.append(cuts[1:], len(order))
        new_row = edge.copy()
        new_row[1:] |= row[1:] != row[:-1]
        new_row = np.concatenate([[0], np.cumsum(new_row)])
    first = row[cuts]
    return pa.RecordBatch.from_arrays(
        [
            langs.dictionary.take(pa.array(lang_of[first])),
            sources.dictionary.take(pa.array(source_of[first])),
            words.text(order[cuts]),
            pa.array(ends - cuts, pa.int64()),
            pa.array(new_row[ends] - new_row[cuts], pa.int64()),
        ],
        names=["lang", "source", "term", "n", "docs"],
    )


def _sorted_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(0).nbytes
        if size >= SLICE_BYTES:
            yield from _emit(held)
            held, size = [], 0
    if held:
        yield from _emit(held)


def _emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks()
    runs = _runs_of_slice(*[
        pa.concat_arrays([c.cast(pa.large_string()) for c in table.column(k).chunks])
        for k in range(3)
    ])
    step = 1 << 16
    for at in range(0, runs.num_rows, step):
        part = runs.slice(at, step)
        yield pa.RecordBatch.from_arrays(
            [c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in part.columns],
            names=part.schema.names,
        )


def word_runs(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents) of every word.

    Words are maximal runs of letters (bytes from 0x80 count as letters), with A-Z
    lower-cased.  Null texts have no words, null languages and sources are ''.  Repeated
    rows are documents of their own.

    Each task sorts word-start pointers over slices of its Arrow buffers; equal runs give
    the counts, so a word is sent once per slice, language and source.
    """
    rows = documents.select(
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
    )
    return (
        rows.mapInArrow(_sorted_slices, RUNS)
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def _share(count: Column, size: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (size + kept)); decimals where longs would overflow."""
    one_more, of = count + 1, size + kept
    wide = F.expr("CAST(0 AS DECIMAL(38, 0))") + F.lit(SHARES) * one_more.cast("decimal(20,0)")
    small = F.call_function("div", F.lit(SHARES).cast("long") * one_more, of)
    large = F.call_function("div", wide, of.cast("decimal(20,0)"))
    return F.when(count < 9_000_000_000, small).otherwise(large) + 1


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class _Sums:
    """Sums of longs by (lang, left, right), merged whenever many new ones have gathered."""

    def __init__(self, most: int = 1 << 20) -> None:
        self.most = most
        self.new: dict[str, list] = {}
        self.fresh = 0

    def add(self, lang: str, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> None:
        self.new.setdefault(lang, []).append(self._reduced(left, right, value))
        self.fresh += len(self.new[lang][-1][0])

    @staticmethod
    def _reduced(left, right, value):
        if not len(left):
            return left, right, value
        order = np.lexsort((right, left))
        left, right, value = left[order], right[order], value[order]
        edge = np.ones(len(left), bool)
        edge[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        at = np.flatnonzero(edge)
        return left[at], right[at], np.add.reduceat(value, at)

    def full(self) -> bool:
        if self.fresh <= self.most:
            return False
        for lang, held in self.new.items():
            self.new[lang] = [self._reduced(*map(np.concatenate, zip(*held, strict=True)))]
        self.fresh = sum(len(h[0][0]) for h in self.new.values())
        return self.fresh > self.most // 2

    def batches(self) -> Iterator[pa.RecordBatch]:
        for lang, held in self.new.items():
            left, right, value = self._reduced(*map(np.concatenate, zip(*held, strict=True)))
            if len(left):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(left)), pa.array(left), pa.array(right),
                     pa.array(value)],
                    names=["lang", "a", "b", "value"],
                )
        self.new, self.fresh = {}, 0


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For words that occur in several sources, what their meeting changes in each pair.

    f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), where p0 and q0 are the shares of a word that
    does not occur, summed over the words of the task.
    """
    def f(p, q):
        return (p - q) ** 2 // q

    sums = _Sums()
    for batch in batches:
        langs = batch.column(0).to_pylist()
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten()
        index, share, bare = (flat.field(k).to_numpy() for k in range(3))
        lengths = np.diff(offsets)
        names, lang_of = np.unique(np.array(langs, object), return_inverse=True)
        for l, lang in enumerate(names):
            for k in np.unique(lengths[lang_of == l]):
                if k < 2:
                    continue
                at = offsets[:-1][(lang_of == l) & (lengths == k)]
                wide = max(1, PAIRS // (int(k) * min(len(at), PAIRS // int(k) + 1)))
                tall = max(1, PAIRS // (int(k) * min(wide, int(k))))
                for up in range(0, len(at), tall):
                    cell = at[up : up + tall, None] + np.arange(k)
                    s, p, p0 = index[cell], share[cell], bare[cell]
                    for lo in range(0, int(k), wide):
                        i = np.s_[:, lo : lo + wide, None]
                        j = np.s_[:, None, :]
                        value = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
                        shape = value.shape
                        sums.add(
                            lang,
                            np.broadcast_to(s[i], shape).ravel(),
                            np.broadcast_to(s[j], shape).ravel(),
                            value.ravel(),
                        )
                        if sums.full():
                            yield from sums.batches()
    yield from sums.batches()


def audit_sources(documents: DataFrame, least_documents: int = 3, most_terms: int = 200) -> DataFrame:
    """How far the sources of a language differ in their words.

    Needs text, lang and source; other columns are ignored.  Each language keeps the words
    of at least ``least_documents`` documents.  A group (lang, source) gives each kept word
    the share p = 1 + floor(10^9 (count + 1) / (N + V)): V kept words, N occurrences.  With
    f = floor((p - q)^2 / q), rows of part ``pair`` hold the sum of f over all kept words
    against each other source of the language, and rows of part ``term`` the
    ``most_terms`` words the group uses more than its language, by f against the language.

    Columns lang, source, part, item, value, rank (from 1; value descending, item
    ascending).  Groups without words still have pairs; a language without kept words has
    pairs of value 0.  An empty table gives no rows.

    Pairs are never written out per word.  Where a word is missing in one source, f depends
    only on its count in the other, so counts of equal counts are enough; only words found
    in both sources are compared, inside the task that holds the word, as sums per pair.
    """
    counts = materialise(word_runs(documents), "word-runs")
    nested = materialise(
        counts.groupBy("lang", "term")
        .agg(
            F.sum("docs").alias("docs"),
            F.sum("n").alias("total"),
            F.collect_list(F.struct("source", "n")).alias("uses"),  # one per source
        )
        .filter(F.col("docs") >= least_documents)
        .drop("docs"),
        "kept-words",
    )
    used = nested.select("lang", "term", "total", F.inline("uses"))
    kept = nested.groupBy("lang").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_size")
    )
    sizes = used.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    zero = F.lit(0).cast("long")
    in_lang = Window.partitionBy("lang").orderBy("source")
    groups = materialise(
        documents.select(
            *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
        )
        .distinct()
        .join(sizes, ["lang", "source"], "left")
        .join(kept, "lang", "left")
        .select(
            "lang", "source",
            F.row_number().over(in_lang).alias("index"),
            *[F.coalesce(c, zero).alias(c) for c in ("size", "kept", "lang_size")],
        )
        .withColumn(
            "bare",
            F.when(F.col("kept") > 0, _share(zero, F.col("size"), F.col("kept"))).otherwise(1),
        ),
        "groups",
    )
    return _pairs(nested, used, groups).unionByName(_terms(used, groups, most_terms))


def _pairs(nested: DataFrame, used: DataFrame, groups: DataFrame) -> DataFrame:
    side = ["lang", "source", "index", "bare"]
    shares = used.join(groups, ["lang", "source"]).select(
        "lang", "term", "index", "bare",
        _share(F.col("n"), F.col("size"), F.col("kept")).alias("p"),
    )
    meetings = (
        shares.groupBy("lang", "term")
        .agg(F.collect_list(F.struct("index", "p", "bare")).alias("uses"))
        .filter(F.size("uses") > 1)
        .select("lang", "uses")
        .mapInArrow(_meetings, "lang string, a int, b int, value bigint")
    )
    # Words one source has and the other lacks: equal shares are counted, then met once.
    one_sided = (
        shares.groupBy("lang", "index", "bare", "p")
        .agg(F.count(F.lit(1)).alias("words"))
        .join(
            groups.select("lang", F.col("index").alias("other"), F.col("bare").alias("q0")), "lang"
        )
        .filter("index != other")
    )
    p, p0, q0 = F.col("p"), F.col("bare"), F.col("q0")
    ahead = F.struct(
        F.col("index").alias("a"), F.col("other").alias("b"),
        ((_divergence(p, q0) - _divergence(p0, q0)) * F.col("words")).alias("value"),
    )
    back = F.struct(
        F.col("other").alias("a"), F.col("index").alias("b"),
        ((_divergence(q0, p) - _divergence(q0, p0)) * F.col("words")).alias("value"),
    )
    one_sided = one_sided.select("lang", F.inline(F.array(ahead, back)))
    changes = (
        meetings.filter("a != b").unionByName(one_sided)
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("change"))
    )
    left = groups.select("lang", "source", "kept", F.col("index").alias("a"), "bare")
    right = groups.select(
        "lang", F.col("source").alias("item"), F.col("index").alias("b"), F.col("bare").alias("q0")
    )
    value = F.col("kept") * _divergence(p0, q0) + F.coalesce("change", F.lit(0).cast("long"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        left.join(right, "lang").filter("a != b")  # the rows asked for: a source and another
        .join(changes, ["lang", "a", "b"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
        .withColumn("rank", F.row_number().over(by_value))
    )


def _terms(used: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    p = _share(F.col("n"), F.col("size"), F.col("kept"))
    q = _share(F.col("total"), F.col("lang_size"), F.col("kept"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        used.join(groups, ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
        .filter("p > q")
        .select(
            "lang", "source", F.lit("term").alias("part"), "item",
            _divergence(F.col("p"), F.col("q")).alias("value"),
        )
        .withColumn("rank", F.row_number().over(by_value))
        .filter(F.col("rank") <= most)
    )
