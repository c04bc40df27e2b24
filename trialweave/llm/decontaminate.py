"""Benchmark decontamination by SimHash over item-sized windows."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from trialweave.llm.common import hash_cell

#: Benchmark items one pass over the documents carries; more items take more passes.
ITEMS_PER_PASS = 20_000


def _shingles(text: str | None, size: int) -> list[bytes]:
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and spaces only
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(words) - size + 1].tolist()
    return [joined[a:b] for a, b in zip(begins, ends[size - 1 :].tolist(), strict=True)]


def _bits(shingles: list[bytes], seed: int) -> np.ndarray:
    hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], "<u8")
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _prints(ones: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of windows from their counts of set bits."""
    return np.packbits(2 * ones > size, axis=1, bitorder="little").view("<u8").reshape(-1)


class ItemIndex:
    """Items of one pass: their shingles, and a multi-index of fingerprints per length.

    A fingerprint is cut into ``segments``; every item is filed, per segment, under each
    value in a Hamming ball around its own.  Ball radii follow the pigeonhole rule, so a
    window within ``radius`` bits of an item meets it in some segment.
    """

    def __init__(self, items: list[tuple], shingle: int, radius: int, seed: int) -> None:
        self.shingle, self.radius, self.seed = shingle, radius, seed
        self.counts = [Counter(_shingles(text, shingle)) for _, text in items]
        self.ids = [i for i, _ in items]
        self.sizes = [sum(c.values()) for c in self.counts]
        self.known = frozenset(s for c in self.counts for s in c)
        near = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)])
        by_size = defaultdict(list)
        for k, size in enumerate(self.sizes):
            if size:
                by_size[size].append(k)
        self.by_size = {}
        for size, members in sorted(by_size.items()):
            ones = np.array(
                [_bits(list(self.counts[k].elements()), seed).sum(axis=0, dtype=np.int64)
                 for k in members]
            )
            prints = _prints(ones, size)
            cut = prints.view(np.uint8).reshape(-1, 8)  # eight segments of eight bits
            balls = [radius // 8 if s <= radius % 8 else radius // 8 - 1 for s in range(8)]
            filed = np.stack([near[:, cut[:, s]] <= balls[s] for s in range(8)])
            self.by_size[size] = (np.array(members), prints, filed)
        self.longest = max(self.by_size, default=0)

    def matches(self, text: str | None, least: float) -> list[tuple]:
        """(item id, similarity, first word) of the best window per item at ``least`` or more."""
        shingles = _shingles(text, self.shingle)
        known = self.known
        hits = [i for i, s in enumerate(shingles) if s in known]
        if not hits:
            return []
        best: dict[int, tuple[float, int]] = {}
        for begin, end in self._stretches(hits, len(shingles)):
            part = shingles[begin:end]
            ones = np.zeros((len(part) + 1, 64), np.int32)
            np.cumsum(_bits(part, self.seed), axis=0, out=ones[1:])
            own = np.zeros(len(part) + 1, np.int64)
            own[[i - begin for i in hits if begin <= i < end]] = 1
            seen = np.r_[0, np.cumsum(own[:-1])]
            for size, (members, prints, filed) in self.by_size.items():
                self._windows(part, begin, ones, seen, size, members, prints, filed, least, best,
                              len(shingles))
        return [(self.ids[k], s, at) for k, (s, at) in sorted(best.items())]

    def _stretches(self, hits: list[int], count: int) -> list[list[int]]:
        """Ranges of shingles that some window with a hit covers."""
        out: list[list[int]] = []
        for i in hits:
            low, high = max(0, i - self.longest + 1), min(count, i + self.longest)
            if out and low <= out[-1][1]:
                out[-1][1] = high
            else:
                out.append([low, high])
        return out

    def _windows(
        self, part, begin, ones, seen, size, members, prints, filed, least, best, count
    ) -> None:
        width = min(size, count)  # a text shorter than the item is one window
        if len(part) < width:
            return
        starts = np.flatnonzero(seen[width:] > seen[: len(seen) - width])
        if not len(starts):
            return
        found = _prints(ones[starts + width] - ones[starts], width)
        cut = found.view(np.uint8).reshape(-1, 8)
        candidate = np.zeros((len(found), len(members)), bool)
        for s in range(8):
            candidate |= filed[s][cut[:, s]]
        at, who = np.nonzero(candidate)
        close = np.bitwise_count(found[at] ^ prints[who]) <= self.radius
        for a, w in zip(at[close].tolist(), who[close].tolist(), strict=True):
            k, start = int(members[w]), int(starts[a])
            window, item = Counter(part[start : start + width]), self.counts[k]
            both = sum((window & item).values())
            similarity = both / (width + self.sizes[k] - both)
            if similarity >= least and similarity > best.get(k, (0.0, 0))[0]:
                best[k] = (similarity, begin + start)


def contaminations(
    documents: DataFrame,
    items: DataFrame,
    least: float = 0.8,
    shingle: int = 5,
    radius: int = 20,
    seed: int = 42,
    items_per_pass: int = ITEMS_PER_PASS,
) -> DataFrame:
    """Rows (doc_id, item_id, similarity, first_word): items found in whole texts.

    Needs doc_id and text of documents, item_id and text of items; other columns are
    ignored.  A window of a text is as long as the item; A-Z is lower-cased, words are split
    at ASCII white space, and a window is compared by its ``shingle``-word shingles with
    their counts: sum of minima over sum of maxima, ``least`` or more.  The best window of
    each text and item is returned, the first of equals.

    Every window with at least one shingle of some item gets a SimHash fingerprint (other
    windows have similarity 0).  A multi-index finds all items of that length within
    ``radius`` of 64 bits, and exact similarity decides.  At similarity 0.8 a bit differs
    with probability 0.15, so 20 bits miss less than one window in a thousand.

    Null and empty texts match nothing.  Items of fewer words than a shingle match only
    texts that are that very sequence; items without words match nothing.  Repeated rows
    are compared each; rows that repeat an item_id are items of their own and give the best
    of them.  Empty tables give no rows.

    The items are a query set: ``items_per_pass`` of them are sent to the workers at a time,
    and each further such block is another pass over the documents.
    """
    whole = documents.select("doc_id", "text")
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    schema = (
        f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, "
        f"item_id {items.schema['item_id'].dataType.simpleString()}, "
        "similarity double, first_word bigint"
    )
    out = None
    for held in _blocks(items, items_per_pass):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(held.value, shingle, radius, seed)
            for batch in batches:
                rows = [
                    (k, *hit)
                    for k, text in enumerate(batch.column(1).to_pylist())
                    for hit in index.matches(text, least)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([r[1] for r in rows], item_type),
                        pa.array([r[2] for r in rows], pa.float64()),
                        pa.array([r[3] for r in rows], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "similarity", "first_word"],
                )

        found = whole.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(items: DataFrame, most: int) -> Iterator[Broadcast]:
    """The items with a text in blocks of about ``most``, each sent to the workers."""
    kept = items.select("item_id", "text").filter("text is not null")
    passes = max(1, -(-kept.count() // most))
    for number in range(passes):
        block = kept.filter(hash_cell(passes, "item_id", "text") == number).collect()
        yield items.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in block])


def without_contaminated(
    documents: DataFrame,
    items: DataFrame,
    least: float = 0.8,
    shingle: int = 5,
    radius: int = 20,
    seed: int = 42,
    items_per_pass: int = ITEMS_PER_PASS,
) -> DataFrame:
    """The documents without any match, with all their columns; see ``contaminations``.

    Rows are filtered where they are read: nothing is joined or shuffled.
    """
    place = documents.columns.index("text")
    for held in _blocks(items, items_per_pass):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(held.value, shingle, radius, seed)
            for batch in batches:
                texts = batch.column(place).to_pylist()
                yield batch.filter(pa.array([not index.matches(t, least) for t in texts], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
