"""Removal of repeated byte strings by suffix arrays of bounded shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import join_frequent
from trialweave.session import materialise

#: Bytes of the string an anchor is drawn by; a power of two.
GRAM = 64
#: Bytes hashed at once.  Positions inside a pack fit the low bits of a key.
PACK_BITS = 20
#: Bytes of one suffix array, contexts of one anchor in one shard, equal contexts that are read
#: by one shard, and strings whose digests are merged in one task.
SHARD_BYTES = 1 << 21
SHARD_CONTEXTS = 500
SHARD_COPIES = 1 << 14
MERGE_STRINGS = 1 << 20


def _byte_table() -> np.ndarray:
    """A 64-bit value per byte, by the splitmix rule."""
    with np.errstate(over="ignore"):
        z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


TABLE = _byte_table()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each position, by doubling the length."""
    held, length, factor = TABLE[data], 1, 0xD6E8FEB86659FD93
    while length < GRAM:
        held = held[:-length] * np.uint64(factor) + held[length:]
        factor = factor * factor % (1 << 64)
        length *= 2
    held ^= held >> np.uint64(32)
    held *= np.uint64(0x9E3779B97F4A7C15)
    held ^= held >> np.uint64(29)
    return held


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys, by prefix and suffix minima of blocks."""
    count = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _anchor_positions(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor position of each window of ``length`` bytes, and the gram hashes."""
    hashes = gram_hashes(data)
    low = np.uint64((1 << PACK_BITS) - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    least = _sliding_least(keys, length - GRAM + 1)
    return (least & low).astype(np.int64), hashes


def anchor_runs(
    data: np.ndarray, offsets: np.ndarray, length: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text of a batch: (index, anchors, places, first starts, runs).

    The anchor of a window of ``length`` bytes is the place of its least ``GRAM``-byte hash,
    the leftmost of equals.  It depends on the window's bytes alone, so equal windows have
    equal anchors at equal offsets.  Consecutive starts with one anchor form a run; the runs
    of a text partition its window starts.
    """
    room = (1 << PACK_BITS) - 1
    step = room - length
    at, count = 0, len(offsets) - 1
    none = np.empty(0, np.int64)
    while at < count:
        begin, end = int(offsets[at]), int(offsets[at + 1])
        if end - begin > room:  # a long text, in fixed steps
            parts = []
            for start in range(0, end - begin - length + 1, step):
                piece = data[begin + start : min(begin + start + step + length - 1, end)]
                places, hashes = _anchor_positions(piece, length)
                firsts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
                runs = np.diff(np.r_[firsts, len(places)])
                mine = places[firsts]
                parts.append((hashes[mine].view(np.int64), mine + start, firsts + start, runs))
            yield (at, *(np.concatenate(x) for x in zip(*parts, strict=True)))
            at += 1
            continue
        upto = max(at + 1, int(np.searchsorted(offsets, begin + room, "right")) - 1)
        upto = min(upto, count)
        pack = data[begin : int(offsets[upto])]
        places = hashes = None
        if len(pack) >= length:
            places, hashes = _anchor_positions(pack, length)
        for k in range(at, upto):
            a, b = int(offsets[k]) - begin, int(offsets[k + 1]) - begin
            if b - a < length:
                yield k, none, none, none, none
                continue
            own = places[a : b - length + 1]
            firsts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            mine = own[firsts]
            yield (
                k, hashes[mine].view(np.int64), mine - a, firsts,
                np.diff(np.r_[firsts, len(own)]),
            )
        at = upto


def _batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and their offsets."""
    large = column.cast(pa.large_binary())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    held = large.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    return data, offsets


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every position by its next ``depth`` bytes; equal strings, equal rank.

    Larsson-Sadakane refinement: a rank is the first place of its group; each round doubles
    the compared length and sorts only groups that still have several members.  Positions
    whose string would pass the end compare what is there, padded by zeros.
    """
    count = len(data)
    padded = np.zeros(count + 8, np.uint64)
    padded[:count] = data
    key = np.zeros(count, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + count]
    order = np.argsort(key, kind="stable")
    held = key[order]
    first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
    sizes = np.diff(np.r_[first, count])
    rank = np.empty(count + 1, np.int64)
    rank[order] = np.repeat(first, sizes)
    rank[count] = -1
    active = order[np.repeat(sizes > 1, sizes)]
    length = 8
    while length < depth and len(active):
        step = min(length, depth - length)
        ahead = rank[np.minimum(active + step, count)] + 1
        pair = rank[active] * (count + 2) + ahead
        by = np.argsort(pair, kind="stable")
        active, pair = active[by], pair[by]
        new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        sizes = np.diff(np.r_[new, len(active)])
        group = pair // (count + 2)
        group_first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        start = np.repeat(group_first, np.diff(np.r_[group_first, len(active)]))
        rank[active] = group + np.repeat(new, sizes) - start
        active = active[np.repeat(sizes > 1, sizes)]
        length += step
    return rank[:count]


def common_prefixes(
    data: np.ndarray, bases: np.ndarray, runs: np.ndarray, before: np.ndarray, depth: int
) -> np.ndarray:
    """Common prefix, up to ``depth``, of each start with the one before it in the array.

    Kasai's walk along the text, one lane per context: a start's prefix is at least its
    left neighbour's less one wherever the neighbour's partner moves along.  ``before`` maps
    a start to its predecessor, -1 for none and -2 for places that are no starts.
    """
    count = len(data)
    padded = np.zeros(count + 8, np.uint64)
    padded[:count] = data
    eight = np.zeros(count + 1, np.uint64)
    for k in range(8):
        eight[:count] = (eight[:count] << np.uint64(8)) | padded[k : k + count]
    out = np.zeros(count, np.int64)
    at, last = bases.astype(np.int64), (bases + runs - 1).astype(np.int64)
    shared = np.zeros(len(at), np.int64)
    while len(at):
        partner = before[at]
        real = partner >= 0
        mate = np.where(real, partner, 0)
        here, there = at + shared, mate + shared
        more = real & (shared < depth)
        here_in, there_in = np.minimum(here, count), np.minimum(there, count)
        by8 = more & (shared + 8 <= depth) & (eight[here_in] == eight[there_in])
        by8 &= (here + 8 <= count) & (there + 8 <= count)
        by1 = more & ~by8 & (here < count) & (there < count)
        by1[by1] = data[here[by1]] == data[there[by1]]
        done = ~by8 & ~by1
        shared = shared + np.where(by8, 8, 0) + by1
        if done.any():
            out[at[done]] = shared[done]
            follow = np.minimum(at + 1, count - 1)
            moved = np.minimum(mate + 1, count - 1)
            carry = real & (
                ((shared < depth) & (before[moved] != -2)) | (before[follow] == moved)
            )
            shared = np.where(done, np.where(carry, np.maximum(shared - 1, 0), 0), shared)
            at = at + done
            stay = at <= last
            at, last, shared = at[stay], last[stay], shared[stay]
    return out


def repeated_starts(contexts: list[tuple[bytes, int]], depth: int) -> list[np.ndarray]:
    """For (bytes, number of starts) each: which starts begin a string found again."""
    runs = np.array([r for _, r in contexts], np.int64)
    sizes = np.array([len(b) for b, _ in contexts], np.int64)
    bases = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(b for b, _ in contexts), np.uint8)
    rank = suffix_ranks(data, depth)
    within = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = np.repeat(bases, runs) + within
    array = starts[np.lexsort((starts, rank[starts]))]  # the suffix array of the starts
    before = np.full(len(data), -2, np.int64)
    before[array] = np.r_[-1, array[:-1]]
    prefix = common_prefixes(data, bases, runs, before, depth)[array]
    same = prefix >= depth
    again = np.zeros(len(data), bool)
    again[array] = same | np.r_[same[1:], False]
    return [again[b : b + r] for b, r in zip(bases, runs, strict=True)]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


#: Ranges of repeated starts; or, with a bucket, the digests a shard has in that bucket: one
#: each of repeated strings (owner -1), and those of lone starts with owner and place.
MARKS = (
    "sha string, low bigint, high bigint, bucket int, digests binary, owners binary, "
    "starts binary, shas array<string>"
)
MARK_KINDS = (
    pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(),
    pa.list_(pa.string()),
)
MARK_NAMES = ("sha", "low", "high", "bucket", "digests", "owners", "starts", "shas")
#: Rows gathered before they are sent on.
ROWS = 4000


def _packed(strings: dict[bytes, tuple[str | None, int]], buckets: int) -> Iterator[tuple]:
    """Mark rows of the strings of one shard, one per bucket of digests."""
    parts: dict[int, list] = {}
    for digest, owner in strings.items():
        parts.setdefault(int.from_bytes(digest[:4], "big") % buckets, []).append((digest, *owner))
    for bucket, held in parts.items():
        names: dict[str, int] = {}
        owners = [-1 if sha is None else names.setdefault(sha, len(names)) for _, sha, _ in held]
        yield (
            None, None, None, bucket, b"".join(d for d, *_ in held),
            np.array(owners, np.int32).tobytes(),
            np.array([start for *_, start in held], np.int64).tobytes(), list(names),
        )


def _mark_shards(depth: int, buckets: int):
    """Marks repeated starts inside each (anchor, part) of sorted context rows.

    Of a context that comes again only the first is kept: later ones are marked as they
    come, so a shard holds distinct bytes only, however often they occur.
    """

    def shard(groups: list[tuple[bool, dict]]) -> Iterator[tuple]:
        pool, owners = [], []
        for at, (split, group) in enumerate(groups):
            if split or len(group) > 1:
                for (body, _), (sha, low, run, known) in group.items():
                    owners.append((at, split, body, sha, low, run, known))
                    pool.append((body, run))
        if not pool:
            return
        strings: dict[bytes, tuple[str | None, int]] = {}
        for (_, split, body, sha, low, run, known), flags in zip(
            owners, repeated_starts(pool, depth), strict=True
        ):
            if not known:
                for a, b in _ranges(flags):
                    yield sha, low + a, low + b, None, None, None, None, None
            if split:
                # What the anchor's other shards have to know: each string once.
                for k in range(run):
                    digest = hashlib.blake2b(body[k : k + depth], digest_size=16).digest()
                    lone = not known and not flags[k]
                    if lone or digest not in strings:
                        strings[digest] = (sha, low + k) if lone else (None, 0)
        yield from _packed(strings, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), MARK_KINDS, strict=True)],
                names=list(MARK_NAMES),
            )

        groups: list[tuple[bool, dict]] = []
        key, size, rows = None, 0, []
        nothing = (None,) * 5
        for batch in batches:
            columns = batch.to_pydict()
            for anchor, part, split, sha, low, lead, run, body in zip(
                *(columns[n] for n in CONTEXT), strict=True
            ):
                if (anchor, part) != key:
                    if size >= SHARD_BYTES:
                        rows += shard(groups)
                        groups, size = [], 0
                    key = (anchor, part)
                    groups.append((split, {}))
                seen = groups[-1][1]
                held = seen.get((body, lead))
                if held is None:
                    seen[(body, lead)] = (sha, low, run, False)
                    size += len(body)
                else:
                    first, at, length, known = held
                    if not known:
                        rows.append((first, at, at + length, *nothing))
                        seen[(body, lead)] = (first, at, length, True)
                    rows.append((sha, low, low + run, *nothing))
                if len(rows) >= ROWS:
                    yield sent(rows)
                    rows = []
        rows += shard(groups)
        if rows:
            yield sent(rows)

    return run


CONTEXT = ("anchor", "part", "split", "sha", "low", "lead", "run", "body")
CONTEXT_TYPE = (
    "anchor bigint, part int, split boolean, sha string, low bigint, lead int, run int, body binary"
)


def _profile(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _batch_bytes(batch.column(2))
            found = [anchors for _, anchors, *_ in anchor_runs(data, offsets, depth)]
            lists = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum([len(x) for x in found])], pa.int32()),
                pa.array(np.concatenate(found) if found else [], pa.int64()),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), lists],
                names=["doc_id", "sha", "n_bytes", "anchors"],
            )

    return run


def _contexts(depth: int, most: int, copies: int):
    """Context rows of the picked anchors: the bytes all windows of a run cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _batch_bytes(batch.column(1))
            shas, picks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out: list[tuple] = []
            for k, anchors, places, lows, runs in anchor_runs(data, offsets, depth):
                base = int(offsets[k])
                for pick in picks[k]:
                    i, held = pick["place"], pick["held"]
                    parts = -(-held // most)
                    low, run = int(lows[i]), int(runs[i])
                    body = data[base + low : base + low + run - 1 + depth].tobytes()
                    # By the bytes, so that equal contexts meet; those of a very common
                    # passage in several shards, which the merge brings together.
                    mark = hashlib.blake2b(body, digest_size=8).digest()
                    spread = -(-held // copies)
                    part = int.from_bytes(mark, "big") % parts * spread + int(shas[k][:8], 16) % spread
                    out.append((int(anchors[i]), part, parts > 1, shas[k], low,
                                int(places[i]) - low, run, body))
                if len(out) >= 4000:
                    yield _context_batch(out)
                    out = []
            if out:
                yield _context_batch(out)

    return run


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.int32(),
             pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
        names=list(CONTEXT),
    )


def _merge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of lone starts whose string another shard has too, bucket by bucket.

    Rows are sorted by bucket.  A bucket's digests are sorted once and each is looked up
    from both ends; a shard has every string once, so two of a kind are from two shards.
    """
    def found(held: list[tuple]) -> Iterator[tuple[str, int, int]]:
        digests = np.concatenate([np.frombuffer(d, "S16") for d, *_ in held])
        ordered = np.sort(digests)
        times = np.searchsorted(ordered, digests, "right") - np.searchsorted(ordered, digests, "left")
        at = 0
        for d, owners, starts, shas in held:
            again = times[at : at + len(d) // 16] > 1
            at += len(d) // 16
            owner, start = np.frombuffer(owners, np.int32), np.frombuffer(starts, np.int64)
            again &= owner >= 0
            order = np.lexsort((start[again], owner[again]))
            own, low = owner[again][order], start[again][order]
            first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (low[1:] != low[:-1] + 1)][: len(own)])
            last = np.r_[first[1:], len(own)] - 1
            for a, b in zip(first, last, strict=True) if len(own) else ():
                yield shas[own[a]], int(low[a]), int(low[b]) + 1

    def ranges(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list(found(held))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), MARK_KINDS, strict=False)],
                names=["sha", "low", "high"],
            )

    bucket, held = None, []
    for batch in batches:
        columns = batch.to_pydict()
        for own, *rest in zip(
            *(columns[n] for n in ("bucket", "digests", "owners", "starts", "shas")), strict=True
        ):
            if own != bucket and held:
                yield from ranges(held)
                held = []
            bucket = own
            held.append(tuple(rest))
    if held:
        yield from ranges(held)


def _removal(depth: int):
    """n_removed, n_spans and the digest of what stays, per text with marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas = batch.column(0).to_pylist()
            bodies, marks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = [_kept(body, held, depth) for body, held in zip(bodies, marks, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shas, pa.string()),
                    pa.array([o[0] for o in out], pa.int64()),
                    pa.array([o[1] for o in out], pa.int64()),
                    pa.array([hashlib.sha256(o[2]).hexdigest() for o in out], pa.string()),
                    pa.array([o[2] for o in out], pa.binary()),
                ],
                names=["sha", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def _kept(body: bytes, marks: list[dict], depth: int) -> tuple[int, int, bytes]:
    spans: list[list[int]] = []
    for low, high in sorted((m["low"], m["high"]) for m in marks):
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high + depth - 1)
        else:
            spans.append([low, high + depth - 1])
    at, pieces = 0, []
    for low, high in spans:
        pieces.append(body[at:low])
        at = high
    pieces.append(body[at:])
    return sum(b - a for a, b in spans), len(spans), b"".join(pieces)


def remove_repeats(documents: DataFrame, depth: int = 400, texts: bool = False) -> DataFrame:
    """Remove every byte covered by a ``depth``-byte string that starts anywhere else too.

    Needs doc_id and text; other columns are ignored.  Strings are judged on the input, in
    the same document and across documents, and never cross documents.  One row per input
    row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``texts`` the column
    ``kept`` (bytes), null where nothing is removed.

    Null texts are empty.  Rows with equal texts of at least ``depth`` bytes, repeated rows
    included, lose everything.  Shorter texts lose nothing.  An empty table gives no rows.

    1. Equal texts are reduced to one by their SHA-256.
    2. Every window has an anchor drawn from its bytes (see ``anchor_runs``), so equal
       windows have equal anchors.  Anchors found once in the corpus cannot be part of a
       repeat: counting them (about one per 170 bytes) leaves the runs worth comparing.
    3. Runs with an anchor found again are sent, with the bytes their windows cover, to the
       shard of the anchor.  A shard sorts its bytes into a suffix array and takes common
       prefixes; every window is the start of exactly one run.
    4. An anchor with more than ``SHARD_CONTEXTS`` runs is cut over several shards by the
       bytes of the runs, so equal runs meet.  What the shards do not know of each other is
       merged by binary search over digests: each shard sends every string once, packed by
       buckets of digests of bounded size, and ranges of starts come back.
    """
    if depth < 2 * GRAM:
        raise ValueError(f"depth must be at least {2 * GRAM}")
    whole = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = whole.select(
        "doc_id", F.sha2("text", 256).alias("sha"), F.col("text").cast("binary").alias("body")
    )
    kind = documents.schema["doc_id"].dataType.simpleString()
    profile = materialise(
        hashed.mapInArrow(
            _profile(depth), f"doc_id {kind}, sha string, n_bytes bigint, anchors array<bigint>"
        ),
        "profile",
    )
    total = profile.count()
    counted = materialise(
        profile.groupBy("sha").agg(
            F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
        ),
        "texts",
    )
    # Of equal texts one row stands for all: the one with the smallest doc_id.
    one = (
        profile.join(
            counted.select("sha", "first_id"),
            (profile["doc_id"].eqNullSafe(counted["first_id"])) & (profile["sha"] == counted["sha"]),
        )
        .select(profile["sha"], "first_id", "anchors")
        .dropDuplicates(["sha"])
    )
    places = materialise(
        one.select("sha", "first_id", F.posexplode("anchors").alias("place", "anchor")), "anchors"
    )
    again = materialise(
        places.groupBy("anchor").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "again"
    )
    picked = join_frequent(
        places, again.withColumn("n", F.col("held")), "anchor", "held", "n", places.count()
    )
    picks = picked.groupBy("sha", "first_id").agg(
        F.collect_list(F.struct("place", "held")).alias("picks")
    )
    chosen = materialise(
        hashed.withColumnRenamed("sha", "own")
        .join(
            picks,
            F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("own") == F.col("sha")),
        )
        .select("sha", "body", "picks"),
        "chosen",
    )
    contexts = chosen.mapInArrow(
        _contexts(depth, SHARD_CONTEXTS, SHARD_COPIES), CONTEXT_TYPE
    )
    # A run has fewer windows than ``depth``: so many strings may have to be merged.
    spread = again.filter(F.col("held") > SHARD_CONTEXTS).agg(F.sum("held")).first()[0] or 0
    buckets = max(1, -(-spread * depth // MERGE_STRINGS))
    marked = materialise(
        contexts.repartition("anchor", "part")
        .sortWithinPartitions("anchor", "part")
        .mapInArrow(_mark_shards(depth, buckets), MARKS),
        "marks",
    )
    merged = (
        marked.filter("bucket is not null")
        .select("bucket", "digests", "owners", "starts", "shas")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_merge_shards, "sha string, low bigint, high bigint")
    )
    marks = (
        marked.filter("bucket is null")
        .select("sha", "low", "high")
        .unionByName(merged)
        .groupBy("sha")
        .agg(F.collect_list(F.struct("low", "high")).alias("marks"))
    )
    removed = (
        chosen.select("sha", "body")
        .dropDuplicates(["sha"])
        .join(marks, "sha")
        .select("sha", "body", "marks")
        .mapInArrow(
            _removal(depth),
            "sha string, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary",
        )
    )
    rows = join_frequent(
        profile.select("doc_id", "sha", "n_bytes"),
        counted.withColumn("n", F.col("copies")), "sha", "copies", "n", total,
    )
    # Copies need no join: they lose all or nothing.
    copies = rows.filter("copies > 1").withColumn("all", F.col("n_bytes") >= depth)
    zero = F.lit(0).cast("long")
    settled = copies.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("all"), F.col("n_bytes")).otherwise(zero).alias("n_removed"),
        F.when(F.col("all"), F.lit(1).cast("long")).otherwise(zero).alias("n_spans"),
        F.when(F.col("all"), F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(F.col("all"), F.lit(b"")).alias("kept"),
    )
    single = rows.filter("copies = 1").join(removed, "sha", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        "kept",
    )
    out = settled.unionByName(single)
    return out if texts else out.drop("kept")
