"""Near duplicates by SimHash, multi-index hashing and connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import free_name, join_frequent
from trialweave.session import materialise

#: Rows of an index bucket above which it is compared in blocks instead of joined.
FULL_BUCKET = 256
BLOCK = 1024
#: Texts and shingles of a block in which the links of a family are verified.
BLOCK_TEXTS = 4096
BLOCK_SHINGLES = 1_000_000


def shingle_hashes(text: str | None, size: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, A-Z lower-cased, joined by single spaces.

    Fewer words: the whole sequence.  None: no hash.
    """
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and spaces only
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(words) - size + 1].tolist()
    return np.array(
        [digest(joined[a:b], seed) for a, b in zip(begins, ends[size - 1 :].tolist(), strict=True)],
        np.uint64,
    )


def majority_bits(hashes: np.ndarray, words: int = 1) -> list[int]:
    """The fingerprint, as unsigned words of 64 bits: a bit is 1 if set in over half the hashes.

    Words after the first take their bits from hashes derived of the given ones.
    """
    out = []
    for k in range(words):
        mixed = hashes if k == 0 else _derived(hashes, k)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(mixed), 60_000):  # sums fit 16 bits
            bits = np.unpackbits(
                mixed[at : at + 60_000].astype("<u8").view(np.uint8).reshape(-1, 8),
                axis=1,
                bitorder="little",
            )
            ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
        out.append(int(np.packbits(2 * ones > len(mixed), bitorder="little").view("<u8")[0]))
    return out


def _derived(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other 64 bits per hash, by the splitmix rule."""
    z = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(
    documents: DataFrame, shingle: int = 4, seed: int = 42, words: int = 1
) -> DataFrame:
    """doc_id and the fingerprint of the whole text, in signed 64-bit words w0, w1, ..."""
    names = [f"w{k}" for k in range(words)]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = np.array(
                [
                    majority_bits(shingle_hashes(t.as_py(), shingle, seed), words)
                    for t in batch.column(1)
                ],
                np.uint64,
            ).reshape(-1, words)
            columns = [pa.array(c, pa.int64()) for c in found.view(np.int64).T.copy()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], names=["doc_id", *names]
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        batches, ", ".join([f"doc_id {kind}", *[f"{n} bigint" for n in names]])
    )


def counted(hashes: np.ndarray) -> np.ndarray:
    """Distinct sorted values that stand for the hashes with their counts.

    The k-th occurrence of a hash is shifted by k steps, so set operations on these values
    are operations on the hashes with counts.
    """
    held = np.sort(hashes)
    place = np.arange(len(held))
    new = np.append(True, held[1:] != held[:-1])[: len(held)]
    again = place - np.maximum.accumulate(np.where(new, place, 0))
    return np.sort(held + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _text_nodes(documents: DataFrame, shingle: int, seed: int, words: int) -> DataFrame:
    """doc_id, _key, node and fingerprint of every text; node is a digest of its shingles."""
    names = [f"w{k}" for k in range(words)]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), shingle, seed)
                node = xxhash.xxh64_intdigest(counted(hashes).tobytes(), seed)
                found.append([node, *majority_bits(hashes, words)])
            table = np.array(found, np.uint64).reshape(-1, words + 1)
            columns = [pa.array(c, pa.int64()) for c in table.view(np.int64).T.copy()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns],
                names=["doc_id", "_key", "node", *names],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "_key", "text").mapInArrow(
        batches,
        ", ".join([f"doc_id {kind}", *[f"{n} bigint" for n in ["_key", "node", *names]]]),
    )


def _shingle_sets(
    documents: DataFrame, prints: DataFrame, nodes: DataFrame, shingle: int, seed: int
) -> DataFrame:
    """(node, shingles) of the given nodes: the counted hashes of one text of each."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [
                    counted(shingle_hashes(t.as_py(), shingle, seed)) for t in batch.column(1)
                ]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)],
                    names=["node", "shingles"],
                )

    named = prints.join(nodes, "node", "left_semi").select("node", "first.doc_id", "first._key")
    texts = documents.select("doc_id", "_key", "text").join(named, ["doc_id", "_key"])
    sets = texts.select("node", "text").mapInArrow(batches, "node bigint, shingles array<bigint>")
    return sets.groupBy("node").agg(F.first("shingles").alias("shingles"))


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingles, with counts, have that similarity or more."""
    for side in "ba":
        own = sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}"))
        pairs = pairs.join(own, side)
    n, m = F.size("sa"), F.size("sb")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.filter(
        (F.least(n, m) * 100 >= F.greatest(n, m) * percent)
        & (both * (100 + percent) >= (n + m) * percent)
    ).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _segments(words: int, count: int) -> list[tuple[int, int, int]]:
    """(word, shift, width): near equal segments, none across two words."""
    each = [count // words + (k < count % words) for k in range(words)]
    out = []
    for word, n in enumerate(each):
        edges = [round(64 * k / n) for k in range(n + 1)]
        out += [(word, low, high - low) for low, high in zip(edges, edges[1:], strict=False)]
    return out


def _balls(radius: int, segments: int) -> list[int]:
    """Ball radius to enumerate in each segment so that no pair within radius is missed.

    If every segment differed by more than its ball, the distances would add up to over
    ``radius``: the first r mod m + 1 segments take r // m, the others one less.
    """
    return [
        radius // segments if k <= radius % segments else radius // segments - 1
        for k in range(segments)
    ]


def _probes(own: Column, width: int, ball: int) -> list[Column]:
    """Buckets that a segment value looks up.

    One differing bit is set on one side only, so it is enough that this side looks up the
    value without it.  Larger balls are enumerated in full.
    """
    if ball < 0:
        return []
    if ball == 1:
        cleared = [
            F.when(F.getbit(own, F.lit(b)) == 1, own - F.lit(1 << b)) for b in range(width)
        ]
        return [own, *cleared]
    masks = [
        sum(1 << b for b in places)
        for d in range(ball + 1)
        for places in combinations(range(width), d)
    ]
    return [own.bitwiseXOR(F.lit(m).cast("long")) if m else own for m in masks]


def _index_rows(
    prints: DataFrame,
    words: int,
    cut: Sequence[tuple],
    balls: Sequence[int],
    probes: bool,
    carried: Sequence[str] = ("node", "w0"),
) -> DataFrame:
    """Rows (bucket, carried columns): the table, or the probes of every ball.

    The segment's number is in the bucket's upper bits.
    """
    rows = []
    for k, ((word, shift, width), ball) in enumerate(zip(cut, balls, strict=True)):
        mask = F.lit((1 << width) - 1).cast("long")
        own = F.shiftrightunsigned(F.col(f"w{word}"), shift).bitwiseAND(mask)
        values = _probes(own, width, ball) if probes else [own]
        rows += [v + F.lit(k << 40) for v in values]
    found = F.filter(F.array(*rows), lambda b: b.isNotNull())
    return prints.select(F.explode(found).alias("bucket"), *carried)


def _distance(left: str, right: str, words: int) -> Column:
    total = F.lit(0)
    for k in range(words):
        total = total + F.bit_count(F.col(f"{left}w{k}").bitwiseXOR(F.col(f"{right}w{k}")))
    return total


def _near_first(left: str, right: str, words: int, radius: int, first_radius: int | None) -> Column:
    """The first two words differ by ``first_radius`` bits each, or fewer, together."""
    if first_radius is None or words == 1:
        return _distance(left, right, 1) <= (radius if first_radius is None else first_radius)
    return _distance(left, right, 2) <= 2 * first_radius


def _within(pairs: DataFrame, prints: DataFrame, radius: int, words: int) -> DataFrame:
    """The distinct pairs (a, b) whose whole fingerprints differ by ``radius`` bits or fewer."""
    for side in "ab":
        own = prints.select(
            F.col("node").alias(side), *[F.col(f"w{k}").alias(f"{side}w{k}") for k in range(words)]
        )
        pairs = pairs.join(own, side)
    return pairs.filter(_distance("a", "b", words) <= radius).select("a", "b")


def star_links(
    prints: DataFrame, radius: int, segments: int, words: int, ball: int, first_radius: int
) -> DataFrame:
    """The candidates of ``star_candidates`` whose whole fingerprints are within ``radius``."""
    found = star_candidates(prints, radius, segments, words, ball, first_radius)
    return _within(found, prints, radius, words)


def star_candidates(
    prints: DataFrame,
    radius: int,
    segments: int,
    words: int,
    ball: int,
    first_radius: int,
    most: int | None = None,
) -> DataFrame:
    """Pairs of each node and the smallest node filed in a bucket it looks up.

    At most one pair per probe, however many near copies meet in a bucket, and only where
    the first two words differ by ``first_radius`` bits each or fewer, together: enough to
    draw most of a large group together before its remaining links are sought.  ``most``
    keeps the pairs with that many smallest nodes.
    """
    cut, balls = _segments(words, segments), [ball] * segments
    first = [f"w{k}" for k in range(min(words, 2))]
    filed = _index_rows(prints, words, cut, balls, probes=False, carried=["node", *first])
    looked = _index_rows(prints, words, cut, balls, probes=True, carried=["node", *first])
    heads = (
        filed.groupBy("bucket")
        .agg(F.min(F.struct("node", *first)).alias("h"))
        .select(
            "bucket", F.col("h.node").alias("head"), *[F.col(f"h.{w}").alias(f"head_{w}") for w in first]
        )
    )
    close = _near_first("", "head_", words, radius, first_radius)
    pairs = looked.join(heads, "bucket").filter(close & (F.col("head") != F.col("node")))
    if most is not None:
        kept = F.slice(F.sort_array(F.collect_set("head")), 1, most)
        pairs = pairs.groupBy("node").agg(F.explode(kept).alias("head"))
    return pairs.select(
        F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")
    ).distinct()


def drawn_together(stars: DataFrame) -> DataFrame:
    """(node, root): the smallest node reached by up to four links to smaller nodes.

    A cheap part of ``components``: nodes with one root are surely in one component.
    """
    step = stars.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    for _ in range(2):
        onward = step.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        step = step.join(onward, "root", "left").select(
            "node", F.coalesce("_next", "root").alias("root")
        )
    return step


def near_links(
    prints: DataFrame,
    radius: int = 4,
    segments: int = 3,
    words: int = 1,
    ball: int | None = None,
    first_radius: int | None = None,
) -> DataFrame:
    """Links (a, b), a < b, that join the nodes of fingerprints within ``radius`` bits.

    ``prints`` has node and the words w0, w1, ... of distinct fingerprints.  Multi-index
    hashing: every fingerprint is filed by each of its segments, and looks up the small
    Hamming balls around its own segments; a hit is kept after the distance of all bits.
    ``segments`` trades probes for bucket size and never changes which nodes are joined:
    three segments of one word suit up to about 10^8 fingerprints, two (562 probes, 32 bits)
    more.  By default the balls are those that guarantee the radius.  ``ball`` sets one
    radius for all segments instead; pairs within segments * (ball + 1) - 1 bits are then
    sure to be found and farther ones with high probability.  With several words the
    first two may differ by ``first_radius`` bits each, together, before the others are
    fetched.  If ``prints`` has a column root, nodes with one root are joined already and no link between them is made.

    A bucket of more than ``FULL_BUCKET`` fingerprints holds many near copies of each other;
    its pairs are not emitted one by one.  Its members are cut into blocks, each pair of
    blocks is compared in one bounded task, and that task emits a spanning forest.  Links
    in small buckets are all emitted; in full ones connectivity is kept.  With roots, the
    links are candidates that are verified later, so all of them are emitted from full
    buckets too, except between nodes of one root.
    """
    cut = _segments(words, segments)
    balls = _balls(radius, segments) if ball is None else [ball] * segments
    if any(width > 40 for _, _, width in cut):
        raise ValueError("a segment has at most 40 bits: take more segments")
    first = [f"w{k}" for k in range(min(words, 2))]
    carried = [c for c in ("node", *first, "root") if c in prints.columns]
    filed = _index_rows(prints, words, cut, balls, probes=False, carried=carried)
    looked = _index_rows(prints, words, cut, balls, probes=True, carried=carried)
    full = materialise(
        filed.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("held"))
        .filter(F.col("held") > FULL_BUCKET),
        "full-buckets",
    )
    a, b = F.col("p.node"), F.col("t.node")
    close = _near_first("p.", "t.", words, radius, first_radius)
    if "root" in carried:
        close = close & (F.col("p.root") != F.col("t.root"))
    small = (
        looked.join(full, "bucket", "left_anti").alias("p")
        .join(filed.alias("t"), (F.col("p.bucket") == F.col("t.bucket")) & close & (a != b))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
    )
    if words > 1:
        small = _within(small, prints, radius, words)
    return small.unionByName(_full_links(looked, full, prints, radius, words)).distinct()


def _verified_links(
    members: DataFrame, sets: DataFrame, radius: int, words: int, percent: int
) -> DataFrame:
    """Spanning links (a, b) of the families, each verified by the shingles.

    ``members`` has node, family, root (nodes of one root are joined already) and words;
    those without shingles in ``sets`` are left out.

    A family is cut into blocks of bounded numbers of texts and shingles.  Each pair of
    blocks is compared in one task, which decides a link where it finds one and sends only
    links between nodes not joined yet: fewer rows than texts, however many pairs are near.
    """
    names = [f"w{k}" for k in range(words)]
    held = members.join(sets, "node")
    count = F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum(F.size("shingles")) / BLOCK_SHINGLES)
    ).cast("long")
    cut = (
        held.groupBy("family")
        .agg(count.alias("blocks"), F.min("root").alias("x"), F.max("root").alias("y"))
        .filter("x <> y")
        .select("family", "blocks")
    )
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    others = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, mine).alias("low"), F.greatest(o, mine).alias("high")),
    )
    units = (
        held.join(cut, "family")
        .withColumn("mine", mine)
        .select("family", F.explode(others).alias("u"), "mine", "node", "root", *names, "shingles")
        .select("family", "u.low", "u.high", "mine", "node", "root", *names, "shingles")
    )

    def forest(rows):
        import pandas as pd

        rows = rows.sort_values(["mine", "node"])
        nodes, block = rows["node"].to_numpy(), rows["mine"].to_numpy()
        bits = rows[names].to_numpy(np.int64).view(np.uint64)
        sizes = rows["shingles"].map(len).to_numpy()
        flat = np.unique(np.concatenate(rows["shingles"].to_list()), return_inverse=True)[1]
        starts = np.cumsum(sizes) - sizes
        group = np.unique(rows["root"].to_numpy(), return_inverse=True)[1]
        own, out = np.zeros(len(flat), bool), []
        split = np.searchsorted(block, block[-1])  # 0 if the block is compared with itself
        for k in range(split or len(nodes) - 1):
            after = split or k + 1
            near = np.bitwise_count(bits[after:] ^ bits[k]).sum(axis=1) <= radius
            near = after + np.flatnonzero(near & (group[after:] != group[k]))
            fewer, more = np.minimum(sizes[near], sizes[k]), np.maximum(sizes[near], sizes[k])
            near = near[fewer * 100 >= more * percent]
            if not len(near):
                continue
            many = sizes[near]
            ends = np.cumsum(many)
            places = np.arange(ends[-1]) + np.repeat(starts[near] - ends + many, many)
            mine = flat[starts[k] : starts[k] + sizes[k]]
            own[mine] = True
            both = np.diff(np.cumsum(own[flat[places]])[ends - 1], prepend=0)
            own[mine] = False
            for x in near[both * (100 + percent) >= (many + sizes[k]) * percent]:
                if group[x] != group[k]:
                    out.append(sorted((nodes[k], nodes[x])))
                    group[group == group[x]] = group[k]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return units.groupBy("family", "low", "high").applyInPandas(forest, "a bigint, b bigint").distinct()


def _full_links(
    looked: DataFrame, full: DataFrame, prints: DataFrame, radius: int, words: int
) -> DataFrame:
    """Spanning links of full buckets, by pairs of blocks of their members."""
    blocks = F.ceil(F.col("held") / BLOCK).cast("long")
    members = looked.join(full, "bucket").withColumn("blocks", blocks)
    rooted = "root" in prints.columns
    if rooted:  # nothing is sought where all members are joined already
        apart = members.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"))
        members = members.join(apart.filter("x <> y"), "bucket", "left_semi")
    members = members.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    others = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda o: F.struct(
            F.least(o, F.col("mine")).alias("low"), F.greatest(o, F.col("mine")).alias("high")
        ),
    )
    names = [f"w{k}" for k in range(words)] + ["root"] * rooted
    units = (
        members.select("bucket", "node", F.explode(others).alias("u"))
        .select("bucket", "u.low", "u.high", "node")
        .join(prints.select("node", *names), "node")
    )

    def forest(rows):
        import pandas as pd

        rows = rows.drop_duplicates("node").sort_values("node")
        nodes, left = rows["node"].to_numpy(), np.arange(len(rows))
        bits = rows[names[:words]].to_numpy(np.int64).view(np.uint64)
        out = []
        if rooted:
            roots = rows["root"].to_numpy()
            for k in range(len(nodes) - 1):
                near = np.bitwise_count(bits[k + 1 :] ^ bits[k]).sum(axis=1) <= radius
                near &= roots[k + 1 :] != roots[k]
                out += [(nodes[k], x) for x in nodes[k + 1 :][near]]
            return pd.DataFrame(out, columns=["a", "b"]).astype("int64")
        while len(left):  # breadth first over what is not reached yet
            front, left = left[:1], left[1:]
            while len(front) and len(left):
                one, front = front[0], front[1:]
                near = np.bitwise_count(bits[left] ^ bits[one]).sum(axis=1) <= radius
                out += [sorted((nodes[one], nodes[x])) for x in left[near]]
                front, left = np.concatenate([front, left[near]]), left[~near]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return units.groupBy("bucket", "low", "high").applyInPandas(forest, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links: root is the smallest node it can reach.

    Alternating large-star and small-star steps; each is a grouped minimum (combined before
    the shuffle) and one join, and each result is written to the shared folder.  The steps
    end when a round changes no link.
    """
    edges = materialise(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v")
        .distinct(),
        "links",
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).filter("u <> v").distinct()
        large = materialise(large, "large-star")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lower.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        edges = materialise(small, "small-star")
        now = tuple(
            edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        )
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(
    documents: DataFrame,
    shingle: int = 4,
    radius: int = 4,
    segments: int = 3,
    seed: int = 42,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Needs doc_id and text; other columns are ignored.  Equal fingerprints are one node, so
    exact copies, empty and null texts (fingerprint zero) cost one row however many they
    are.  component_id is the smallest doc_id reachable by links of ``radius`` bits or
    fewer.  Rows that repeat a doc_id are each returned; a null doc_id is never smallest,
    so a component of nulls alone has a null id.  An empty table gives no rows.
    """
    held = materialise(
        fingerprints(documents, shingle, seed).withColumnRenamed("w0", "fingerprint"),
        "fingerprints",
    )
    total = held.count()
    prints = materialise(
        held.groupBy("fingerprint").agg(
            F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
        ),
        "prints",
    )
    nodes = prints.select(F.col("fingerprint").alias("node"), F.col("fingerprint").alias("w0"))
    linked = components(near_links(nodes, radius, segments))
    rooted = prints.join(
        linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).withColumn("root", F.coalesce("root", "fingerprint"))
    roots = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    table = materialise(
        rooted.join(roots, "root").select("fingerprint", "component_id", "copies"), "components"
    )
    named = join_frequent(held, table, "fingerprint", "component_id", "copies", total)
    return named.withColumn(
        "fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    )


def one_of_each(
    documents: DataFrame,
    shingle: int = 5,
    words: int = 4,
    radius: int = 60,
    first_radius: int = 20,
    segments: int = 16,
    seed: int = 42,
    percent: int = 80,
) -> DataFrame:
    """One document of each group of near copies, with all its columns.

    Two texts are near copies if their ``shingle``-word shingles, with counts, have a
    similarity (shared over all) of ``percent`` or more; groups are the components of these
    links, and the document with the smallest doc_id stays.  Fingerprints of 64 * ``words``
    bits only find candidates: each link is verified by the shingles themselves (as 64-bit
    hashes).  At similarity 0.8 about 15 % of the bits differ, 39 of 256 with a standard
    deviation of 6, so ``radius`` holds more than 99.9 % of those pairs; sixteen segments of
    16 bits with balls of one bit meet 99.5 % of them, taking bits as independent.  Buckets
    hold a 65,536th of the distinct texts.

    Each text first meets a few candidates, at most one per probe.  The components of these
    candidates are families; a family is compared in bounded blocks, which send verified
    links alone, since its members may nearly all be too far apart to be linked.  Other
    candidates are sought between families only.  Both look at pairs whose first two words
    differ by 2 * ``first_radius`` of 128 bits or fewer; at similarity 0.8 that is five standard deviations above the mean of 19.4, so practically none is lost.

    Rows that repeat a doc_id and equal texts leave one row; rows with a null doc_id stay.
    Null and empty texts are copies of each other.  An empty table gives no rows.
    """
    names = [f"w{k}" for k in range(words)]
    whole = documents.filter("doc_id is not null")
    known = whole.select("doc_id", F.xxhash64("text").alias("_key"), "text")
    held = materialise(_text_nodes(known, shingle, seed, words), "fingerprints")
    # One node per list of shingles; its first document stands for it.
    prints = materialise(
        held.groupBy("node", *names).agg(F.min(F.struct("doc_id", "_key")).alias("first")),
        "prints",
    )
    nodes = prints.select("node", *names)
    met = materialise(
        star_candidates(nodes, radius, segments, words, ball=1, first_radius=first_radius, most=8),
        "met",
    )
    sets = materialise(_shingle_sets(known, prints, _ends(met), shingle, seed), "sets")
    heads = materialise(_within(met, nodes, radius, words), "heads")
    stars = materialise(_similar(heads, sets, percent), "stars")
    families = components(met).withColumnRenamed("root", "family")
    apart = materialise(
        nodes.join(drawn_together(stars), "node", "left")
        .join(families, "node", "left")
        .withColumns({c: F.coalesce(c, "node") for c in ("root", "family")}),
        "apart",
    )
    between = apart.select("node", F.col("family").alias("root"), *names)
    rest = near_links(between, radius, segments, words, ball=1, first_radius=first_radius)
    rest = materialise(rest.join(heads, ["a", "b"], "left_anti"), "rest")
    new = _ends(rest).join(sets, "node", "left_anti")
    more = materialise(_shingle_sets(known, prints, new, shingle, seed), "sets")
    inside = _verified_links(apart, sets, radius, words, percent)
    across = _similar(rest, sets.unionByName(more), percent)
    linked = components(stars.unionByName(inside).unionByName(across))
    stay = (
        prints.join(linked, "node", "left")
        .groupBy(F.coalesce("root", "node").alias("root"))
        .agg(F.min("first").alias("first"))
        .select("first.doc_id", "first._key")
    )
    key = free_name(documents, "_key")
    one = (
        whole.withColumn(key, F.xxhash64("text"))
        .join(stay.withColumnRenamed("_key", key), ["doc_id", key], "left_semi")
        .dropDuplicates(["doc_id", key])
        .select(*documents.columns)
    )
    return one.unionByName(documents.filter("doc_id is null"))
