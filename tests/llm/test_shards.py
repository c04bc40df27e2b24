import math
import random
import zlib
from collections import defaultdict

import pytest

from tests.llm.conftest import prose
from trialweave.llm import shards


def check(rows, got, count, slack):
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(count))
    for held in by.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    total = sum(r["size"] for r in got)
    for k in range(count):
        assert abs(sum(r["size"] for r in by[k]) - total / count) <= slack
    return by


def test_near_equal_bytes_and_digests(make_documents, odd_rows):
    rows = odd_rows + [(1000 + k, prose(k, 20 + k % 50), "fr", "hot") for k in range(600)]
    got = shards.shard_documents(make_documents(rows), shards=7).collect()
    largest = max(r["size"] for r in got)
    check(rows, got, 7, largest)
    want = sorted(
        (str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want


def test_leaves_are_boxes(make_documents):
    rows = [(k, "y" * (1 + (k * 37) % 400), "en", "only") for k in range(400)]
    got = shards.shard_documents(make_documents(rows), dimensions=("n_chars",), shards=4).collect()
    spans = defaultdict(list)
    for r in got:
        spans[r["shard"]].append(r["size"])
    edges = sorted((min(v), max(v)) for v in spans.values())
    assert all(a[1] <= b[0] for a, b in zip(edges, edges[1:], strict=False))


def test_target_bytes_and_small_tables(make_documents):
    rows = [(k, "z" * 84, "en", "s") for k in range(50)]
    got = shards.shard_documents(make_documents(rows), target_bytes=1000).collect()
    assert {r["shard"] for r in got} == set(range(5))
    assert shards.shard_documents(make_documents([]), shards=40).count() == 0
    alone = shards.shard_documents(make_documents([(None, None, None, None)]), shards=40).collect()
    assert [(r["size"], r["text_crc32"], r["slot"]) for r in alone] == [(16, 0, 0)]
    same = [(1, "same", "en", "s")] * 20
    check(same, shards.shard_documents(make_documents(same), shards=3).collect(), 3, 20 * 20)


def tree_by_hand(spark, rows, dimensions, count):
    """Shard of each row by sorting every node's keys."""
    table = spark.createDataFrame(
        [(r[0], zlib.crc32((r[1] or "").encode())) for r in rows], "doc_id bigint, crc bigint"
    )
    ties = [r[0] & (1 << 32) - 1 for r in table.selectExpr("xxhash64(doc_id, crc)").collect()]
    columns = []
    for d in dimensions:
        values = [{"lang": r[2], "source": r[3], "n_chars": None if r[1] is None else len(r[1])}[d]
                  for r in rows]
        if d != "n_chars":
            ranks = {v: k for k, v in enumerate(sorted({v for v in values if v is not None},
                                                       key=str.encode))}
            values = [None if v is None else ranks[v] for v in values]
        columns.append([-1.0 if v is None else float(v) for v in values])
    keys = []
    for own in columns:
        low, high = min(own), max(own)
        keys.append([
            (math.floor((v - low) / (high - low) * ((1 << 30) - 1)) << 32 if high > low else 0) + t
            for v, t in zip(own, ties, strict=True)
        ])
    sizes = [len((r[1] or "").encode()) + 16 for r in rows]
    shard = [0] * len(rows)

    def split(held, leaves, first):
        if leaves == 1 or not held:
            for k in held:
                shard[k] = first
            return
        spans = [max(ks[k] >> 32 for k in held) - min(ks[k] >> 32 for k in held) for ks in keys]
        key = keys[spans.index(max(spans))]
        half = leaves // 2
        goal = sum(sizes[k] for k in held) * half / leaves
        weight = defaultdict(int)
        for k in held:
            weight[key[k]] += sizes[k]
        before = 0
        for at in sorted(weight):
            if before + weight[at] >= int(goal):
                break
            before += weight[at]
        cut = at if goal - before < before + weight[at] - goal else at + 1
        split([k for k in held if key[k] < cut], half, first)
        split([k for k in held if key[k] >= cut], leaves - half, first + half)

    split(range(len(rows)), count, 0)
    return shard


@pytest.mark.parametrize("bins", [1 << 16, 8])
def test_all_cuts_like_sorting_in_three_dimensions(make_documents, spark, odd_rows, monkeypatch, bins):
    monkeypatch.setattr(shards, "BINS", bins)
    monkeypatch.setattr(shards, "LEAST_BINS", 4)
    drawn = random.Random(4)
    rows = [r for r in odd_rows if r[0] != 105 and r[0] is not None]
    rows += [
        (1000 + k, "w" * drawn.randrange(1, 900), drawn.choice(["en", "en", "de", None, "é"]),
         f"https://host{drawn.randrange(6)}" if k % 3 else "hot")
        for k in range(250)
    ]
    dimensions = ("lang", "source", "n_chars")
    got = shards.shard_documents(make_documents(rows), dimensions, shards=11, tolerance=0.0)
    want = tree_by_hand(spark, rows, dimensions, 11)
    assert {r["doc_id"]: r["shard"] for r in got.collect()} == {
        r[0]: s for r, s in zip(rows, want, strict=True)
    }
    assert len(set(want)) >= 10  # one long document may fill more than a shard


def test_long_text_values_are_told_apart_by_their_whole(make_documents):
    rows = [(k, "v" * 300, "en", f"https:{k % 7}") for k in range(420)]
    got = shards.shard_documents(make_documents(rows), ("source",), shards=7).collect()
    held = defaultdict(set)
    for r in got:
        held[r["shard"]].add(r["doc_id"] % 7)
    # Boxes in order of the source: near cuts of the sizes, so at most two meet in one shard.
    assert all(len(v) <= 2 for v in held.values()) and sum(map(len, held.values())) <= 13


def test_ranks_are_places_in_binary_order(make_documents):
    values = ["b", "a", "aa", None, "é", "Z", "", "zz"] + [f"n{k:03}" for k in range(300)]
    rows = [(k, "t", None, v) for k, v in enumerate(values * 2)]
    got = shards.value_ranks(make_documents(rows), "source").collect()
    want = sorted({v for v in values if v is not None}, key=str.encode)
    assert sorted((r["rank"], r["value"]) for r in got) == list(enumerate(want))
