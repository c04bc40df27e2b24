import re
from collections import defaultdict

from pyspark.sql import functions as F

from trialweave.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(sizes, weights=(5, 2, 1), budget=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_ = budget * sum(sizes.values()), set(names)
    target = {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_follows_targets(make_documents, odd_rows):
    docs = make_documents(odd_rows)
    rows = mixing.mix(docs, blocks=8, slots=16).collect()
    assert len(rows) == len(odd_rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, _, source in odd_rows:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        largest[source] = max(largest[source], n)
    want = expected_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    slack = max(largest.values())
    for source, target in want.items():
        assert abs(taken[source] - target) <= 2 * slack
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = mixing.mix(docs, blocks=64, slots=4096).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_order_of_copies_is_by_finish(make_documents, odd_rows):
    copies = [c for c in mixing.mix_copies(make_documents(odd_rows)).collect() if c["finish"]]
    copies.sort(key=lambda c: (c["finish"], c["rank"], c["ordinal"], c["copy"]))
    at = 0
    for c in copies:
        assert c["start_word"] == at
        at += c["size"]


def test_mixed_documents_repeat_and_keep_columns(make_documents, odd_rows):
    docs = make_documents(odd_rows)
    held = mixing.mixed_documents(docs, budget=1.9)
    assert held.columns == docs.columns
    counts = defaultdict(int)
    for r in held.collect():
        counts[r["doc_id"]] += 1
    assert None in counts and 100 not in counts and 101 not in counts
    assert max(v for k, v in counts.items() if k != 105) == 2


def test_empty_table_and_no_words(make_documents, spark):
    assert mixing.mix(make_documents([])).count() == 0
    rows = mixing.mix(make_documents([(1, None, "en", None), (2, "", "en", "s")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2


def test_helper_columns_of_the_caller_stay(make_documents, odd_rows):
    documents = make_documents(odd_rows).withColumns(
        {c: F.lit(c) for c in ("_id", "_copies", "_copy")}
    )
    got = mixing.mixed_documents(documents, weights=(5, 2, 1), budget=1.5, most=2)
    assert got.columns == documents.columns and got.count() > 40
    assert {(r["_id"], r["_copies"], r["_copy"]) for r in got.collect()} == {("_id", "_copies", "_copy")}
