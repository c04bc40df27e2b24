from collections import Counter

import pytest

from trialweave.llm import spelling
from trialweave.llm.queries import QUERIES


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(counts, ratio=2):
    links = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, own in links.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    rows = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        rows.add((w, f, root, counts[w], len(links[w]), counts.get(f)))
    return rows


def groups(spark, counts, **kw):
    words = spark.createDataFrame(
        [(w, n, "x", "x") for w, n in counts.items()], "word string, n bigint, key string, near string"
    )
    got = spelling.variant_groups(words, **kw).collect()
    return [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got]


def test_every_edit_like_all_pairs(spark):
    import random

    drawn = random.Random(5)
    counts = {}
    for _ in range(400):
        word = "".join(drawn.choice("abé") for _ in range(drawn.randint(1, 6)))
        counts[word] = drawn.choice([1, 2, 3, 4, 8, 16, 40])
    counts |= {"aaaa": 5, "aaa": 10, "aa": 20, "a": 40, "": 80, "naïve": 3, "naive": 9}
    got = groups(spark, counts)
    assert len(got) == len(counts)
    assert set(got) == expected(counts)
    assert set(groups(spark, counts, ratio=4)) == expected(counts, 4)


def test_long_chains_reach_their_root(spark):
    counts = {"a" * k: 1 << k for k in range(1, 30)}
    got = groups(spark, counts)
    assert set(got) == expected(counts)
    assert {r[2] for r in got} == {"a" * 29}


def test_ties_take_the_smaller_word(spark):
    counts = {"kitten": 2, "kitteb": 9, "kittea": 9}
    assert set(groups(spark, counts)) == expected(counts)


def test_null_words_and_empty_tables(spark):
    words = spark.createDataFrame([(None, 3)], "word string, n bigint")
    assert spelling.variant_groups(words).count() == 0
    with pytest.raises(ValueError):
        spelling.variant_groups(words, ratio=1)


def test_runs_are_maximal_and_lowered_in_ascii_only(make_documents, odd_rows):
    import re

    rows = [*odd_rows, (1, "ÉtaT ÉTAT x_abcde-fghij1klmno", "fr", "s")]
    got = spelling.text_runs(make_documents(rows), r"A-Za-zÀ-ÿ", 5).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = Counter(
        (r[0], run.translate(lower))
        for r in rows
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or "")
        if len(run) >= 5
    )
    assert Counter(map(tuple, got)) == want


def test_query_with_planted_deletions(spark, tmp_path):
    import re
    import zlib

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    base = ["Gretel", "gretel", "gretal", "Hänsel", "hansel", "häusel", "oven", "bread", "breads"]
    rows = [
        (k, " ".join(base[(k * j) % 9] for j in range(1, 40)) + "İstanbul", None, "s", 1)
        for k in range(120)
    ]
    rows += [(None, "gretel " * 300, "de", None, 3), (5, None, None, None, None), (6, "", "", "", 0)]
    spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = QUERIES["op13_spelling_variants"](spark, str(tmp_path)).collect()
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} \
        == expected(counts)
    assert len(got) == len(counts) > 8
