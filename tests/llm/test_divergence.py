import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from trialweave.llm import divergence
from trialweave.llm.words import LETTERS, LETTERS_DIGITS, words_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def expected(rows, least=3, most=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        own = Counter(terms(text))
        counts[lang, source] += own
        docs[lang] += Counter(own.keys())
    out = set()
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def share(n, size):
            return 1 + 10**9 * (n + 1) // (size + v)

        def size_of(c):
            return sum(c[t] for t in kept)

        whole = sum((counts[g] for g in groups if g[0] == lang), Counter())
        mine, lang_size = counts[lang, source], size_of(whole)
        p = {t: share(mine[t], size_of(mine)) for t in kept}
        pairs = []
        for other in (s for g, s in groups if g == lang and s != source):
            theirs = counts[lang, other]
            q = {t: share(theirs[t], size_of(theirs)) for t in kept}
            pairs.append((sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other))
        q = {t: share(whole[t], lang_size) for t in kept}
        more = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if mine[t] and p[t] > q[t]]
        for part, found, limit in (("pair", pairs, None), ("term", more, most)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {
                (lang, source, part, item, value, k + 1)
                for k, (value, item) in enumerate(found[:limit])
            }
    return out


def audit(documents, **kw):
    got = divergence.audit_sources(documents, **kw)
    return [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank"))
            for r in got.collect()]


def test_like_plain_python(make_documents, odd_rows):
    rows = [*odd_rows, *[(500 + k, "hot word " * 50 + f"w{k % 3} Ünder", "en", "s0")
                         for k in range(40)],
            (600, "", "xx", "lonely"), (601, "once", "yy", "a"), (602, "", "yy", "b")]
    got = audit(make_documents(rows))
    assert len(got) == len(set(got)) and set(got) == expected(rows)
    few = audit(make_documents(rows), least_documents=1, most_terms=5)
    assert set(few) == expected(rows, 1, 5)


def test_slices_and_merged_sums_change_nothing(make_documents, odd_rows, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 500)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[k] or "" for r in odd_rows]) for k in (1, 2, 3)], names=["t", "l", "s"]
    )
    parts = [batch.slice(k, 7) for k in range(0, batch.num_rows, 7)]
    counts, docs = Counter(), Counter()
    for out in divergence._sorted_slices(iter(parts)):
        for lang, source, term, n, d in zip(*[c.to_pylist() for c in out.columns], strict=True):
            counts[lang, source, term] += n
            docs[lang, source, term] += d
    want, want_docs = Counter(), Counter()
    for _, text, lang, source in odd_rows:
        own = Counter(terms(text))
        want += Counter({(lang or "", source or "", t): n for t, n in own.items()})
        want_docs += Counter((lang or "", source or "", t) for t in own)
    assert counts == want and docs == want_docs


def test_pointers_are_sorted_and_runs_are_equal_words():
    texts = ["b aé abcdefgh abcdefghi abcdefgh", None, "", "abcdefghabcdefgh abcdefghabcdefgi a"]
    words = words_of(pa.array(texts), LETTERS)
    order, begins = divergence.sort_pointers(words, np.zeros(len(words.starts), int))
    found = words.text(order).to_pylist()
    assert found == sorted(found, key=str.encode)
    assert [found[b] for b in begins] == sorted(set(found), key=str.encode)
    assert words.rows.tolist() == [0] * 5 + [3] * 3


def test_sums_merge(monkeypatch):
    sums = divergence._Sums(most=4)
    total = Counter()
    got = Counter()
    for k in range(20):
        left, right = np.array([k % 3, 1, 1]), np.array([2, k % 2, k % 2])
        value = np.array([1, k, -5])
        sums.add("en", left, right, value)
        for a, b, v in zip(left.tolist(), right.tolist(), value.tolist(), strict=True):
            total[a, b] += v
        if sums.full():
            for out in sums.batches():
                for _, a, b, v in zip(*[c.to_pylist() for c in out.columns], strict=True):
                    got[a, b] += v
    for out in sums.batches():
        for _, a, b, v in zip(*[c.to_pylist() for c in out.columns], strict=True):
            got[a, b] += v
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in total.items() if v}


def test_wide_terms_are_compared_in_blocks(make_documents, monkeypatch):
    rows = [(k, "common " * (k % 5 + 1) + f"own{k % 9}", "en", f"s{k:03}") for k in range(60)]
    rows += [(100 + k, "common rare", "en", f"s{k:03}") for k in range(60)]
    monkeypatch.setattr(divergence, "PAIRS", 64)
    lists = [[(k + 1, 1000 + 7 * k, 500 + k) for k in range(30)]] * 3
    kind = pa.list_(pa.struct([("index", pa.int32()), ("p", pa.int64()), ("bare", pa.int64())]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en"] * 3),
         pa.array([[dict(zip(("index", "p", "bare"), c, strict=True)) for c in x] for x in lists],
                  kind)],
        names=["lang", "uses"],
    )
    got = {(a, b): v for out in divergence._meetings(iter([batch]))
           for _, a, b, v in zip(*[c.to_pylist() for c in out.columns], strict=True)}
    f = lambda p, q: (p - q) ** 2 // q
    for i, p, p0 in lists[0]:
        for j, q, q0 in lists[0]:
            assert got[i, j] == 3 * (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))
    assert set(audit(make_documents(rows))) == expected(rows)


def test_empty_table(make_documents):
    assert audit(make_documents([])) == []


@pytest.mark.parametrize("letters", [LETTERS, LETTERS_DIGITS])
def test_words_of_sliced_columns(letters):
    column = pa.array(["skip", "Ab1 cß", None, "", "z9", "x"]).slice(1, 4)
    digits = "0-9" if letters is LETTERS_DIGITS else ""
    words = words_of(column, letters)
    want = [
        (k, w) for k, t in enumerate(column.to_pylist())
        for w in re.findall(f"[a-z{digits}\u0080-\U0010ffff]+", (t or "").translate(LOWER))
    ]
    every = np.arange(len(words.starts))
    assert list(zip(words.rows.tolist(), words.text(every).to_pylist(), strict=True)) == want
