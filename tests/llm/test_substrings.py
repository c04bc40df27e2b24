import hashlib

import numpy as np
import pytest

from tests.llm.conftest import prose
from trialweave.llm import substrings


def plain(texts, depth):
    bodies = [(t or "").encode() for t in texts]
    seen = {}
    for k, b in enumerate(bodies):
        for s in range(len(b) - depth + 1):
            seen.setdefault(b[s : s + depth], []).append((k, s))
    covered = [np.zeros(len(b) + 1, bool) for b in bodies]
    for places in seen.values():
        if len(places) > 1:
            for k, s in places:
                covered[k][s : s + depth] = True
    out = []
    for b, c in zip(bodies, covered, strict=True):
        runs = int((np.diff(np.r_[0, c.astype(int)]) == 1).sum())
        kept = bytes(x for x, gone in zip(b, c, strict=False) if not gone)
        out.append((len(b), int(c.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("contexts", [500, 2])
def test_removes_what_a_plain_scan_removes(make_documents, odd_rows, monkeypatch, contexts):
    monkeypatch.setattr(substrings, "SHARD_CONTEXTS", contexts)
    monkeypatch.setattr(substrings, "SHARD_COPIES", 2 * contexts)
    shared, umlauts = prose("shared", 90), "äöü " * 60
    rows = list(odd_rows)
    for k in range(12):
        rows.append((200 + k, f"{prose(f'x{k}', 20 + k)} {shared} {prose(f'y{k}', 30)}", "en", "s"))
    rows += [
        (300, "a" * 1500, "en", "s"),
        (301, "a" * 129, "en", "s"),
        (302, "ab" * 300 + umlauts, "en", "s"),
        (303, umlauts, "en", "s"),
        (304, prose("twice", 50) + " " + prose("twice", 50), "en", "s"),
        (305, prose("twice", 40), "en", "s"),
    ]
    got = substrings.remove_repeats(make_documents(rows), depth=128).collect()
    want = plain([r[1] for r in rows], 128)
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in got) == sorted(
        (str(r[0]), *w) for r, w in zip(rows, want, strict=True)
    )
    assert sum(w[1] for w in want) > 10_000


def test_long_text_in_steps(make_documents):
    body = prose("very long", 220_000)
    assert len(body) > 1 << substrings.PACK_BITS
    rows = [(1, body, "en", "s"), (2, "x" * 50 + body[1_048_000:1_049_500], "en", "s")]
    got = {r["doc_id"]: r for r in substrings.remove_repeats(make_documents(rows)).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"]) == (1500, 1)
    assert got[2]["n_removed"] == 1500


def test_suffix_ranks_and_prefixes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    rank = substrings.suffix_ranks(data, 24)
    body = data.tobytes()
    keys = [body[i : i + 24].ljust(24, b"\0") for i in range(len(body))]
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    place = {}
    for at, i in enumerate(order):
        place.setdefault(keys[i], at)
    full = range(len(body) - 24)
    assert [rank[i] for i in full] == [place[keys[i]] for i in full]


def test_empty_table(make_documents):
    assert substrings.remove_repeats(make_documents([])).count() == 0
