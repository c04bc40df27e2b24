import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import prose
from trialweave.llm import outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, inside = Counter(runs), [False] * len(words)
    for i, run in enumerate(runs):
        if seen[run] > 1:
            inside[i : i + 8] = [True] * 8
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, again = len(words), sum(inside)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": again,
        "base_failed": n < 20 or 100 * again > 30 * n,
    }, len(re.findall("!", text)), len(re.findall("[A-Z]", text))


def vector(base, marks, upper):
    words = base["n_words"] + outliers.PRIOR_WORDS
    chars = base["word_chars"] + outliers.PRIOR_WORDS * outliers.PRIOR_CHARS
    v = [
        np.log1p(base["n_words"]), chars / words, np.sqrt(base["n_symbols"] / words),
        np.sqrt((upper + outliers.PRIOR_UPPER) / chars), np.sqrt(marks / words),
    ]
    return [min(np.floor(x * outliers.STEPS + 0.5), 20 * outliers.STEPS) for x in v]


def distances(x, share=0.75, steps=3):
    """Concentration steps in numpy, for one scope."""
    floor = np.array(outliers.FLOOR, float)
    low, mid, high = np.percentile(x, [25, 50, 75], axis=0)
    centre, cov = mid, np.diag(np.maximum((high - low) / 1.349, floor) ** 2)

    def d2(centre, cov):
        y = np.linalg.solve(np.linalg.cholesky(cov), (x - centre).T)
        return (y * y).sum(axis=0)

    rank = lambda d: np.floor(np.log1p(d) * 64 + 0.5)
    for _ in range(steps):
        r = rank(d2(centre, cov))
        held = x[r <= np.percentile(r, 100 * share)]
        centre = held.mean(axis=0)
        cov = held.T @ held / len(held) - np.outer(centre, centre) + np.diag(floor**2)
    d = d2(centre, cov)
    middle = np.exp(np.percentile(rank(d), 50) / 64) - 1
    return d * outliers.CHI_MEDIAN / max(middle, 0.5)


@pytest.fixture(scope="module")
def corpus(odd_rows):
    rows = [(k + 2000, prose(k, 25 + 5 * (k % 40)), "en", "big") for k in range(160)]
    rows += [
        (3000, " ".join(w + "$$$" for w in prose("s", 90).split()), "en", "big"),
        (3001, " ".join(w.upper() + "!!" for w in prose("u", 90).split()), "en", "big"),
        (3002, "a line of words\n\na line of words\r\n \x0b\n" * 2 + prose("l", 40), "en", "big"),
        (3003, prose("r", 40) + " " + prose("r", 40)[:60], "en", "big"),
    ]
    return rows + odd_rows


def test_base_counts_and_distances_like_numpy(make_documents, corpus):
    got = outliers.judge_quality(make_documents(corpus), least_group=100).collect()
    assert len(got) == len(corpus)
    want = [plain(r[1]) for r in corpus]
    names = list(want[0][0])
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in got) == sorted(
        (str(r[0]), *w[0].values()) for r, w in zip(corpus, want, strict=True)
    )
    # The group (en, big) is judged by its own estimate.
    ids = [r[0] for r, w in zip(corpus, want, strict=True)
           if r[3] == "big" and not w[0]["base_failed"]]
    x = np.array([vector(*w) for r, w in zip(corpus, want, strict=True)
                  if r[3] == "big" and not w[0]["base_failed"]])
    d = dict(zip(ids, distances(x), strict=True))
    by = {r["doc_id"]: r for r in got}
    for i, value in d.items():
        assert by[i]["distance"] == pytest.approx(value, rel=1e-6)
        assert by[i]["kept"] == (value <= 85)
    assert not by[3000]["kept"] and not by[3001]["kept"]
    assert sum(by[i]["kept"] for i in range(2000, 2160)) == 160


def test_reruns_agree_and_empty(make_documents, corpus):
    docs = make_documents(corpus)
    one, two = (
        sorted(map(str, outliers.judge_quality(d, least_group=100).collect()))
        for d in (docs, docs.repartition(7))
    )
    assert one == two
    assert outliers.judge_quality(make_documents([])).count() == 0


def test_a_small_source_is_judged_by_its_own_estimate(make_documents):
    rows = [(k, prose(f"calm{k}", 60 + k % 40), "en", "calm") for k in range(600)]
    rows += [  # a source that always shouts, and one calm text in it
        (1000 + k, " ".join(w.upper() + "!" for w in prose(f"loud{k}", 60 + k % 40).split()), "en", "loud")
        for k in range(60)
    ]
    rows.append((2000, prose("quiet", 80), "en", "loud"))
    by = {r["doc_id"]: r for r in outliers.judge_quality(make_documents(rows)).collect()}
    assert all(by[k]["kept"] for k in range(600))
    assert all(by[1000 + k]["kept"] for k in range(60))
    assert not by[2000]["kept"]
