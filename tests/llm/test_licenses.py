import math
import random

import pytest
from pyspark.sql import functions as F

from trialweave.llm import licenses
from trialweave.llm.licenses import NOTICES, PHRASES, Template, scan_licenses, split


def expected(text, templates):
    """Every place of every template by comparing all words at all places."""
    words = split(text or "")
    found = []
    for t in templates:
        own = split(t.text)
        must = set()
        for phrase in t.phrases:
            part = split(phrase)
            at = next(k for k in range(len(own)) if own[k : k + len(part)] == part)
            must |= set(range(at, at + len(part)))
        for start in range(1 - len(own), len(words)):
            right = {
                k for k in range(len(own))
                if 0 <= start + k < len(words) and words[start + k] == own[k]
            }
            if len(right) >= max(1, math.ceil(t.least * len(own) - 1e-9)) and must <= right:
                found.append((t.label, t.base, start, len(own), len(right) / len(own)))
    return len(words), sorted(found, key=lambda f: (f[2], f[0]))


def scan(documents, templates, **kw):
    got = scan_licenses(documents, templates, **kw).collect()
    return [(r["doc_id"], r["n_words"], [tuple(f) for f in r["found"]]) for r in got]


@pytest.fixture(scope="module")
def texts():
    drawn = random.Random(2)
    made = []
    every = PHRASES + NOTICES
    for k in range(150):
        own = split(drawn.choice(every).text)
        for _ in range(drawn.choice([0, 0, 1, 3, 8])):
            at = drawn.randrange(len(own))
            own[at] = drawn.choice(["license", "the", "apache", "cc", "by", "zzz", "É"])
        if k % 5 == 0:
            own = own[drawn.randrange(len(own)) :]
        filler = [drawn.choice("the mit gnu license CC by general of 2 0".split()) for _ in range(9)]
        made.append(drawn.choice(["// ", "* ", ""]) + " ".join(filler) + ".\n" + ", ".join(own) + "!")
    made += ["MIT License mit\nLICENSE", "cc by cc by", "ccby", "cé by", "gnu general public",
             "", None, " ", "Mozilla " * 3000 + "mit license", "mitlicense" * 500]
    return made


def test_like_all_places(make_documents, texts):
    templates = PHRASES + NOTICES
    rows = [(k, t, None, None) for k, t in enumerate(texts)]
    got = scan(make_documents(rows), templates)
    assert len(got) == len(rows)
    for doc, n_words, found in got:
        assert (n_words, found) == expected(texts[doc], templates), texts[doc]
    assert sum(len(f) for *_, f in got) > 100


@pytest.mark.parametrize("votes", [1, 3, 50])
def test_votes_lose_nothing(make_documents, votes):
    templates = (Template("a", "one two three four five six", ("two three",), least=0.5),
                 Template("b", "one", least=1.0), Template("c", "two two two", least=0.6))
    texts = ["one two three x five y", "two two x two two", "x two three four five six",
             "one two three four", "one x three four five six"]
    got = scan(make_documents([(k, t, None, None) for k, t in enumerate(texts)]), templates,
               votes=votes)
    for doc, n_words, found in got:
        assert (n_words, found) == expected(texts[doc], templates)


def test_odd_rows_and_frequencies(make_documents, odd_rows):
    documents = make_documents(odd_rows)
    names = ["again", "one", "three", "nowhere", "äö"]
    counted = licenses.document_frequencies(documents, names)
    lowered = [set(split(r[1] or "")) for r in odd_rows]
    assert counted == {w: sum(w in own for own in lowered) for w in names}
    got = scan(documents, PHRASES)
    assert sorted((str(d), n) for d, n, _ in got) == sorted(
        (str(r[0]), len(split(r[1] or ""))) for r in odd_rows
    )


def test_other_keys_and_empty_tables(make_documents, spark):
    assert scan(make_documents([]), PHRASES) == []
    files = spark.createDataFrame([("a/LICENSE", "the mit license", 1)], "path string, text string, found int")
    assert scan_licenses(files, PHRASES, key="path").select(
        "path", F.col("found")[0]["label"].alias("label")
    ).first() == ("a/LICENSE", "mit")


def test_templates_must_hold_their_phrases():
    with pytest.raises(ValueError):
        licenses.compile_templates([Template("x", "some words", ("other",))])
    with pytest.raises(ValueError):
        licenses.compile_templates([Template("x", " . ")])
