import pytest

from trialweave.session import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


DOCUMENTS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, "
    "kept string, shard string, fingerprint string, score string, taken string, node string, "
    "copies string, anchors string, rank string"
)


@pytest.fixture(scope="session")
def make_documents(spark):
    """Documents from (doc_id, text, lang, source), with extra columns of clashing names."""

    def make(rows):
        full = [
            (*r, None if r[1] is None else len(r[1]), *["x"] * 10) for r in rows
        ]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


def prose(seed, words=60):
    """Words drawn by a small generator; equal seeds, equal text."""
    import random

    drawn = random.Random(seed)
    made = []
    for k in range(words):
        word = "".join(drawn.choice("abcdefghij") for _ in range(drawn.randint(2, 7)))
        made.append(word.capitalize() if k % 9 == 0 else word)
        if k % 9 == 8:
            made[-1] += "."
    return " ".join(made)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = prose("long", 6000)
    rows = [(k, prose(k, 30 + 7 * (k % 11)), "en" if k % 3 else "de", f"s{k % 4}") for k in range(60)]
    rows += [
        (100, None, "en", "s0"),
        (101, "", "en", "s1"),
        (102, " \t\n ", None, None),
        (103, long, "en", "s2"),
        (104, long, "en", "s2"),
        (105, "one two three", "de", "s3"),
        (105, "one two three", "de", "s3"),
        (None, prose("nobody"), "en", "s0"),
        (106, "ÄÖ \u00a0 ß\u2003x é 你好", "de", "s1"),
        (107, prose(3, 51), "en", None),
        (108, " ".join(["again"] * 40), "en", "s0"),
    ]
    return rows
