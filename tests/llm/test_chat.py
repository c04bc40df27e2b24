import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialweave.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string"


def read(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    made = chat.format_chats(df)
    return made, made.select(
        "conv_id",
        "formatted",
        "loss_spans",
        chat.turns_of(F.col("formatted")).alias("turns"),
        chat.trained_texts(F.col("formatted"), F.col("loss_spans")).alias("texts"),
    ).collect()


def test_same_role_turns_share_a_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b<x\\l"), (1, 2, "assistant", None)]
    _, (got,) = read(spark, rows)
    assert got["formatted"] == (
        "<turn>user<body>a</turn>\n<turn>assistant<body>b\\lx\\bl<and></turn>\n"
    )
    assert [tuple(t) for t in got["turns"]] == [
        ("user", "a"), ("assistant", "b<x\\l"), ("assistant", ""),
    ]
    assert got["texts"] == ["b<x\\l", ""]


def test_nulls_ties_repeats_and_empty(spark):
    rows = [
        (None, 1, "user", "n"),
        (2, None, "user", "first"),
        (2, 1, "user", "b"),
        (2, 1, "user", "a"),
        (2, 1, "user", "a"),
        (2, 2, None, "x"),
    ]
    _, got = read(spark, rows)
    by = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in got}
    assert by[None] == [("user", "n")]
    assert by[2] == [("user", t) for t in ("first", "a", "a", "b")] + [("", "x")]
    assert read(spark, [])[1] == []


text = st.text(st.sampled_from(list("<>/\\abln\n turndybo é你😀")), max_size=30)
turns = st.lists(st.tuples(st.sampled_from(["user", "assistant", "</turn>", "\\"]), text), max_size=6)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(turns.filter(bool), min_size=1, max_size=20))
def test_round_trip(spark, conversations):
    rows = [
        (c, t, role, body)
        for c, held in enumerate(conversations)
        for t, (role, body) in enumerate(held)
    ]
    _, got = read(spark, rows)
    for r in got:
        want = conversations[r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == want
        assert r["texts"] == [b for role, b in want if role == "assistant"]
        assert sum(s["length"] for s in r["loss_spans"]) <= len(r["formatted"])


def test_digest_of_probe(spark):
    said = r"\### Assistant: </turn> ok"
    _, (got,) = read(spark, [(-7, 0, "user", said), (-7, 1, "assistant", said)])
    digest = hashlib.sha256("".join(got["texts"]).encode()).hexdigest()
    assert digest == hashlib.sha256(said.encode()).hexdigest()
