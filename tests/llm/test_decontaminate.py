from collections import Counter

from tests.llm.conftest import prose
from trialweave.llm import decontaminate


def plain(documents, items, least=0.8, n=5):
    def runs(text):
        words = (text or "").encode().lower().split()
        if not words:
            return []
        return [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]

    out = {}
    for doc, text, *_ in documents:
        held = runs(text)
        for item, body in items:
            want = Counter(runs(body))
            size = sum(want.values())
            width = min(size, len(held))
            for at in range(len(held) - width + 1 if width else 0):
                got = Counter(held[at : at + width])
                both = sum((got & want).values())
                similarity = both / (width + size - both)
                if similarity >= least and similarity > out.get((doc, item), (0, 0))[0]:
                    out[doc, item] = (similarity, at)
    return out


def test_matches_every_window_compared(make_documents, odd_rows, spark):
    items = [(k, prose(f"item{k}", 15 + 3 * k)) for k in range(12)]
    items += [(20, "one two three"), (21, ""), (22, None), (23, "again " * 12)]
    rows = list(odd_rows)
    for k, (_, body) in enumerate(items[:12]):
        words = body.split()
        words[len(words) // 2] = "other"  # one word changed
        rows.append((300 + k, prose(f"a{k}", 80) + "\n" + body.upper() + " " + prose(k, 40), "en", "s"))
        rows.append((400 + k, prose(f"b{k}", 40) + " " + " ".join(words) + " end", "en", "s"))
        rows.append((500 + k, " ".join(body.split()[:7]) + " " + prose(f"c{k}", 40), "en", "s"))
    frame = spark.createDataFrame([(*i, "clash") for i in items],
                                  "item_id bigint, text string, doc_id string")
    want = plain(rows, items)
    for passes in (20_000, 5):
        got = decontaminate.contaminations(make_documents(rows), frame, items_per_pass=passes)
        found = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"])
                 for r in got.collect()}
        assert found == want
    assert {(300 + k, k) for k in range(12)} <= set(want)
    assert not any(500 <= d < 600 for d, _ in want if d)
    docs = make_documents(rows)
    clean = decontaminate.without_contaminated(docs, frame)
    assert clean.columns == docs.columns
    bad = {d for d, _ in want}
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(
        r[0] for r in rows if r[0] not in bad
    )


def test_empty_tables(make_documents, odd_rows, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, prose(1))], "item_id bigint, text string")
    assert decontaminate.contaminations(make_documents(odd_rows), none).count() == 0
    assert decontaminate.contaminations(make_documents([]), some).count() == 0
    assert decontaminate.without_contaminated(make_documents([]), some).count() == 0
