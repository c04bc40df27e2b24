import inspect
import random
from collections import Counter

import numpy as np
import xxhash

from pyspark.sql import functions as F

from tests.llm.conftest import prose
from trialweave.llm import simhash


def plain_print(text, shingle=4):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    runs = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )


def plain_components(prints, radius):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components_match_all_pairs(make_documents, odd_rows):
    rows = list(odd_rows)
    for k in range(30):  # chains of small edits
        words = prose(1000 + k // 6, 400).split()
        for j in range(k % 6):
            words[7 * j] = "changed"
        rows.append((200 + k, " ".join(words), "en", "s"))
    got = simhash.near_duplicates(make_documents(rows)).collect()
    assert len(got) == len(rows)
    prints = {r[0]: plain_print(r[1]) for r in rows if r[0] is not None}
    want = plain_components(prints, 4)
    for r in got:
        if r["doc_id"] is not None:
            assert int(r["fingerprint"], 16) == prints[r["doc_id"]]
            assert r["component_id"] == want[r["doc_id"]]
    assert len(set(want.values())) < len(want)


def test_native_hash_agrees(spark):
    text = "Uno Dos tres  cuatro\n"
    (h,) = simhash.shingle_hashes(text, 4, 42)
    native = spark.sql("select xxhash64('uno dos tres cuatro')").first()[0]
    assert int(h) == native % (1 << 64)


def test_links_reach_radius_and_full_buckets(spark, monkeypatch):
    drawn = random.Random(5)
    prints = []
    for _ in range(12):
        centre = drawn.getrandbits(64)
        for _ in range(40):
            flips = drawn.sample(range(64), drawn.randint(0, 4))
            prints.append(centre ^ sum(1 << b for b in flips))
    prints = sorted(set(prints))
    want = plain_components({p: p for p in prints}, 4)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    back = dict(zip(signed, prints, strict=True))
    nodes = spark.createDataFrame([(p, p) for p in signed], "node bigint, w0 bigint")
    for most, block in ((256, 1024), (8, 5)):
        monkeypatch.setattr(simhash, "FULL_BUCKET", most)
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = simhash.components(simhash.near_links(nodes, 4, 3)).collect()
        root = {back[r["node"]]: back[r["root"]] for r in found}
        groups = Counter(root.get(p, p) for p in prints)
        assert sorted(groups.values()) == sorted(Counter(want.values()).values())


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(100)] + [(500, 400), (500, 450)]
    got = simhash.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in got} == {
        **{k: 0 for k in range(101)}, 400: 400, 450: 400, 500: 400,
    }


def test_one_of_each_keeps_clean_documents(make_documents, odd_rows):
    rows = list(odd_rows)
    for k in range(8):
        words = prose(f"near{k}", 300).split()
        for copy in range(4):
            edited = list(words)
            for j in range(copy):
                edited[(37 * j + 11 * k) % 300] = f"edit{j}"
            rows.append((1000 + 10 * k + copy, " ".join(edited), "en", "s"))
    docs = make_documents(rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert {1000 + 10 * k + c for k in range(8) for c in range(1, 4)}.isdisjoint(ids)
    assert all(ids[1000 + 10 * k] == 1 for k in range(8))
    assert 103 in ids and 104 not in ids and ids[105] == 1 and ids[None] == 1
    assert set(range(60)) <= set(ids)
    assert len({100, 101, 102} & set(ids)) == 1  # texts without words are copies


def test_empty_table(make_documents):
    assert simhash.near_duplicates(make_documents([])).count() == 0
    assert simhash.one_of_each(make_documents([])).count() == 0


def test_large_group_is_joined_by_few_links(make_documents):
    words = prose("large group", 400).split()
    rows = []
    for k in range(150):
        edited = list(words)
        for j in range(3):
            edited[(k * 31 + j * 97) % 400] = f"edit{k}x{j}"
        rows.append((k, " ".join(edited), "en", "s"))
    names = ["w0", "w1", "w2", "w3"]
    prints = simhash.fingerprints(make_documents(rows), 5, 42, 4).withColumnRenamed("doc_id", "node")
    assert prints.dropDuplicates(names).count() == 150
    stars = simhash.star_links(prints, 40, 12, 4, ball=1, first_radius=20)
    roots = {r["node"]: r["root"] for r in simhash.drawn_together(stars).collect()}
    kept = prints.sparkSession.createDataFrame(
        [(k, roots.get(k, k)) for k in range(150)], "node bigint, root bigint"
    )
    rest = simhash.near_links(prints.join(kept, "node"), 40, 12, 4, ball=1, first_radius=14)
    assert rest.count() < 150 * 20 and 100 < stars.count() < 150 * 60
    assert simhash.one_of_each(make_documents(rows)).count() == 1


def plain_shingles(text, size=5):
    words = text.lower().split()
    return Counter(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def plain_similarity(one, two):
    return sum((one & two).values()) / sum((one | two).values())


def test_pairs_at_the_limit_are_decided_by_exact_similarity(make_documents):
    rows, want = [], set()
    similar = Counter()
    for k in range(120):  # isolated pairs of similarity 0.70 to 0.90
        words = prose(f"pair{k}", 300).split()
        edited = list(words)
        for j in range(3 + k % 9):
            edited[25 * j + 7] = f"edit{j}"
        rows += [(2 * k, " ".join(words), "en", "s"), (2 * k + 1, " ".join(edited), "en", "s")]
        near = plain_similarity(*(plain_shingles(r[1]) for r in rows[-2:]))
        similar[near >= 0.8] += 1
        want |= {2 * k} if near >= 0.8 else {2 * k, 2 * k + 1}
    assert min(similar.values()) > 30
    got = {r["doc_id"] for r in simhash.one_of_each(make_documents(rows)).collect()}
    assert not want - got  # nothing below the limit is removed
    assert len(got - want) <= 1  # 99.5 % of the pairs at the limit are found


def test_equal_fingerprints_of_other_texts_stay(make_documents):
    many = " ".join(["again"] * 60)
    rows = [(k, f"{many} {prose(f'tail{k}', 40)}", "en", "s") for k in range(3)]
    prints = simhash.fingerprints(make_documents(rows), 5, 42, 4)
    assert prints.drop("doc_id").distinct().count() == 1
    assert simhash.one_of_each(make_documents(rows)).count() == 3


def test_first_words_reject_no_pair_at_the_limit(spark):
    drawn, rows = random.Random(9), []
    for k in range(60):  # 39 bits differ, as at similarity 0.8: 12 to 20 in the first word
        whole, first = drawn.getrandbits(256), 12 + k % 9
        flips = drawn.sample(range(64), first) + drawn.sample(range(64, 240), 39 - first)
        for node, value in ((2 * k, whole), (2 * k + 1, whole ^ sum(1 << b for b in flips))):
            parts = np.array([value >> 64 * w & (1 << 64) - 1 for w in range(4)], np.uint64)
            rows.append((node, node, *parts.view(np.int64).tolist()))
    prints = spark.createDataFrame(
        rows, "node bigint, root bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint"
    )
    usual = inspect.signature(simhash.one_of_each).parameters
    radius, first = usual["radius"].default, usual["first_radius"].default
    got = simhash.near_links(prints, radius, 16, 4, ball=1, first_radius=first).collect()
    assert {(r["a"], r["b"]) for r in got} == {(2 * k, 2 * k + 1) for k in range(60)}


def test_helper_columns_of_the_caller_stay(make_documents, odd_rows):
    documents = make_documents(odd_rows).withColumn("_key", F.lit("mine")).withColumn("_KEY_", F.lit("too"))
    got = simhash.one_of_each(documents)
    assert got.columns == documents.columns
    assert {(r["_key"], r["_KEY_"]) for r in got.collect()} == {("mine", "too")}


def template_rows(count, edits):
    words = prose("template", 300).split()
    rows, drawn = [], random.Random(11)
    for k in range(count):
        edited = list(words)
        for j in drawn.sample(range(300), edits(k)):
            edited[j] = f"edit{k}x{j}"
        rows.append((k, " ".join(edited), "en", "s"))
    return rows


def test_texts_of_one_template_make_no_row_per_pair(make_documents, monkeypatch):
    rows = template_rows(200, lambda k: 6)
    shingles = [plain_shingles(r[1]) for r in rows]
    linked = sum(
        plain_similarity(a, b) >= 0.8 for k, a in enumerate(shingles) for b in shingles[k + 1 :]
    )
    assert linked < 20
    sent, similar = [], simhash._similar
    monkeypatch.setattr(
        simhash, "_similar", lambda pairs, *rest: sent.append(pairs.count()) or similar(pairs, *rest)
    )
    assert 180 <= simhash.one_of_each(make_documents(rows)).count() <= 200
    assert sum(sent) < 200 * 12  # all pairs are 19,900


def test_blocks_of_a_family_match_brute_force(make_documents, monkeypatch):
    rows = template_rows(120, lambda k: k % 9)
    shingles = {r[0]: plain_shingles(r[1]) for r in rows}
    root = {i: i for i in shingles}
    for a in shingles:
        for b in shingles:
            if a < b and root[a] != root[b] and plain_similarity(shingles[a], shingles[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    assert 10 < len(set(root.values())) < 110
    for texts, most in ((4096, 1_000_000), (25, 1_000_000), (4096, 5_000)):
        monkeypatch.setattr(simhash, "BLOCK_TEXTS", texts)
        monkeypatch.setattr(simhash, "BLOCK_SHINGLES", most)
        kept = {r["doc_id"] for r in simhash.one_of_each(make_documents(rows)).collect()}
        assert kept == set(root.values())
