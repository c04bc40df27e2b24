from pyspark.sql import functions as F

from trialweave.llm import urls

RULES = (
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
)


def plain(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    hits = [
        r for r in RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    best = max(hits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://NET/", "http://net", "http://a.net/x",
    "http://example.net/en/1", "http://www.Example.NET/en", "http://notexample.net/en/",
    "http://example.com/de/?q=/en/", "http://example.com/DE/", "https://x.org/fr/a#b",
    "https://org/fr", "http://a..net/", "http://é.org/fr/É", "http://example.com:80/de/",
    "x://y://example.com/de/", "http://example.com?/de/",
]


def test_judged_like_plain_rules(spark):
    rows = [(k, u, "old") for k, u in enumerate(URLS + URLS[5:9])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, verdict string")
    got = urls.judge_urls(pages, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(r["url"]), r["url"]


def test_more_rules_than_one_filter_holds(spark, monkeypatch):
    monkeypatch.setattr(urls, "MOST_WORDS", 8)
    rules = [urls.Rule("block" if k % 3 else "allow", f"h{k}.net", "/") for k in range(300)]
    assert urls.cascade_parts(100, 0) > 1 and urls.cascade_parts(1, 10**6) > 1
    rows = [(k, f"http://a.h{k}.net/x", "mine", "too") for k in range(600)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, _keys string, _best string")
    got = urls.judge_urls(pages, rules, default="open").collect()
    for r in got:
        k = r["page_id"]
        want = ("block" if k % 3 else "allow") if k < 300 else "open"
        assert (r["verdict"], r["rule"]) == (want, f"h{k}.net/" if k < 300 else None)
        assert (r["_keys"], r["_best"]) == ("mine", "too")
    assert len(got) == 600


def test_empty_table_and_no_rules(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert urls.judge_urls(pages, RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert urls.judge_urls(one, ()).first()["verdict"] == "allow"


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("pmod(xxhash64(key), 23) = 3").unionByName(
        spark.range(1).select(F.lit("elsewhere").alias("key"))
    )
    levels = urls.build_cascade(listed, universe, first_bits=4.0, next_bits=2.0)
    assert len(levels) > 2
    found = universe.filter(urls.in_cascade(F.col("key"), levels))
    assert found.exceptAll(listed).count() == 0
    assert found.count() == listed.count() - 1
