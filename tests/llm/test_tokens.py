import base64
import os
from collections import Counter, defaultdict

import pytest
import tiktoken

from trialweave.llm import tokens

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


def test_every_limit_like_plain_counts(make_documents, odd_rows):
    ranks = {
        base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))
    }
    encoder = tiktoken.Encoding(
        "test", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    rows = [*odd_rows, (900, "<|endoftext|>", "en", "s0")]
    lengths = defaultdict(list)
    for _, text, lang, source in rows:
        n = len(encoder.encode_ordinary(text or ""))
        for group in (("all", None), ("lang", lang), ("source", source)):
            lengths[group].append(n)
    counted = tokens.encoded_lengths(make_documents(rows), VOCABULARY, keep=("lang", "source"))
    histogram = tokens.length_histogram(counted, by=("lang", "source"))
    table = tokens.context_table(histogram, block=16)
    seen = Counter()
    for r in table.collect():
        own, limit = lengths[r["scope"], r["value"]], r["n_tokens"]
        seen[r["scope"], r["value"]] += r["n_docs"]
        assert r["n_docs"] == own.count(limit)
        assert r["docs_longer"] == sum(n > limit for n in own)
        assert r["tokens_longer"] == sum(n for n in own if n > limit)
        assert (r["total_docs"], r["total_tokens"]) == (len(own), sum(own))
        assert r["truncated_tokens"] == sum(min(n, limit) for n in own)
        assert r["share_within"] == sum(n <= limit for n in own) / len(own)
    assert seen == Counter({g: len(own) for g, own in lengths.items()})
    for r in tokens.truncated_totals(histogram, [0, 7, 100, 10**6]).collect():
        own = lengths[r["scope"], r["value"]]
        assert r["tokens"] == sum(min(n, r["limit"]) for n in own)
    for r in tokens.length_quantiles(table, [0.5, 1.0]).collect():
        own = sorted(lengths[r["scope"], r["value"]])
        place = -(-int(r["share"] * 2) * len(own) // 2) - 1
        assert r["n_tokens"] == own[place]


def test_empty_table(make_documents):
    counted = tokens.encoded_lengths(make_documents([]), VOCABULARY)
    assert tokens.context_table(tokens.length_histogram(counted)).count() == 0
