"""Ranked lexical search against scoring every document, and in SQL."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from text_fixtures import SCHEMA, SF, corpus, docs, document, empty, mixed, prose  # noqa: F401

from panelscore.llm import lexical

ITEMS = "item_id long, text string, doc_id string"


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, items, top=50):
    held = [(d, Counter(words(t))) for d, t in rows if words(t)]
    big, total = len(held), sum(sum(h.values()) for _, h in held)
    df = Counter(t for _, h in held for t in h)
    out = Counter()
    for item, text in sorted(set(items), key=str):
        scored = []
        for d, h in held:
            m = 100 - 50 + (50 * sum(h.values()) * big) // total
            s = sum(floor(1000 * log((2 * big + 2) / (2 * df[t] + 1))) * ((10**9 * h[t]) // (1000 * h[t] + 20 * m)) for t in set(words(text)) if t in h)
            if s > 0:
                scored.append((-s, d is None, d))
        for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            out[item, k, d, -s] += 1
    return out


def test_query(spark, corpus):
    folder, rows = corpus
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = lexical.op11_ranked_lexical_search(spark, folder)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert Counter(map(tuple, got.collect())) == plain(rows, items)


@pytest.mark.parametrize("item_bytes,first", [(1 << 20, 20_000), (200, 6)])
def test_edge_cases(spark, docs, mixed, item_bytes, first):
    odd = [document(60, "ALPHA3 Émile über Ünder ÉMILE"), document(61, "alpha3 " * 40), document(62, "alpha3 " * 40), document(None, "alpha3 " * 40)]
    rows = mixed + odd
    items = [
        (1, mixed[0][1], "x"), (1, mixed[0][1], "y"), (1, "Alpha3, alpha3; ÉMILE", "x"), (2, None, "x"), (3, "", "x"), (4, "?!", "x"), (5, "nowhere", "x"),
        (6, prose(6000, 7), "x"), (None, "beta7 kappa1", "x"), (7, "one TWO changed", "x"),
    ]
    got = lexical.rank_documents(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, ITEMS), 5, item_bytes, first)
    assert Counter(map(tuple, got.collect())) == plain([(r[0], r[1]) for r in rows], [(i, t) for i, t, _ in items], 5)


def test_empty_tables(spark, docs, empty):
    items = spark.createDataFrame([(1, "alpha3", "x")], ITEMS)
    assert lexical.rank_documents(empty, items).collect() == []
    assert lexical.rank_documents(docs, items.limit(0)).collect() == []


def test_bounds_never_fall_short_and_exclude_most():
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(1, 300))).encode() for _ in range(3000)]
    big, total = len(texts), sum(len(lexical.terms(t)) for t in texts)
    df = Counter(t for x in texts for t in set(lexical.terms(x)))
    query = {t: lexical.weight(df[t], big) for t in set(lexical.terms(texts[7])) | {b"w1"}}
    searcher = lexical.Searcher([query], [0], big, total, 10)
    hashes, offsets = lexical.term_hashes(texts)
    held = [np.unique(hashes[offsets[k] : offsets[k + 1]], return_counts=True) for k in range(big)]
    sizes = np.diff(offsets)
    block = lexical.Block(held, sizes.tolist(), big, total)
    bound = block.bounds(searcher.hashes[0], searcher.weights[0])
    for k, text in enumerate(texts):
        own, norm = Counter(lexical.terms(text)), lexical.length_norm(int(sizes[k]), big, total)
        assert bound[k] >= sum(w * lexical.share(own[t], norm) for t, w in query.items() if own[t])
    searcher.show(list(range(big)), texts)
    assert searcher.bounded == big and searcher.scored < big / 5
