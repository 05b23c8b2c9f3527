"""Periodic runs against trying every period at every place."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from text_fixtures import SCHEMA, corpus, docs, document, empty, mixed, prose  # noqa: F401

from panelscore.llm import periodic


def plain_runs(words, periods=4, least=6):
    """For each period, ascending, all stretches of equal words; a stretch is the run of its first period."""
    n, seen = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, periods * q):
                seen.setdefault((start, i - start + q), q)
    return sorted((s, m, q) for (s, m), q in seen.items())


def plain_words(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def plain_row(doc_id, text):
    words = plain_words(doc_id, text)
    found = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
    best = min(((-n, s, q) for s, n, q in found), default=None)
    longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *longest, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(kept)))


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_short_alphabets(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(120):
        words = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(3)):
            block = [rng.randrange(3) for _ in range(rng.randrange(1, 25))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (block * 9)[: rng.randrange(9 * len(block))]
        texts.append(np.array(words, np.int64))
    assert periodic.runs(texts) == [plain_runs(t.tolist()) for t in texts]
    assert periodic.runs(texts, 2, 2) == [plain_runs(t.tolist(), 2, 2) for t in texts]


def test_slices_of_the_grid(monkeypatch):
    monkeypatch.setattr(periodic, "PLACES", 50)
    rng = random.Random(9)
    texts = [np.array([rng.randrange(2) for _ in range(n)], np.int64) for n in (0, 5, 6, 300, 1, 77)]
    assert periodic.runs(texts) == [plain_runs(t.tolist()) for t in texts]


@pytest.mark.parametrize("period", [4, 16, 64])
def test_extensions_are_exact(period):
    rng = random.Random(period)
    words = np.array([rng.randrange(2) for _ in range(400)] * 3 + [7], np.uint32)
    extend = periodic.Extensions(words, period)
    pairs = [sorted(rng.sample(range(len(words)), 2)) for _ in range(3000)] + [[k, k + 400] for k in range(0, 800, 7)]
    i, j = np.array(pairs).T
    got = extend(i, j)
    for a, b, n in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
        assert (words[a : a + n] == words[b : b + n]).all() and words[a + n] != words[b + n]


def test_one_very_long_text():
    rng = random.Random(3)
    block = [rng.randrange(1000) for _ in range(6000)]
    words = [rng.randrange(1000) for _ in range(50_000)] + block * 5 + [5] * 70_000 + [rng.randrange(1000) for _ in range(999)]
    found = periodic.runs([np.array(words, np.int64)])[0]
    assert (50_000, 30_000, 6000) in [(s, min(n, 30_000), q) for s, n, q in found]
    assert any(q == 1 and n >= 70_000 for _, n, q in found)


def test_query(spark, corpus):
    folder, rows = corpus
    got = periodic.op12_periodic_runs(spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_row(d, t) for d, t in rows)


def test_edge_cases(spark, docs, mixed, empty):
    odd = [
        document(None, "x " * 6), document(40, "a\tb " * 4), document(40, "a\tb " * 4), document(41, "é é\né é é é"), document(42, "a b a b a b a"),
        document(43, "w " * 5), document(44, " ".join(["k l m"] * 5000)), document(50, "a b c d e f g"),
    ]
    rows = mixed + odd
    found = periodic.find_runs(spark.createDataFrame(rows, SCHEMA), periodic.repeat_tail).collect()
    wanted = []
    for r in rows:
        words = plain_words(r[0], r[1])
        runs = plain_runs(words)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        wanted.append((r[0], len(words), tuple(runs), " ".join(kept)))
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in found) == Counter(wanted)
    assert periodic.find_runs(empty).collect() == []
    plain = {r.doc_id: r for r in periodic.find_runs(spark.createDataFrame(odd, SCHEMA)).collect()}
    assert plain[44].collapsed == "k l m" and plain[43].runs == [] and plain[41].collapsed == "é"
