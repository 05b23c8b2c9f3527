"""Circulant MinHash near-duplicates against comparing all pairs."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from text_fixtures import SCHEMA, corpus, docs, document, empty, mixed, prose  # noqa: F401

from panelscore.llm import circulant


def shingles(text, n=5):
    words = [w for w in "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "").split()]
    k = min(n, len(words))
    return frozenset(tuple(words[p : p + k]) for p in range(len(words) - k + 1)) if k else frozenset()


def plain(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in combinations(range(len(rows)), 2):
        x, y = sets[i], sets[j]
        if x and 100 * len(x & y) >= percent * len(x | y):
            root[find(i)] = find(j)
    out = Counter()
    for k, (d, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None), default=None)
        out[d, len(sets[k]), least, d == least] += 1
    return out


def changed(base, rng, times):
    words = base.split()
    for at in rng.sample(range(len(words)), times):
        words[at] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def test_query(spark, corpus):
    folder, rows = corpus
    assert Counter(map(tuple, circulant.op13_minhash_near_dedup(spark, folder).collect())) == plain(rows)


def test_edge_cases(spark, mixed, empty):
    odd = [document(50, "Five WORDS are IN it"), document(51, "five words are in IT"), document(52, "five words are in"), document(None, "lonely words"), document(None, "lonely words")]
    rows = mixed + odd
    got = circulant.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert Counter(map(tuple, got.collect())) == plain([(r[0], r[1]) for r in rows])
    assert circulant.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("side", [256, 7])
def test_groups_whose_first_text_links_few(spark, monkeypatch, side):
    """Copies of copies: links run along chains and over a hub, most pairs of a bucket are just below the threshold."""
    monkeypatch.setattr(circulant, "SIDE", side)
    rng = random.Random(side)
    rows, base = [], prose(100, 11)
    rows += [(1000 + k, changed(base, rng, 2)) for k in range(40)]
    rows.append((999, base))
    rows += [(2000 + k, changed(prose(100, 12), rng, 2)) for k in range(40)]
    chain = prose(150, 13)
    for k in range(30):
        rows.append((3000 - k, chain := changed(chain, rng, 1)))
    rows += [(4000 + k, prose(60, 14) + " " + prose(40, 500 + k)) for k in range(60)]
    rng.shuffle(rows)
    got = circulant.near_duplicates(spark.createDataFrame([document(*r) for r in rows], SCHEMA))
    assert Counter(map(tuple, got.collect())) == plain(rows)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.85):
        x = rng.integers(0, 2**63, 1000).astype(np.uint64)
        y = x.copy()
        y[: int(1000 * (1 - share) / (1 + share))] = rng.integers(0, 2**63, int(1000 * (1 - share) / (1 + share))).astype(np.uint64)
        same = (circulant.signature(np.sort(x)) == circulant.signature(np.sort(y))).mean()
        assert abs(same - share) < 0.12


def test_second_permutation_is_shifted_circularly():
    x = np.arange(1000, dtype=np.uint32) * np.uint32(4294967)
    assert len(np.unique(circulant._permute(x.copy(), 0x21F0AAAD, 0xD35A2D97))) == 1000
    grams = np.array([12345 << 32], np.uint64)
    place = circulant._permute(np.array([12345], np.uint32), 0x7FEB352D, 0x846CA68B)
    wanted = [int(circulant._permute(place + np.uint32(k * 0x9E3779B9 % 2**32), 0x21F0AAAD, 0xD35A2D97)[0]) for k in range(160)]
    assert circulant.signature(grams).tolist() == wanted
