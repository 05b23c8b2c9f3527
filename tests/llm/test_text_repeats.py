"""Winnowing, substring and suffix deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from text_fixtures import corpus, docs, empty, mixed, prose  # noqa: F401

from panelscore.llm import repeats, winnowing

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def earlier_windows(rows, length):
    """One result for each row, by a walk through the documents in order of id and text."""
    out, seen = [], set()
    for key in sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], (r[1] or "").encode())):
        words = SPACES.findall(key[1] or "")
        gone = [False] * len(words)
        for p in range(len(words) - length + 1):
            w = tuple(words[p : p + length])
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out += [(key[0], len(words), sum(gone), sha(kept))] * rows.count(key)
    for _, text in (r for r in rows if r[0] is None):
        words = SPACES.findall(text or "")
        out.append((None, len(words), 0, sha(" ".join(words))))
    return Counter(out)


@pytest.mark.parametrize(("operator", "length"), [(repeats.substring_repeats, 20), (repeats.suffix_repeats, 50), (repeats.substring_repeats, 7)])
def test_repeats_on_edge_cases(docs, mixed, operator, length):
    found = operator(docs, length, batch_bytes=700).select(*repeats.RESULT)
    assert Counter(map(tuple, found.collect())) == earlier_windows([(r[0], r[1]) for r in mixed], length)


@pytest.mark.parametrize(("operator", "length"), [(repeats.substring_repeats, 9), (repeats.suffix_repeats, 12)])
@pytest.mark.parametrize("bits", [1, 9])
def test_hashes_that_collide_remove_nothing(spark, mixed, operator, length, bits):
    """With a hash of one bit every window is a candidate, so the words alone decide."""
    rng = random.Random(5)
    rows = [(r[0], r[1]) for r in mixed if r[0] != 30] + [(200 + i, " ".join(rng.choice("ab") for _ in range(60 + i))) for i in range(12)]
    rows += [(300, "x " * 80), (301, "y x x " * 30), (302, prose(8, 9)), (303, "no repeat " + prose(70, 10))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = operator(frame, length, batch_bytes=900, bits=bits).select(*repeats.RESULT)
    assert Counter(map(tuple, found.collect())) == earlier_windows(rows, length)


def test_windows_of_stretches_are_told_apart_by_their_words():
    rng = np.random.default_rng(3)
    texts, about = [], []
    for n in range(60):
        left, count = int(rng.integers(0, 4)), int(rng.integers(1, 4))
        left = max(left, count - 1)
        words = [chr(97 + x) for x in rng.integers(0, 2, left + 4)] if n % 2 else ["a", "b"] * 4
        words = (words * 3)[: 4 + count - 1]
        texts.append(words)
        about.append((min(left, len(words) - 2), count, int(rng.integers(0, 9)), 100 * n))
    left, count, ids, places = np.array(about, np.int64).T
    found = repeats.later_windows("".join(w + " " for t in texts for w in t).encode(), left, count, ids, places, 4)
    windows = [(i, p, k, a - k, tuple(t[k : k + 4])) for t, (a, n, i, p) in zip(texts, about) for k in range(n)]
    first = {}
    for i, p, _, before, words in windows:
        first[before, words] = min(first.get((before, words), (i, p)), (i, p))
    assert found.tolist() == [(i, p) != first[before, words] for i, p, _, before, words in windows]


@pytest.mark.parametrize(("query", "length"), [(repeats.op5_substring_dedup, 20), (repeats.op9_suffix_array_dedup, 50)])
def test_repeats_queries(spark, corpus, query, length):
    folder, rows = corpus
    assert Counter(map(tuple, query(spark, folder).collect())) == earlier_windows(rows, length)


def test_repeats_of_nothing(empty):
    assert repeats.substring_repeats(empty).count() == 0 and repeats.suffix_repeats(empty).count() == 0


def test_spans_cover_what_is_removed(docs):
    for r in repeats.substring_repeats(docs, 20).collect():
        assert sum(r.spans[1::2]) - sum(r.spans[0::2]) == r.n_removed


def contaminated(rows, items, window=10):
    grams = {}
    for i, text in items:
        if i is None or text is None:
            continue
        words = ALNUM.findall(text.translate(LOWER))
        n = min(window, len(words))
        for p in range(len(words) - n + 1 if n else 0):
            grams.setdefault(tuple(words[p : p + n]), set()).add(str(i))
    out = []
    for doc_id, text in rows:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = [0] * len(words), set()
        for n in {len(g) for g in grams}:
            for p in range(len(words) - n + 1):
                if who := grams.get(tuple(words[p : p + n])):
                    found |= who
                    hit[p : p + n] = [1] * n
        out.append((doc_id, len(words), sum(hit), len(found), sha(",".join(sorted(found))), sum(hit) > 0))
    return Counter(out)


@pytest.fixture(scope="module")
def items(mixed):
    long = next(r[1] for r in mixed if r[0] == 20)
    return [(1, " ".join(long.upper().split()[30:60])), (2, "one TWO"), (3, None), (4, " !"), (None, long), (5, mixed[0][1][:200]), (5, "theta1"), (10, " ".join(long.split()[31:59]))]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_winnowing_on_edge_cases(spark, docs, mixed, items, block):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = winnowing.digest(winnowing.decontaminate(docs, bench, block_bytes=block))
    expected = contaminated([(r[0], r[1]) for r in mixed], items)
    assert Counter(map(tuple, found.collect())) == expected
    clean = winnowing.drop_contaminated(docs, bench, block_bytes=block)
    assert clean.columns == docs.columns
    assert clean.count() == sum(n for r, n in expected.items() if not r[5])


def test_winnowing_query(spark, corpus):
    folder, rows = corpus
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert Counter(map(tuple, winnowing.op8_decontamination(spark, folder).collect())) == contaminated(rows, bench)


def test_winnowing_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnowing.decontaminate(docs, none).where("n_hit > 0").count() == 0
    assert winnowing.decontaminate(empty, none).count() == 0
    with pytest.raises(ValueError):
        winnowing.decontaminate(docs, none, window=5, gram=5).count()


def test_repeated_items_fill_no_block(spark):
    rows = [(1, prose(20, 1))] * 60 + [(i, prose(20, i)) for i in range(2, 42)]
    bench = spark.createDataFrame(rows, "item_id long, text string").repartition(4)
    held = [index.value.ids for index in winnowing._indexes(bench, 10, 5, 8 * len(rows[0][1]))]
    assert sorted(i for ids in held for i in ids) == sorted(str(i) for i in range(1, 42))
    assert len(held) <= 8 and max(map(len, held)) <= 16


def test_one_block_of_many_is_sent_at_a_time(spark, docs, mixed, monkeypatch):
    from pyspark.core.broadcast import Broadcast

    bench = [(i, prose(20, i)) for i in range(2, 22)] + [(1, " ".join(mixed[0][1].split()[10:40]))]
    items = spark.createDataFrame(bench, "item_id long, text string")
    sent, live, most = winnowing._indexes, set(), []

    def watched(*args):
        for index in sent(*args):
            live.add(id(index))
            most.append(len(live))
            yield index

    held = Broadcast.unpersist
    monkeypatch.setattr(winnowing, "_indexes", watched)
    monkeypatch.setattr(Broadcast, "unpersist", lambda self, blocking=False: (live.discard(id(self)), held(self, blocking))[1])
    found = winnowing.digest(winnowing.decontaminate(docs, items, block_bytes=160))
    expected = contaminated([(r[0], r[1]) for r in mixed], bench)
    assert Counter(map(tuple, found.collect())) == expected
    assert len(most) >= 10 and max(most) == 1
    clean = winnowing.drop_contaminated(docs, items, block_bytes=160)
    assert max(most) == 1 and clean.count() == sum(n for r, n in expected.items() if not r[5])
