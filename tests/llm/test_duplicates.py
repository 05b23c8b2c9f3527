"""Line deduplication and the n-gram Jaccard join against plain versions."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F
from text_fixtures import SCHEMA, corpus, docs, document, empty, mixed, prose  # noqa: F401

from panelscore.llm import graph, line_dedup, near_join


def grams(text, n=5):
    words = (text or "").split()
    k = min(n, len(words))
    return {tuple(words[p : p + k]) for p in range(len(words) - k + 1)} if k else set()


def joined(rows, threshold=0.8, first=False):
    """With ``first`` the smallest id of each group; else doc_id, smallest id of the text, smallest id of the component, number of links, for each row."""
    texts = sorted({r[1] or "" for r in rows})
    copies = Counter(r[1] or "" for r in rows)
    sets = {t: grams(t) for t in texts}
    root, links = {t: t for t in texts}, Counter()

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in combinations(texts, 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
            links[a] += copies[b]
            links[b] += copies[a]
            root[find(b)] = find(a)
    least = lambda keep: min((r[0] for r in rows if r[0] is not None and keep(r[1] or "")), default=None)
    classes = {t: least(lambda x, t=t: x == t) for t in texts}
    groups = {t: least(lambda x, t=t: find(x) == find(t)) for t in texts}
    if first:
        return sorted(groups[t] for t in {find(t) for t in texts})
    return Counter((r[0], classes[r[1] or ""], groups[r[1] or ""], copies[r[1] or ""] - 1 + links[r[1] or ""]) for r in rows)


def test_join_on_edge_cases(docs, mixed):
    for block in (256, 3):  # three documents to a block: the copies are spread over many tiles
        found = near_join.linked_documents(docs, block=block).collect()
        assert Counter(map(tuple, found)) == joined([(r[0], r[1]) for r in mixed])


def test_join_query(spark, corpus):
    folder, rows = corpus
    assert Counter(map(tuple, near_join.op3_ngram_jaccard_join(spark, folder).collect())) == joined(rows)


@pytest.mark.parametrize("sent", [near_join.SENT_KEYS, 0])
def test_one_of_each_group_stays(docs, mixed, monkeypatch, sent):
    monkeypatch.setattr(near_join, "SENT_KEYS", sent)
    kept = near_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == joined([(r[0], r[1]) for r in mixed], first=True)


@pytest.mark.parametrize("limits", [{"BLOCK_WORDS": 500}, {"BLOCK": 8, "SPREAD": 4, "LARGE": 20}, {"BLOCK": 8, "SPREAD": 3, "LARGE": 9}])
def test_tasks_of_a_large_group_stay_small(spark, monkeypatch, limits):
    """One group of near copies in many blocks: what a task holds is a tile, not the whole group."""
    for name, value in limits.items():
        monkeypatch.setattr(near_join, name, value, raising=False)
    base = prose(60, 900).split()
    rows = []
    for i in range(70):
        words = [*base, prose(3, 901 + i)]
        words[i % 60] = words[i % 60] if i % 2 else "other"
        rows.append((i, " ".join(words)))
    held, run = [], GroupedData.applyInArrow

    def spy(self, *args):
        sizes = self._df.withColumn("n", F.size(F.split("text", " "))).groupBy("cell").agg(F.sum("n").alias("n"), F.count_distinct("cluster", "i", "j").alias("tiles"))
        held.extend(sizes.collect())
        return run(self, *args)

    monkeypatch.setattr(GroupedData, "applyInArrow", spy)
    options = {"block": limits["BLOCK"]} if "BLOCK" in limits else {}
    found = near_join.linked_documents(spark.createDataFrame([document(i, t) for i, t in rows], SCHEMA), **options)
    assert Counter(map(tuple, found.collect())) == joined(rows)
    assert len(held) > 1 and max(r.tiles for r in held) == 1
    assert "BLOCK_WORDS" not in limits or max(r.n for r in held) < 4 * limits["BLOCK_WORDS"] < 70 * 63 / 2


def test_join_of_nothing(empty):
    assert near_join.linked_documents(empty).count() == 0 and near_join.keep_first(empty).count() == 0


def test_pruning_bound():
    assert near_join.fewest_matches(16, 0.8, 1e-9) < near_join.fewest_matches(128, 0.8, 1e-9) < 0.8 * 128
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**62, 400).astype(np.uint64))
    b = np.concatenate((a[:360], a[:40] + np.uint64(1)))
    equal = (near_join.signature(np.unique(a)) == near_join.signature(np.unique(b))).mean()
    assert abs(equal - 360 / 440) < 0.12


def test_both_ways_to_count_agree():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[: 300 - i], rng.integers(0, 2**62, i).astype(np.uint64)))) for i in range(0, 40)]
    exact = {(i, j) for i, j in combinations(range(40), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    sigs, every = np.stack([near_join.signature(s) for s in sets]), np.arange(40)
    i, j = near_join.similar_pairs(sigs, sets, every, every, True, 0.8, 1e-9)
    assert set(zip(i.tolist(), j.tolist())) == exact


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (100, 101)]
    table = spark.createDataFrame(links, "a long, b long")
    for split in (graph.SPLIT_LINKS, 10):
        found = {r.node: r.label for r in graph.components(table, split_links=split).collect()}
        assert found == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 140), 100)}
    assert graph.components(table.where("false")).count() == 0


def test_patience():
    a, b = list("abcdefg"), list("xbcyefgz")
    assert [(a[i], b[j]) for i, j in line_dedup.patience(a, b)] == [(x, x) for x in "bcefg"]
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        found = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


def plain_line_dedup(rows, rare=line_dedup.RARE, least=line_dedup.BLOCK_CHARS):
    """doc_id and kept text of each row: every pair that shares a first holder, aligned one after the other."""
    known = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0],))
    lines = {r: (r[1] or "").split("\n") for r in known}
    holders = {}
    for r in known:
        for x in dict.fromkeys(lines[r]):
            if x.strip(" "):
                holders.setdefault(x, []).append(r)
    shared = {}
    for found in holders.values():
        for r in found[1:]:
            shared.setdefault((r, found[0]), []).append(len(found))
    gone = {r: set() for r in known}
    for (later, first), n in shared.items():
        if min(n) <= rare or len(n) > 1:
            codes = {}
            a, b = ([codes.setdefault(x if x.strip(" ") else "", len(codes)) for x in lines[r]] for r in (later, first))
            gone[later].update(line_dedup.common_lines(a, b, [len(x.strip(" ")) for x in lines[later]], least))
    return {r: [x for k, x in enumerate(lines[r]) if k not in gone[r]] for r in known}


def lined(spark):
    rng = random.Random(5)
    pool = [prose(9, i) for i in range(60)]
    rows = []
    for i in range(40):
        text = [pool[rng.randrange(60)] for _ in range(4)]
        if i % 3:
            k = rng.randrange(50)
            text[1:1] = ["the very same heading of all documents here", *pool[k : k + 6], ""]
        rows.append((i, "\n".join(text)))
    rows += [(50, rows[1][1]), (51, rows[1][1]), (51, rows[1][1]), (52, ""), (53, None), (54, "\n\n"), (None, rows[1][1]), (None, None)]
    return rows, spark.createDataFrame([document(i, t) for i, t in rows], SCHEMA)


def test_line_dedup(spark):
    rows, docs = lined(spark)
    plain = plain_line_dedup([r for r in rows])
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    expected = Counter()
    for r in rows:
        if r[0] is None or plain[r] == (r[1] or "").split("\n"):
            expected[r] += 1
        elif "".join(plain[r]).strip():
            expected[r[0], "\n".join(plain[r])] += 1
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == expected
    assert 51 not in {r.doc_id for r in kept.collect()}
    counted = line_dedup.count_repeated_lines(docs)
    assert counted.count() == len(rows) and counted.where("n_removed > 0").count() > 20


def test_line_dedup_query(spark, corpus):
    folder, rows = corpus
    plain = plain_line_dedup(rows)
    found = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.op2_line_dedup(spark, folder).collect()}
    assert found == {r[0]: (len(r[1].split("\n")), len(r[1].split("\n")) - len(x)) for r, x in plain.items()}


def test_one_common_line_leaves_every_later_document(spark):
    passage = "one passage of more than forty characters on a line"
    rows = [(i, f"{prose(9, 700 + i)}\n{passage}\n{prose(9, 800 + i)}") for i in range(30)]
    rows += [(40, f"{passage}\n{prose(9, 740)}\n{passage}\n{prose(9, 741)}")]  # twice, so never unique in a diff
    rows += [(50 + i, prose(9, 99)) for i in range(12)]  # one-line documents
    rows += [(70, f"{prose(9, 99)}\n{prose(9, 750)}\n{passage}"), (71, f"{passage}\n{prose(9, 751)}\n{prose(9, 99)}")]
    kept = line_dedup.drop_repeated_lines(spark.createDataFrame([document(i, t) for i, t in rows], SCHEMA))
    expected = {i: t if i in (0, 50) else "\n".join(x for x in t.split("\n") if x not in (passage, prose(9, 99))) for i, t in rows}
    assert {r.doc_id: r.text for r in kept.collect()} == {i: t for i, t in expected.items() if t}


def test_a_block_of_short_lines_meets_a_document_that_has_it_whole(spark):
    a, b, x = "a line of 15 ch", "another line 15", "third line (15)"
    # Each line, and each pair of neighbours, is first held by a document without the block.
    texts = {1: f"{a}\n{b}", 2: f"{b}\n{x}", 4: f"{a}\n{b}\n{x}\n{prose(9, 1)}", 5: f"{prose(9, 2)}\n{a}\n{b}\n{x}", 6: f"{a}\n\n{x}"}
    kept = line_dedup.drop_repeated_lines(spark.createDataFrame([document(i, t) for i, t in texts.items()], SCHEMA))
    assert {r.doc_id: r.text for r in kept.collect()} == {**texts, 5: prose(9, 2)}


def test_block_keys():
    rng = np.random.default_rng(7)
    for _ in range(50):
        hashes = rng.integers(0, 5, 12)
        chars = np.where(hashes == 0, 0, hashes * 7)
        runs = set()
        for i in np.flatnonzero(hashes):
            run = next((tuple(hashes[i:k].tolist()) for k in range(i + 1, 13) if chars[i:k].sum() >= 20), ())
            runs |= {run} if len(run) > 1 else set()
        assert len(line_dedup.block_keys(hashes, chars, 20)) == len(runs) + len(set(hashes.tolist()) - {0})


def test_line_dedup_of_nothing(empty):
    assert line_dedup.drop_repeated_lines(empty).count() == 0 and line_dedup.count_repeated_lines(empty).count() == 0


def test_n_chars_follows_the_text(spark):
    passage = "\n".join(prose(12, k) for k in range(4))
    rows = [document(1, passage), document(2, "own words of this one\n" + passage), document(3, None), document(4, "short")]
    found = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[2].text == "own words of this one"
    assert {d: r.n_chars for d, r in found.items()} == {1: len(passage), 2: 21, 3: None, 4: 5}
