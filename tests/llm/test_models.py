"""Language, toxicity, packing, search, url filter, and the pipeline."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from text_fixtures import SCHEMA, corpus, docs, document, empty, mixed  # noqa: F401

import __spark_entry__ as entry
from panelscore.llm import common, knn, language, packing, toxicity, url_filter


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(4)
    parts = {"aa": "tion the ing re ble ness".split(), "bb": "schaft ung keit ver zu ich".split(), "cc": "eau oir que éé ment ç".split()}
    rows = []
    for i in range(300):
        lang = sorted(parts)[i % 3]
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(6, 80))]
        rows.append(document(i, " ".join(words), lang))
    return spark.createDataFrame(rows, SCHEMA), {r[0]: r[2] for r in rows}


def test_language_accuracy_on_the_held_out_fold(tongues):
    docs, truth = tongues
    model = language.train(docs, common.crc_fold() != 1)
    found = language.identify(docs.where(common.crc_fold() == 1), model).collect()
    assert len(found) > 50 and np.mean([r.lang_pred == truth[r.doc_id] for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    assert language.keep_identified(docs, model).columns == docs.columns


def test_language_edge_cases(docs, mixed, empty, tongues):
    model = language.train(tongues[0])
    found = language.identify(docs, model).collect()
    assert len(found) == len(mixed)
    by_id = {r.doc_id: r for r in found}
    for i in (3, 4, 6, 31):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert language.identify(empty, model).count() == 0
    nothing = language.train(empty)
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_crc_fold_is_that_of_the_id_as_text(spark):
    ids = [0, 1, 17, 123456789, -5]
    found = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(common.crc_fold().alias("f")).collect()
    assert [r.f for r in found] == [zlib.crc32(str(i).encode()) % 3 for i in ids]


@pytest.fixture(scope="module")
def comments(spark):
    rng = random.Random(9)
    clean = ["".join(rng.choice("ka lo mi ru ten sol var".split()) for _ in range(3)) for _ in range(300)]
    rows, labels = [], []
    for i in range(700):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 60))]
        if i % 4 == 0:
            for word in rng.sample(["idiot", "moron", "scumbag", "idiots"], 3):
                words.insert(rng.randrange(len(words)), word)
        rows.append(document(i, " ".join(words)))
        labels.append((i, int(i % 4 == 0), 1))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), dict((x[0], x[1]) for x in labels)


def test_toxicity_on_the_held_out_fold(comments, spark):
    docs, labels, truth = comments
    model = toxicity.train(docs, labels.where(common.crc_fold() != 1))
    found = toxicity.score(docs.where(common.crc_fold() == 1), model).collect()
    assert [r for r in found if (r.score >= toxicity.TOXIC) != (truth[r.doc_id] == 1)] == []
    hidden = ["m0r0n idi0t", "i.d.i.o.t and moooron", "m o r o n or 1d1ot", "MORON!!! \"idiot\""]
    plain = ["kalomi 2024 x2", "", None, "a b c d e", "lo.mi.ru"]
    table = spark.createDataFrame([document(i, t) for i, t in enumerate(hidden + plain)], SCHEMA)
    scores = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert min(scores[i] for i in range(4)) > 0.5 and max(scores[i] for i in range(4, 9)) < 0.3


def test_toxicity_edge_cases(docs, mixed, empty, comments, spark):
    model = toxicity.train(comments[0], comments[1])
    assert toxicity.score(docs, model).count() == len(mixed) and toxicity.score(empty, model).count() == 0
    none = spark.createDataFrame([(None, 1, 1), (1, None, 1)], "doc_id long, toxic int, quality int")
    assert toxicity.score(docs, toxicity.train(docs, none)).count() == len(mixed)


def test_restored_words():
    text = "moron stupid idiot loser trash clown pathetic words of a language " * 20
    counts = np.bincount(toxicity.trigrams(text), minlength=27**3).astype(float)
    word = toxicity.Restorer(toxicity.Letters(counts)).word
    pairs = {"m0r0n": "moron", "l0$er": "loser", "tr@sh!": "trash", "moooron": "moron", "s.t.u.p.i.d": "stupid", "cl*wn": "clown", "Words,": "words", "2024": "2024", "m" + "o" * 300 + "r0n": "moron"}
    assert {k: word(k) for k in pairs} == pairs


def padding(rows, capacity=2048):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    used = sum(r.length for r in rows)
    return 1 - used / (len(sequences) * capacity)


def check_pieces(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    expected = Counter()
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected[doc_id, len(ids), zlib.crc32(ids.tobytes()) if len(ids) <= 1024 else None] += 1
    found = Counter((r.doc_id, r.doc_tokens, r.ids_crc32 if r.doc_tokens <= 1024 else None) for r in rows if r.start == 0)
    assert found == expected
    assert sum(r.length for r in rows) == sum(n * k[1] for k, n in expected.items())


def test_packing(spark, corpus):
    rows = packing.op7_packing(spark, corpus[0]).collect()
    check_pieces(rows, corpus[1])
    assert padding(rows) < 0.02


def test_packing_edge_cases(docs, mixed, empty):
    rows = packing.pack_documents(docs, packing.tokenizer_path()).collect()
    check_pieces(rows, [(r[0], r[1]) for r in mixed])
    padding(rows)
    assert packing.pack_documents(empty, packing.tokenizer_path()).count() == 0


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path())
    rng = random.Random(1)
    signs = "aAbZé ß'.,!?;:-_\n\t İΣsStTlL19²½<|>日 ́😀"
    texts = ["don't stop'll, x.", "<|endoftext|> a<|startoftext|>b", "", "  ", "ﬁne ǅ, ½. ², İ.", "x" * 3000 + ","]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 50))) for _ in range(500)]
    ids, first = encoder.encode(texts)
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1], t


def test_cutting_stock_makes_exactly_the_demand():
    rng = random.Random(2)
    for sizes in (1, 5, 60):
        demand = Counter(rng.randrange(1, 257) for _ in range(sizes * 7))
        patterns = packing.cutting_stock(demand, 256)
        made = Counter()
        for counts, many in patterns:
            assert sum(s * n for s, n in counts.items()) <= 256
            for s, n in counts.items():
                made[s] += n * many
        assert made == demand
        assert sum(m for _, m in patterns) <= math.ceil(1.25 * sum(s * n for s, n in demand.items()) / 256) + 2
    assert packing.cutting_stock({}, 256) == []


def brute_top_k(rows, queries, k=10):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(1024 * x) for x in v]
            vectors[i] = min(vectors.get(i, whole), whole)
    out = set()
    for q in queries:
        if q in vectors:
            scores = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def test_search(spark, corpus):
    folder = corpus[0]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    queries = [i for i, _ in rows if i % 100 == 0]
    assert set(map(tuple, knn.op10_topk_search(spark, folder).collect())) == brute_top_k(rows, queries)


def test_search_edge_cases(spark):
    rng = np.random.default_rng(3)
    same = rng.normal(size=4).tolist()
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-2, 3)).tolist()) for i in range(300)]
    rows += [(400 + i, same) for i in range(150)] + [(0, None), (701, [1.0, None, 2.0, 3.0]), (702, [float("nan")] * 4), (703, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, same), (5, rows[5][1]), (6, same), (800, [1.0, 2.0]), (801, [2.0, 1.0]), (900, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as cell", "3 as v")
    asked = [0, 5, 6, 400, 549, 702, 800, 900]
    found = knn.top_k(table, table.where(table.vec_id.isin(asked)), 10, block=64)
    assert set(map(tuple, found.collect())) == brute_top_k(rows, asked)
    few = table.where("vec_id < 4")
    assert knn.top_k(few, few, 10).count() == 12
    assert knn.top_k(table.where("false"), table, 10).count() == 0 and knn.top_k(table, table.where("false"), 10).count() == 0


def judge(url, rules=url_filter.RULES):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.index(x) for x in "/?#" if x in rest), default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = rest[: min((rest.index(x) for x in "?#" if x in rest), default=len(rest))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3] if fits else None, max(fits)[2] if fits else "allow")


URLS = [None, "", "no scheme", "http://", "http://Example.NET/en/x?q#f", "http://a.example.net/en", "https://x.net/", "http://net/", "http://net", "http://a.b.c.d.ORG/fr/",
        "ftp://u@example.com:80/de/", "http://example.com/de/y", "http://notexample.com/de/", "http://sub.example.com/de/#x", "x://y://z.net/", "http://é.net//", "http://a..net/\nq",
        "http://example.net?x=/en/", "http://.net/", "http://w.example.net/en/" + "a/" * 3000]


def test_url_filter(spark):
    rows = [(i if i % 5 else None, u, "h") for i, u in enumerate(URLS + URLS[:6])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as verdict", "2 as best")
    found = url_filter.judge_pages(pages, url_filter.rule_table(spark))
    assert Counter(map(tuple, found.collect())) == Counter((i, *judge(u)) for i, u, _ in rows)
    more = [("net", "/a/b", "block"), ("net", "/a/b/c", "allow"), ("d.net", "/a/", "block"), ("", "/", "block"), ("x.net", "", "allow"), (None, "/", "block")]
    urls = ["http://net/a/b", "http://net/a/bc", "http://q.net/a/b/cd", "http://d.net/a/b", "http://x.net/zz", "http://x.net", "http:///abc", "http://y.d.net/a/"]
    found = url_filter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), url_filter.rule_table(spark, more))
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in found.collect()} == {u: judge(u, [r for r in more if r[0] is not None]) for u in urls}
    assert url_filter.judge_pages(pages.where("false"), url_filter.rule_table(spark)).count() == 0


def test_pipeline(spark, corpus):
    import corpus_pipeline as pipeline

    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.train(docs, common.crc_fold() != 1)
    kept = {i for i, t in rows if not model.predict(t)[2]}
    found = {r.doc_id for r in pipeline.language_id(spark, docs, folder).collect()}
    assert found == kept
    packed = pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} <= kept and padding(packed) < 0.05
    assert pipeline.run(spark, folder).exceptAll(spark.createDataFrame(packed)).count() == 0


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names


def test_shares_of_any_table_draw_rows(spark):
    """Half a millionth of a table, and far less, still draws about the rows that are asked for."""
    rows = spark.range(1_000_000).withColumn("h", F.xxhash64("id"))
    assert rows.where(common.drawn(F.col("h"), common.hash_bound(10, 10))).count() == 1_000_000
    assert 400 < rows.where(common.drawn(F.col("h"), common.hash_bound(500, 1_000_000))).count() < 600
    # In whole millionths all of these would be none.
    for count in (10**9, 5 * 10**10, 10**15):
        assert common.hash_bound(500, count) * count == pytest.approx(500 * 2**62, rel=1e-3)


def test_spacing_doubling_and_hidden_signs():
    """However three words are written, they score as the plain ones; so does one behind another, and none where there is none."""
    text = "the lazy dog and a quick fox that is with an idiot of trash as a loser on the list and is at it in the trash for a loser or an idiot " * 20
    weights = {"idiot": 3.0, "idio*": 0.5, "trash": 3.0, "trash*": 3.0, "loser": 3.0}
    model = toxicity.Model(toxicity.Restorer(toxicity.Letters(np.bincount(toxicity.trigrams(text), minlength=27**3).astype(float))), weights, -5.0)
    names = ["idiot", "trash", "loser"]
    written = [
        names, [" ".join(w) for w in names], ["".join(x * 2 for x in w) for w in names], ["​".join(w) for w in names], ["-".join(w) for w in names],
        [w[:2] + " " + w[2:] for w in names], ["a " + " ".join(w) for w in names], ["y o u " + " ".join(w) for w in names], ["1d10t", "tr@5h", "l0s3r"],
        ["i­diot", "t.r.a.s.h", "looooser"],
    ]
    scores = model.scores(["that is the " + " of the ".join(w) + " and it is" for w in written] + ["that is the lazy dog and a quick fox", "l o s t", "it is at a list"])
    assert min(scores[: len(written)]) > 0.9 > 0.05 > max(scores[len(written) :])
    # A word far inside a long run, and in a very long token, is not cut.
    assert model.scores(["x " * 61 + " ".join("idiot") + " " + " ".join("trash") + " x" * 10])[0] > 0.5
    assert model.restorer.word("l0s3r" * 40) == "loser" * 40


def test_rejection_on_the_given_tables(spark):
    """Text of no language, and of languages not learned, is rejected; documents of the learned ones stay."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL")
    model = language.train(docs, common.crc_fold() != 1)
    held = [(r.text, r.lang) for r in docs.where(common.crc_fold() == 1).select("text", "lang").collect()]
    found = [model.predict(t) for t, _ in held if len(language.subwords(t))]
    assert sum(not f[2] for f in found) >= 0.995 * len(found)
    assert sum(f[0] == lang for f, (_, lang) in zip(found, [h for h in held if len(language.subwords(h[0]))])) >= 0.98 * len(found)
    none = [m for k, (t, _) in enumerate(held) for m in language.of_no_language(" ".join(t.split()[:40]), k) if len(language.subwords(m)) > 60]
    assert sum(model.predict(t)[2] for t in none) >= 0.95 * len(none)
    probes = ["asdf jkl asdf qwer zxcv", "lorem ipsum dolor sit amet consectetur adipiscing elit", "这是一个测试文本", "Το γρήγορο καφέ αλεπού", "xkcd qwrtz bnmpl zzxv"]
    assert sum(model.predict(t)[2] for t in probes) >= 4, [model.predict(t) for t in probes]
    shares = {}
    for lang in ("de", "es"):
        fewer = language.train(docs, F.col("lang") != lang)
        other = [t for t, own in held if own == lang and len(language.subwords(t))]
        shares[lang] = sum(fewer.predict(t)[2] for t in other) / len(other)
    assert min(shares.values()) >= 0.9, shares
