"""Jaccard join on word n-grams with Bayesian pruning of the candidates.

Equal texts form a class. MinHash bands put classes of a possible similarity into common buckets; classes that share buckets,
directly or through others, form a cluster. A cluster is cut into blocks, and each pair of blocks is a tile: there all pairs
are compared, a few MinHash values at a time. A pair is dropped as soon as the posterior probability that its similarity
reaches the threshold (uniform prior: a binomial tail) falls below the tolerance; the pairs that are left are counted
exactly from their n-gram sets. Tiles give sums and spanning links, never their pairs.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelscore.llm import common as c
from panelscore.llm.graph import components
from panelscore.session import pin

WORDS, THRESHOLD = 5, 0.8
#: 32 bands of 4 values miss a pair of similarity 0.8 with a probability of 5e-8; the pruning with less than 1e-9 a step.
BANDS, ROWS, STEP = 32, 4, 16
TOLERANCE = 1e-9
#: Classes, and words, of a block. Above BLOCK * SPREAD classes blocks grow up to LARGE classes, so that a text goes to at most
#: SPREAD tiles as long as that will do.
BLOCK, BLOCK_WORDS, SPREAD, LARGE = 256, 1_000_000, 32, 4096
#: Keys of at most so many texts are sent to all tasks, to leave other texts where they are; more are joined by a shuffle.
SENT_KEYS = 500_000
_RNG = np.random.default_rng(5150)
_A = (_RNG.integers(0, 2**31, BANDS * ROWS, dtype=np.int64) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.int64).astype(np.uint32)


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Distinct hashes of n consecutive words; of a shorter text the hash of all its words; of an empty one none."""
    return np.unique(c.rolling(words, min(n, len(words)))) if len(words) else np.zeros(0, np.uint64)


def signature(grams: np.ndarray) -> np.ndarray:
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), np.iinfo(np.uint32).max, np.uint32)
    for low in range(0, len(x), 1024):
        out = np.minimum(out, (x[low : low + 1024, None] * _A + _B).min(0))
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    pairs = sig.astype(np.uint64).reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = c.mix(h * np.uint64(0x9E3779B97F4A7C15) + pairs[:, i])
    return h.view(np.int64)


def fewest_matches(n: int, threshold: float, tolerance: float) -> int:
    """The least number of equal values of n at which the posterior P(similarity >= threshold) is not below tolerance."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def similar_pairs(sigs: np.ndarray, grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, threshold: float, tolerance: float):
    """Pairs (i of left, j of right; i before j in one block) whose exact Jaccard similarity reaches the threshold."""
    if same:
        i, j = np.triu_indices(len(left), 1)
    else:
        i, j = (x.ravel() for x in np.indices((len(left), len(right))))
    i, j = left[i], right[j]
    equal = np.zeros(len(i), np.int64)
    for low in range(0, sigs.shape[1], STEP):
        equal += (sigs[i, low : low + STEP] == sigs[j, low : low + STEP]).sum(1)
        alive = equal >= fewest_matches(low + STEP, threshold, tolerance)
        i, j, equal = i[alive], j[alive], equal[alive]
    sizes = np.array([len(g) for g in grams])
    fits = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9
    i, j = i[fits], j[fits]
    if not len(i):
        return i, j
    used = np.unique(np.concatenate((i, j)))
    if len(i) > 4 * len(used):
        common = _common(used, grams)[np.searchsorted(used, i), np.searchsorted(used, j)]
    else:
        common = np.array([len(np.intersect1d(grams[a], grams[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    good = common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9
    return i[good], j[good]


def _common(used: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as sums of products over slices of the common n-grams."""
    values, code = np.unique(np.concatenate([grams[u] for u in used]), return_inverse=True)
    owner = np.repeat(np.arange(len(used)), [len(grams[u]) for u in used])
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(used), len(used)), np.float32)
    for low in range(0, len(values), 8192):
        a, b = np.searchsorted(code, [low, low + 8192])
        x = np.zeros((len(used), 8192), np.float32)
        x[owner[a:b], code[a:b] - low] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _parts(left: np.ndarray, right: np.ndarray, same: bool, size: int):
    """Two blocks in parts of at most ``size`` classes, so that pairs and their intersections take bounded memory."""
    for x in range(0, len(left), size):
        for y in range(x if same else 0, len(right), size):
            yield left[x : x + size], right[y : y + size], same and x == y


def _stars(n: int, i: np.ndarray, j: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For n local items, the smallest name of the component of each."""
    label = names.copy()
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (before == label).all():
            return label


_SKETCH = "tid long, doc_id long, n_words long, bands array<long>"


def _key(column: str):
    """An id to join on; null is a value of its own."""
    return F.coalesce(column, F.lit(-(2**63)))


def near_join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(tid, copies, class_id, links, texts, group_id, first_tid): one row per distinct text of ``docs``.

    ``links`` counts the documents of other texts whose similarity reaches the threshold, ``texts`` those texts. ``class_id`` is
    the smallest doc_id that has the text, ``group_id`` the smallest in the connected component of all links and ``first_tid`` its
    text (of several, the least hash). A null text is empty; an empty text has no n-grams and links to nothing, but its copies are one class. Null ids are ignored by the
    minima (null if there is no other). Rows that repeat are copies. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))

    def sketch(batches):
        for b in c.text_batches(batches):
            hashes, offsets = c.word_hashes(c.as_bytes(b["text"]), c.NOT_SPACE)
            counts = np.diff(offsets)
            keys = []
            for i in range(len(counts)):
                grams = shingles(hashes[offsets[i] : offsets[i + 1]], words)
                keys.append(bands(signature(grams)) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [b["tid"], b["doc_id"], pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["tid", "doc_id", "n_words", "bands"]
            )

    sketches = rows.mapInArrow(sketch, _SKETCH).groupBy("tid")
    classes = pin(
        sketches.agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("class_id"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands"))
    )
    banded = classes.select("tid", F.explode("bands").alias("band"))
    shared = pin(banded.groupBy("band").agg(F.min("tid").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    near = components(banded.join(shared, "band").where("tid <> least").select(F.col("tid").alias("a"), F.col("least").alias("b")))
    facts = classes.select("tid", "copies", "class_id", "n_words")
    members = pin(near.select(F.col("node").alias("tid"), F.col("label").alias("cluster")).join(facts, "tid"))
    size = F.count(F.lit(1))
    classes_each = F.least(F.greatest(F.lit(block), F.ceil(size / SPREAD)), F.lit(max(block, LARGE)))
    blocks = members.groupBy("cluster").agg(
        F.greatest(F.ceil(size / classes_each), F.ceil(F.sum("n_words") / BLOCK_WORDS)).cast("long").alias("blocks")
    )
    total, count = members.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count(F.lit(1))).first()
    cells = max(c.parallelism(docs.sparkSession), -(-total // BLOCK_WORDS))
    # A cell, which is held in memory, is a tile of a cluster of several blocks, or some clusters of one block.
    tile = F.when(F.col("blocks") > 1, F.xxhash64("cluster", "i", "j")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(cells)))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = (
        members.join(blocks, "cluster")
        .withColumn("own", F.pmod(F.xxhash64("tid"), "blocks"))
        .select("tid", "class_id", "cluster", "copies", "blocks", "own", other.alias("other"))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .select("tid", "cluster", "copies", "own", "i", "j", _key("class_id").alias("key"), tile.alias("cell"))
    )
    texts = rows.select("tid", _key("doc_id").alias("key"), "text")
    if count <= SENT_KEYS:
        # Then only texts of clusters are shuffled.
        texts = texts.join(F.broadcast(members.select("tid", _key("class_id").alias("key"))), ["tid", "key"], "left_semi")

    def solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tiles: dict[tuple, dict] = {}
        names = ("cluster", "i", "j", "tid", "own", "copies", "text")
        for cluster, i, j, tid, own, copies, text in zip(*(table[n].to_pylist() for n in names), strict=True):
            tiles.setdefault((cluster, i, j), {})[tid] = (own, copies, text)
        out = []
        for (_, i, j), members in tiles.items():
            tids = np.array(sorted(members), np.int64)
            if len(tids) < 2:
                continue
            hashes, offsets = c.word_hashes([members[t][2].encode() for t in tids.tolist()], c.NOT_SPACE)
            grams = [shingles(hashes[offsets[k] : offsets[k + 1]], words) for k in range(len(tids))]
            sigs = np.stack([signature(g) for g in grams])
            own = np.array([members[t][0] for t in tids.tolist()])
            copies = np.array([members[t][1] for t in tids.tolist()])
            links, texts = np.zeros(len(tids)), np.zeros(len(tids), np.int64)
            stars = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for left, right, same in _parts(np.flatnonzero(own == i), np.flatnonzero(own == j), i == j, block):
                a, b = similar_pairs(sigs, grams, left, right, same, threshold, tolerance)
                if not len(a):
                    continue
                links += np.bincount(a, copies[b], len(tids)) + np.bincount(b, copies[a], len(tids))
                texts += np.bincount(a, minlength=len(tids)) + np.bincount(b, minlength=len(tids))
                # Of a part's pairs only links that span the same components are kept.
                linked = np.unique(np.concatenate((a, b)))
                least = _stars(len(linked), np.searchsorted(linked, a), np.searchsorted(linked, b), linked)
                stars.append((linked, least))
            label = _stars(len(tids), *map(np.concatenate, zip(*stars, strict=True)), tids)
            out += [(t, int(x), int(n), int(m)) for t, x, n, m in zip(tids.tolist(), label.tolist(), links.tolist(), texts.tolist(), strict=True) if m]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["tid", "least", "links", "texts"])

    found = pin(placed.join(texts, ["tid", "key"]).groupBy("cell").applyInArrow(solve, "tid long, least long, links long, texts long"))
    groups = components(found.select(F.col("tid").alias("a"), F.col("least").alias("b")))
    sums = found.groupBy("tid").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    labelled = facts.join(sums, "tid", "left").join(groups.withColumnRenamed("node", "tid"), "tid", "left")
    labelled = pin(labelled.select("tid", "copies", "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("label", "tid").alias("label")))
    first = labelled.where("texts > 0").groupBy("label").agg(F.min(F.struct(F.coalesce("class_id", F.lit(2**63 - 1)), "class_id", "tid")).alias("first"))
    return labelled.join(first, "label", "left").select(
        "tid", "copies", "class_id", "links", "texts",
        F.when(F.col("first").isNull(), F.col("class_id")).otherwise(F.col("first.class_id")).alias("group_id"),
        F.coalesce("first.tid", "tid").alias("first_tid"),
    )


def linked_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, group_id, n_links): one row per row of ``docs``; n_links counts copies and similar documents."""
    found = near_join(docs, **options)
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"))
    return rows.join(found, "tid").select("doc_id", "class_id", "group_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of copies and similar documents: that with the smallest id, and its whole row.

    Of rows that share the smallest id and text one stays, that of the least hash. In a group without any id one row of the
    text with the least hash stays. Null texts count as empty texts, empty texts as copies.
    """
    found = pin(near_join(docs, **options))
    # Texts that have no copy and no text like them stay where they are; the others are looked at by row.
    grouped = found.where("copies > 1 or texts > 0").select("tid", _key("class_id").alias("key"), (F.col("tid") == F.col("first_tid")).alias("first"))
    sent = F.broadcast if grouped.count() <= SENT_KEYS else (lambda table: table)
    named = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), _key("doc_id").cast("long").alias("key"))
    first = Window.partitionBy("tid", "key").orderBy(F.xxhash64("row"))
    alone = named.join(sent(grouped.select("tid")), "tid", "left_anti").select("row.*")
    rows = named.join(sent(grouped.where("first").select("tid", "key")), ["tid", "key"])
    return alone.union(rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("row.*"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(c.table(spark, sf_dir, "documents"))
