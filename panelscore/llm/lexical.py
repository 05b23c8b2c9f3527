"""Ranked lexical search over bit-sliced Bloom signatures.

Documents of like length stand side by side in a block. Each sets a few bits for every term it holds, and for a term that it
holds two, four or eight times further bits; the block is kept by slices: one bitmap over its documents for each bit of the
signature. The slices of a query term, joined by AND, tell in which documents it may occur, and how often at most, never too
few. Summed with the terms' weights they bound every document's score from above. Documents whose bound reaches the score
that a place in the list takes are scored exactly from their text; all others cannot be in the list.
"""

from __future__ import annotations

import re
from collections import Counter
from heapq import heappush, heappushpop
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelscore.llm import common as c
from panelscore.session import pin

K1000, SCALE, TOP = 1000, 1_000_000_000, 50
#: Bits that a term sets, and the occurrences from which on it sets another so many.
BITS, LEVELS = 3, (1, 2, 4, 8)
#: A signature has at least so many bits for each that its document sets.
ROOM = 4
#: Bytes of document text in a slice of blocks, and of item text that are searched in one scan.
SLICE_BYTES, ITEM_BYTES = 8 << 20, 1 << 20
#: Documents, about, that are searched first for a score which the lists of all documents reach at least.
FIRST = 20_000
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NO_ID = 2**63 - 1


def terms(text: str | bytes | None) -> list[bytes]:
    """Maximal runs of digits, letters and all beyond ASCII, A-Z lower-cased; bytes.lower() changes nothing else."""
    data = text.encode() if isinstance(text, str) else text or b""
    return _TERM.findall(data.lower())


def weight(df: int, documents: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def length_norm(n: int, documents: int, total: int) -> int:
    return 50 + 50 * n * documents // total


def share(tf: int, norm: int) -> int:
    """What tf occurrences add to the score, by unit of weight; it grows with tf."""
    return SCALE * tf // (K1000 * tf + 20 * norm)


def _slots(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    """BITS places in a signature of ``size`` bits, a power of two, for each hash."""
    h = c.mix(hashes + np.uint64((level + 1) << 40))
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(BITS, dtype=np.uint64) * b[:, None]) & np.uint64(size - 1)).astype(np.int64)


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return c.word_hashes(texts, c.ALNUM, lower=True)


class Block:
    """Signatures of documents, by slices, with what bounds each occurrence level of a document."""

    def __init__(self, held: list[tuple[np.ndarray, np.ndarray]], sizes: list[int], documents: int, total: int):
        """held: distinct term hashes and their occurrences for each document; sizes: terms with repeats."""
        entries = max(sum(int((n >= at).sum()) for at in LEVELS) for _, n in held)
        self.size = 1 << max(6, (ROOM * BITS * entries - 1).bit_length())
        self.count = len(held)
        bits = np.zeros((self.size, self.count), bool)
        who = np.repeat(np.arange(self.count), [len(h) for h, _ in held])
        hashes, many = (np.concatenate(x) for x in zip(*held, strict=True))
        for level, at in enumerate(LEVELS):
            own = many >= at
            bits[_slots(hashes[own], level, self.size).ravel(), np.repeat(who[own], BITS)] = True
        self.slices = np.packbits(bits, axis=1)
        # The most that an occurrence level can add, and what it adds to the level before it.
        most = [int(n.max()) for _, n in held]
        norms = [length_norm(n, documents, total) for n in sizes]
        upto = [[share(min(m, x), norm) for m, norm in zip(most, norms, strict=True)] for x in [2 * at - 1 for at in LEVELS[:-1]] + [_NO_ID]]
        self.steps = np.diff(np.array([[0] * self.count, *upto], np.int64), axis=0)

    def bounds(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """An upper bound of every document's score for the terms."""
        out = np.zeros(self.count, np.int64)
        maybe = None
        for level in range(len(LEVELS)):
            own = np.bitwise_and.reduce(self.slices[_slots(hashes, level, self.size)], axis=1)
            maybe = own if maybe is None else maybe & own
            if not maybe.any():
                break
            sums = weights @ np.unpackbits(maybe, axis=1, count=self.count).astype(np.float64)
            out += sums.astype(np.int64) * self.steps[level]
        return out


class Searcher:
    """The best documents of each item among those that it was shown."""

    def __init__(self, items: list[dict[bytes, int]], floors: list[int], documents: int, total: int, top: int):
        """items: weight by term; floors: a score that each item's list is known to reach."""
        self.items, self.documents, self.total, self.top = items, documents, total, top
        self.floors = [max(f, 1) for f in floors]
        self.best: list[list[tuple[int, int]]] = [[] for _ in items]
        self.hashes = [term_hashes([b" ".join(t)])[0] for t in items]
        self.weights = [np.array(list(t.values()), np.float64) for t in items]
        self.bounded = self.scored = 0

    def show(self, ids: list[int | None], texts: list[bytes]) -> None:
        hashes, offsets = term_hashes(texts)
        sizes = np.diff(offsets)
        held = [np.unique(hashes[offsets[k] : offsets[k + 1]], return_counts=True) for k in range(len(texts))]
        classes: dict[int, list[int]] = {}
        for k in np.flatnonzero(sizes).tolist():
            classes.setdefault(len(held[k][0]).bit_length(), []).append(k)
        counts: dict[int, Counter] = {}
        for own in classes.values():
            block = Block([held[k] for k in own], [int(sizes[k]) for k in own], self.documents, self.total)
            for item in range(len(self.items)):
                self._rank(item, block, own, ids, texts, sizes, counts)

    def _rank(self, item: int, block: Block, own: list[int], ids: list[int | None], texts: list[bytes], sizes: np.ndarray, counts: dict[int, Counter]) -> None:
        best, floor_, wanted = self.best[item], self.floors[item], self.items[item]
        bound = block.bounds(self.hashes[item], self.weights[item])
        self.bounded += len(bound)
        at = np.flatnonzero(bound >= (max(floor_, best[0][0]) if len(best) == self.top else floor_))
        for j in at[np.argsort(-bound[at], kind="stable")].tolist():
            if len(best) == self.top and bound[j] < best[0][0]:
                break
            k = own[j]
            if k not in counts:
                counts[k] = Counter(terms(texts[k]))
            held, norm = counts[k], length_norm(int(sizes[k]), self.documents, self.total)
            score = sum(w * share(held[t], norm) for t, w in wanted.items() if t in held)
            self.scored += 1
            if score >= floor_:
                # Smaller ids are better, a missing one is the worst.
                entry = (score, -(_NO_ID if ids[k] is None else ids[k]))
                if len(best) < self.top:
                    heappush(best, entry)
                else:
                    heappushpop(best, entry)


def _slices(batches, limit: int):
    """(ids, texts) of about ``limit`` bytes, over several batches."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for b in c.text_batches(batches, limit):
        ids += b["doc_id"].to_pylist()
        texts += (new := c.as_bytes(b["text"]))
        size += sum(map(len, new))
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _term_counts(rows: DataFrame, known: frozenset[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, their terms, and the documents that hold each known term; tasks combine before the shuffle."""

    def count(batches):
        documents = total = 0
        df: Counter = Counter()
        for b in c.text_batches(batches):
            for text in c.as_bytes(b["text"]):
                words = terms(text)
                documents += bool(words)
                total += len(words)
                df.update(known.intersection(words))
        keys = [b" ", b"  ", *df]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([documents, total, *df.values()], pa.int64())], names=["term", "n"])

    found = {bytes(r.term): r.n for r in rows.select("text").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.pop(b" ", 0), found.pop(b"  ", 0), found


def _search(rows: DataFrame, items: list[dict[bytes, int]], floors: list[int], documents: int, total: int, top: int) -> DataFrame:
    """(item, score, doc_id): every task's best ``top`` documents of each item."""
    sent = rows.sparkSession.sparkContext.broadcast((items, floors))

    def look(batches):
        searcher = Searcher(*sent.value, documents, total, top)
        for ids, texts in _slices(batches, SLICE_BYTES):
            searcher.show(ids, texts)
        out = [(i, s, None if d == -_NO_ID else -d) for i, best in enumerate(searcher.best) for s, d in best]
        columns = list(zip(*out, strict=True)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["item", "score", "doc_id"])

    found = rows.mapInArrow(look, "item long, score long, doc_id long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= top)


def rank_documents(docs: DataFrame, benchmark: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES, first: int = FIRST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, best first.

    Every row of ``docs`` is a document, so rows that repeat take a place each; equal scores go by ascending doc_id, a missing
    one last. Each distinct (item_id, text) of ``benchmark`` is an item, its terms count once; a text without terms, empty or
    null, finds nothing and is found by nothing. Empty tables give no rows. Whole texts are read, in slices by bytes; other
    columns are not.

    Items are searched in blocks of about ``item_bytes`` of text, one after the other: a block is all that the driver and the
    tasks hold of them, whatever the size of ``benchmark``, and its lists are a written table before the next one begins. About
    ``first`` rows, by hash, are searched ahead: their lists end at a score that the lists of all rows reach at least, so the
    tasks of the full search start with a bound and send on only what may stay. Where that is most of the rows it is left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // item_bytes))
    out = None
    for k in range(blocks):
        block = [(r.item_id, set(terms(r.text))) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toLocalIterator()]
        block = [(i, t) for i, t in block if t]
        if not block:
            continue
        documents, total, df = _term_counts(rows, frozenset().union(*(t for _, t in block)))
        if not documents:
            break
        weights = [{t: weight(df[t], documents) for t in sorted(own) if t in df} for _, own in block]
        floors = [0] * len(block)
        if documents > 2 * first:
            ahead = rows.where(F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2**62 - 1)) < int(2**62 * first / documents))
            for r in _search(ahead, weights, floors, documents, total, top).where(F.col("rank") == top).collect():
                floors[r.item] = r.score
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "item long, item_id long")
        found = pin(_search(rows, weights, floors, documents, total, top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SQL_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(terms) AS term FROM doc) GROUP BY ALL),
n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
whole AS (SELECT count(*) AS big, CAST(sum(n) AS BIGINT) AS total FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
item AS (SELECT DISTINCT item_id, text, unnest({_SQL_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
scored AS (
  SELECT item_id, text, r, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * big + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big) // total)))) AS BIGINT) AS score
  FROM item JOIN tf USING (term) JOIN df USING (term) JOIN n USING (r), whole GROUP BY ALL),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best ``documents`` of every ``benchmark`` item, by integer scores.

    Null and empty texts are neither items nor documents that can be found; equal scores go by ascending doc_id.
    """
    return rank_documents(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))
