"""Benchmark decontamination by winnowing.

Of every ``window - k + 1`` neighbouring k-grams the one with the least hash is kept, so a span of ``window`` words that a
document shares with an item always shares a kept k-gram. Kept k-grams of the items are joined with those of the documents;
each hit is extended to the full windows around it, which are compared by their own hash. Items shorter than a window fall
outside that guarantee and are looked up by their whole length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscore.llm import common as c
from panelscore.session import pin, unpin

#: Bytes of item text that go to each executor at once; a larger benchmark is a query set that runs in blocks of this size.
BLOCK_BYTES = 32 << 20
WINDOW, GRAM = 10, 5


def winnow(grams: np.ndarray, valid: np.ndarray, span: int) -> np.ndarray:
    """Flags of the k-grams that are the minimum of some ``span`` neighbours inside one text."""
    if len(grams) < span:
        return np.zeros(len(grams), bool)
    top = np.iinfo(np.uint64).max
    held = np.where(valid, grams, top)
    least = c.sliding_min(held, span)
    keep = np.zeros(len(grams), bool)
    for shift in range(span):
        keep[shift : shift + len(least)] |= held[shift : shift + len(least)] == least
    return keep & valid


class Index:
    """One block of items: kept k-grams, hashes of whole windows with their items, and short items by length."""

    def __init__(self, items: list[tuple[str, str]], window: int, gram: int, blocks: int = 1):
        self.window, self.gram, self.blocks = window, gram, blocks
        texts = [t.encode() for _, t in items]
        words, offsets = c.word_hashes(texts, c.ALNUM, lower=True)
        counts = np.diff(offsets)
        grams = c.rolling(words, gram)
        keep = winnow(grams, c.inside(offsets, gram, len(words)), window - gram + 1)
        self.grams = np.unique(grams[keep])
        self.ids = [i for i, _ in items]
        self.whole = {}
        for n in sorted({int(min(x, window)) for x in counts if x}):
            hashes = c.rolling(words, n)
            owner = np.repeat(np.arange(len(items)), counts)[: len(hashes)]
            fits = c.inside(offsets, n, len(words)) & ((counts == n) if n < window else (counts >= n))[owner]
            pairs = np.unique(np.stack([hashes[fits], owner[fits].astype(np.uint64)], 1), axis=0)
            keys, first = np.unique(pairs[:, 0], return_index=True)
            self.whole[n] = keys, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64)

    def scan(self, texts: list[bytes]):
        """For each text: number of words, flags of its words that are hit, numbers of the items that occur."""
        words, offsets = c.word_hashes(texts, c.ALNUM, lower=True)
        total = len(words)
        hit = np.zeros(total, bool)
        owner_items: list[tuple[np.ndarray, np.ndarray]] = []
        for n, (keys, first, items) in self.whole.items():
            hashes = c.rolling(words, n)
            look = c.inside(offsets, n, total)
            if n == self.window:
                grams = c.rolling(words, self.gram)
                keep = np.flatnonzero(winnow(grams, c.inside(offsets, self.gram, total), n - self.gram + 1))
                keep = keep[member(grams[keep], self.grams)]
                near = np.zeros(total + 1, np.int64)
                np.add.at(near, np.maximum(keep - (n - self.gram), 0), 1)
                np.subtract.at(near, keep + 1, 1)
                look &= np.cumsum(near)[: len(look)] > 0
            at = np.flatnonzero(look)
            at = at[member(hashes[at], keys)]
            if len(at):
                marks = np.zeros(len(hashes), bool)
                marks[at] = True
                hit |= c.covered(marks, n, total)
                doc = np.searchsorted(offsets, at, side="right") - 1
                spot = np.searchsorted(keys, hashes[at])
                both = np.unique(np.stack([doc, spot], 1), axis=0)
                many = first[both[:, 1] + 1] - first[both[:, 1]]
                where = np.repeat(first[both[:, 1]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                owner_items.append((np.repeat(both[:, 0], many), items[where]))
        found: dict[int, set] = {}
        for docs, items in owner_items:
            for d, i in zip(docs.tolist(), items.tolist(), strict=True):
                found.setdefault(d, set()).add(self.ids[i])
        for d in range(len(texts)):
            yield int(offsets[d + 1] - offsets[d]), hit[offsets[d] : offsets[d + 1]], found.get(d, set())


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


SCHEMA = "rid long, doc_id long, n_words long, n_hit long, items array<string>, spans array<int>"


def _spans(flags: np.ndarray) -> list[int]:
    """Begin and end of each run of flagged words, alternating."""
    return np.flatnonzero(np.diff(flags.view(np.int8), prepend=0, append=0)).tolist()


def _indexes(items: DataFrame, window: int, gram: int, block_bytes: int):
    """An index of each block of items, sent to the executors when it is asked for; at least one. Repeated rows count once: all would fall into one block."""
    if not 1 <= gram < window:
        raise ValueError("gram must be shorter than window")
    known = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    blocks = max(1, -(-c.text_bytes(known) // block_bytes))
    known = known.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        held = [(r.item_id, r.text) for r in known.where(F.col("block") == block).collect()]
        yield items.sparkSession.sparkContext.broadcast(Index(held, window, gram, blocks))


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(rid, doc_id, n_words, n_hit, items, spans): one row per row of ``docs``.

    ``items`` are the ids, as sorted strings, of the items of which a window occurs; ``spans`` are the word positions of hit
    runs (begin, end, begin, ...). Null and empty texts have no words. Rows keep null and repeated ids. Items of null or
    empty text, or of null id, occur nowhere; items that share an id count as one. Other columns are not read. ``rid`` is a
    hash of id and text. The benchmark is the query set: blocks of at most ``block_bytes`` (or one item) are sent out.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for index in _indexes(items, window, gram, block_bytes):

        def scan(batches, index=index):
            for b in c.text_batches(batches):
                found = list(index.value.scan(c.as_bytes(b["text"])))
                yield pa.RecordBatch.from_arrays(
                    [
                        b["rid"], b["doc_id"],
                        pa.array([n for n, _, _ in found], pa.int64()),
                        pa.array([int(f.sum()) for _, f, _ in found], pa.int64()),
                        pa.array([sorted(s) for _, _, s in found], pa.list_(pa.string())),
                        pa.array([_spans(f) for _, f, _ in found], pa.list_(pa.int32())),
                    ],
                    names=["rid", "doc_id", "n_words", "n_hit", "items", "spans"],
                )

        found = rows.mapInArrow(scan, SCHEMA)
        if index.value.blocks == 1:
            return found
        # What a block finds is written before the next one is sent out: one block is held at a time.
        parts.append(pin(found if not parts else found.where("n_hit > 0")))
        index.unpersist(blocking=True)
    return _merged(parts)


def _merged(parts: list[DataFrame]) -> DataFrame:
    """The first block's rows with what the other blocks found: only hits are shuffled on the other side."""
    more = parts[1]
    for p in parts[2:]:
        more = more.union(p)
    more = more.where("n_hit > 0").dropDuplicates(["rid", "items", "spans"])
    more = more.groupBy("rid").agg(F.flatten(F.collect_list("items")).alias("more_items"), F.collect_list("spans").alias("more_spans"))

    def union(batches):
        for b in batches:
            out = []
            for own, other in zip(b["spans"].to_pylist(), b["more_spans"].to_pylist(), strict=True):
                flat = sorted((s[i], s[i + 1]) for s in [own, *(other or [])] for i in range(0, len(s), 2))
                runs: list[int] = []
                for low, high in flat:
                    if runs and low <= runs[-1]:
                        runs[-1] = max(runs[-1], high)
                    else:
                        runs += [low, high]
                out.append(runs)
            names = [sorted({*own, *(other or [])}) for own, other in zip(b["items"].to_pylist(), b["more_items"].to_pylist(), strict=True)]
            hits = [sum(r[1::2]) - sum(r[0::2]) for r in out]
            yield pa.RecordBatch.from_arrays(
                [b["rid"], b["doc_id"], b["n_words"], pa.array(hits, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(out, pa.list_(pa.int32()))],
                names=["rid", "doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return parts[0].join(more, "rid", "left").mapInArrow(union, SCHEMA)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs, with all their columns.

    With several blocks of items what is left after each is written before the next one is sent out, and the table before it
    is dropped.
    """
    at = docs.columns.index("text")
    for index in _indexes(items, window, gram, block_bytes):

        def keep(batches, index=index):
            for b in c.text_batches(batches, text=at):
                clean = [not hit.any() for _, hit, _ in index.value.scan(c.as_bytes(b.column(at)))]
                yield b.filter(pa.array(clean, pa.bool_()))

        left = docs.mapInArrow(keep, docs.schema)
        if index.value.blocks == 1:
            return left
        before, docs = docs, pin(left)
        index.unpersist(blocking=True)
        if hasattr(before, "pinned_at"):
            unpin(before)
    return docs


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(decontaminate(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark")))
