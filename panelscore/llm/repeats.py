"""Removal of word passages that occur earlier in the corpus.

Two operators share the second half. ``fixed_blocks`` indexes the non-overlapping blocks of every document and probes them
with every rolling window; ``minimisers`` keeps the suffixes that begin at content-selected places. Both find anchors: k-grams
that occur in two places, at least one in each long enough repeat. So far hashes decide, cut to as many bits as the corpus
needs: equal words never differ in them, and what is found too much costs work only.

From there on words decide. Every window of ``length`` words that may repeat belongs to one anchor, the least in it, which is
the same wherever the window stands. The words around the anchors are brought together by the anchor, sorted, and compared
with their neighbours, to the right from the anchor on and to the left before it: windows are equal if both common prefixes
reach their ends. Of equal windows the earliest stays; the others, joined where they overlap, are the maximal repeats removed.

Documents are dealt into batches by their id. A batch sends its distinct hashes, sorted and packed, to buckets of the hash
range, and each distinct stretch of words once; so however often a passage occurs, a bucket gets it once from each batch.
Nothing is broadcast or collected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from inspect import signature

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscore.llm import common as c
from panelscore.llm.winnowing import member

BATCH_BYTES = 8 << 20
#: Batches that a task works through one after the other.
BATCHES_PER_TASK = 4
ANCHORS, WINDOWS = 0, 1
U64 = np.uint64
_LISTS = "bucket long, batch long, hashes binary, extra binary"
SPANS = "doc_id long, rid long, n_words long, n_removed long, kept_sha256 string, spans array<int>"


def fixed_blocks(words: np.ndarray, offsets: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes to exchange: every rolling window; the low bit tells the blocks of the index."""
    at = np.flatnonzero(c.inside(offsets, block, len(words)))
    hashes = c.rolling(words, block)[at] & ~U64(1)
    begin = offsets[np.searchsorted(offsets, at, side="right") - 1]
    return at, hashes | ((at - begin) % block == 0).astype(U64)


def minimisers(words: np.ndarray, offsets: np.ndarray, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and first ``gram`` words, hashed, of the suffixes kept: the least k-gram of each ``span`` neighbours."""
    from panelscore.llm.winnowing import winnow

    grams = c.rolling(words, gram)
    at = np.flatnonzero(winnow(grams, c.inside(offsets, gram, len(words)), span))
    return at, grams[at] | U64(1)


def _giving_back(step: Callable) -> Callable:
    """A step on one group whose worker returns what it has freed: several steps live beside each other on an executor."""

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = step(key, table)
        c.give_back()
        return out

    def two(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = step(key, left, right)
        c.give_back()
        return out

    return two if len(signature(step).parameters) == 3 else one


class Batch:
    """One batch of documents in order of (id, text), with what both passes compute from it."""

    def __init__(self, table: pa.Table, length: int):
        seen = Counter(zip(table["doc_id"].to_pylist(), table["rid"].to_pylist(), c.as_bytes(table["text"]), strict=True))
        rows = sorted(seen, key=lambda r: (r[0], r[2]))
        self.copies = [seen[r] for r in rows]
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.rids = [r[1] for r in rows]
        self.texts = [r[2] for r in rows]
        self.words, self.offsets = c.word_hashes(self.texts, c.NOT_SPACE)
        self.length = length

    def repeats(self, gram: int, mask: np.uint64, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words and cut hashes of the windows that hold an anchor, and the place of the least anchor in each.

        ``anchors`` are sorted. Ties go to the first place, so windows of the same words have it at the same distance.
        """
        total = len(self.words)
        if total < self.length or not len(anchors):
            return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
        grams = c.rolling(self.words, gram) & mask
        places = np.flatnonzero(c.inside(self.offsets, gram, total))
        places = places[member(grams[places] | U64(1), anchors)]
        none = np.iinfo(np.int64).max
        held = np.full(len(grams), none, np.int64)
        held[places] = np.unique(grams[places], return_inverse=True)[1] * (total + 1) + places
        least = c.sliding_min(held, self.length - gram + 1)
        at = np.flatnonzero(c.inside(self.offsets, self.length, total) & (least < none))
        return at, c.rolling(self.words, self.length)[at] & mask | U64(1), least[at] % (total + 1)

    def stretches(self, begins: np.ndarray, sizes: np.ndarray):
        """The words of each stretch that lies in one text, in order of place, a space behind every word."""
        known = -1
        for i, low, n in zip((np.searchsorted(self.offsets, begins, side="right") - 1).tolist(), begins.tolist(), sizes.tolist(), strict=True):
            if i != known:
                known, words, base = i, self.texts[i].split(), int(self.offsets[i])
            yield b" ".join(words[low - base : low - base + n]) + b" "


def _slices(hashes: np.ndarray, buckets: int):
    """Bucket, begin and end of each run of a sorted list that falls into one bucket of the hash range."""
    bucket = ((hashes >> U64(32)) * U64(buckets)) >> U64(32)
    begin = np.flatnonzero(np.diff(bucket, prepend=~U64(0))) if len(bucket) else []
    for i, low in enumerate(begin):
        yield int(bucket[low]), low, begin[i + 1] if i + 1 < len(begin) else len(bucket)


def _rows(rows: list[tuple]) -> pa.Table:
    a, b, x, y = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.table({"bucket": pa.array(a, pa.int64()), "batch": pa.array(b, pa.int64()), "hashes": pa.array(x, pa.binary()), "extra": pa.array(y, pa.binary())})


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _sorted_neighbours(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of a matrix of word numbers, and the common prefix of each with the one before it."""
    width = rows.shape[1]
    if not width or len(rows) < 2:
        return np.arange(len(rows)), np.zeros(max(len(rows) - 1, 0), np.int64)
    order = np.argsort(np.ascontiguousarray(rows, ">u4").view(f"S{4 * width}").ravel(), kind="stable")
    differ = rows[order[1:]] != rows[order[:-1]]
    return order, np.where(differ.any(axis=1), differ.argmax(axis=1), width)


def _alike(order: np.ndarray, common: np.ndarray, n: int) -> np.ndarray:
    """A number for each row; rows with the same first n entries have the same."""
    out = np.zeros(len(order), np.int64)
    out[order[1:]] = np.cumsum(common < n)
    return out


def later_windows(text: bytes, left: np.ndarray, count: np.ndarray, ids: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Which windows of stretches of words stand earlier in another stretch.

    A stretch has ``count`` windows of ``length`` words and its anchor behind ``left`` words. Earlier is by (id, place). One
    flag for each window, stretch by stretch.
    """
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20) + 1
    bounds = np.concatenate(([0], ends)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(text)])
    numbers = words.dictionary_encode().indices.to_numpy().astype(np.uint32) + np.uint32(1)
    sizes = length + count - 1
    last = np.cumsum(sizes)
    begin = last - sizes
    anchor = begin + left

    def matrix(at: np.ndarray, fits: np.ndarray) -> np.ndarray:
        return np.where(fits, numbers[np.clip(at, 0, len(numbers) - 1)], np.uint32(0))

    at = anchor[:, None] + np.arange(int((sizes - left).max()))
    order, common = _sorted_neighbours(matrix(at, at < last[:, None]))
    at = anchor[:, None] - 1 - np.arange(int(left.max()))
    order_left, common_left = _sorted_neighbours(matrix(at, at >= begin[:, None]))
    rank = np.empty(len(left), np.int64)
    rank[np.lexsort((places, ids))] = np.arange(len(left))
    first = np.cumsum(count) - count
    later = np.zeros(int(count.sum()), bool)
    for before in range(int(left.max()) + 1):
        mine = np.flatnonzero((left >= before) & (left - count < before))
        kind = _alike(order_left, common_left, before)[mine] * len(left) + _alike(order, common, length - before)[mine]
        by = np.lexsort((rank[mine], kind))
        again = np.flatnonzero(kind[by[1:]] == kind[by[:-1]]) + 1
        who = mine[by[again]]
        later[first[who] + left[who] - before] = True
    return later


def repeated_spans(docs: DataFrame, length: int, gram: int, anchors: Callable, batch_bytes: int = BATCH_BYTES, bits: int | None = None) -> DataFrame:
    """(doc_id, rid, n_words, n_removed, kept_sha256, spans) of each row with a non-null id.

    ``spans`` are the word positions removed (begin, end, begin, ...). Windows are judged on the input. Rows that share an id
    come in the order of their texts; rows that repeat id and text are one document and get the
    same result. ``rid`` is a hash of id and text. ``bits`` of a hash are exchanged to find candidates, by default 8 more
    than number the corpus's bytes; the result does not depend on it.
    """
    spark = docs.sparkSession
    size = c.text_bytes(docs)
    batches = max(c.parallelism(spark), -(-size // batch_bytes))
    buckets = batches
    tasks = -(-batches // BATCHES_PER_TASK)
    bits = min(62, size.bit_length() + 8) if bits is None else bits
    mask = U64((2**bits - 1) << (64 - bits))
    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"), "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(batches)).alias("batch")
    )

    def spread(frame: DataFrame, key: str) -> DataFrame:
        """As many tasks as the corpus needs, where that is more than the session's setting."""
        return frame.repartition(tasks, key) if tasks > c.parallelism(spark) else frame

    def packed(hashes: np.ndarray, batch: int) -> pa.Table:
        """Distinct hashes, whose low bit is set if it is anywhere; extra: which occur twice here."""
        hashes = np.sort(hashes)
        keys = hashes | U64(1)
        last = np.append(keys[1:] != keys[:-1], True)[: len(keys)]
        first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        many = ~(first & last)[last]
        kept = hashes[last]
        return _rows([(b, batch, c.pack(kept[low:high]), _bits(many[low:high])) for b, low, high in _slices(kept, buckets)])

    def offer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        batch = Batch(table, length)
        return packed(anchors(batch.words, batch.offsets)[1] & (mask | U64(1)), key[0].as_py())

    def meet(tag: int) -> Callable:
        def met(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            """Which of each batch's hashes have a low bit set somewhere and are found in two places."""
            lists = [c.unpack(x) for x in table["hashes"].to_pylist()]
            sizes = [len(x) for x in lists]
            own = np.concatenate(lists)
            many = np.concatenate([_flags(x, n) for x, n in zip(table["extra"].to_pylist(), sizes, strict=True)])
            order = np.argsort(own | U64(1), kind="stable")
            ordered = own[order]
            begin = np.flatnonzero(np.append(True, (ordered[1:] | U64(1)) != (ordered[:-1] | U64(1))))
            indexed = np.maximum.reduceat(ordered & U64(1), begin) > 0
            count = np.diff(np.append(begin, len(ordered)))
            good = indexed & ((count > 1) | np.maximum.reduceat(many[order], begin))
            flags = np.empty(len(own), bool)
            flags[order] = np.repeat(good, count)
            out, low = [], 0
            for batch, n, values in zip(table["batch"].to_pylist(), sizes, lists, strict=True):
                if flags[low : low + n].any():
                    out.append((tag, batch, c.pack(values[flags[low : low + n]] | U64(1)), b""))
                low += n
            return _rows(out)

        return met

    def gathered(table: pa.Table, tag: int) -> np.ndarray:
        lists = [c.unpack(x) for t, x in zip(table["bucket"].to_pylist(), table["hashes"].to_pylist(), strict=True) if t == tag]
        return np.sort(np.concatenate(lists)) if lists else np.zeros(0, U64)

    def widen(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        """The windows around the batch's anchors."""
        if not left.num_rows or not right.num_rows:
            return _rows([])
        return packed(Batch(left, length).repeats(gram, mask, gathered(right, ANCHORS))[1], key[0].as_py())

    def send(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        """Stretches of words around anchors, each of them once; and the windows of those that the batch has already."""
        if not left.num_rows or not right.num_rows:
            return _rows([])
        batch = Batch(left, length)
        at, hashes, owner = batch.repeats(gram, mask, gathered(right, ANCHORS))
        twice = member(hashes, gathered(right, WINDOWS))
        at, owner = at[twice], owner[twice]
        first = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0))
        count = np.diff(np.append(first, len(at)))
        low, place = at[first], owner[first]
        seen, kept, words, gone = set(), [], [], []
        for k, text in enumerate(batch.stretches(low, length + count - 1)):
            if text in seen:
                gone.append(np.arange(low[k], low[k] + count[k]))
            else:
                seen.add(text)
                kept.append(k)
                words.append(text)
        out = [(key[0].as_py(), key[0].as_py(), b"", c.pack(np.concatenate(gone).astype(U64)))] if gone else []
        if kept:
            kept = np.array(kept)
            ids = batch.ids[np.searchsorted(batch.offsets, low[kept], side="right") - 1]
            about = np.stack((place[kept] - low[kept], count[kept], ids, place[kept]))
            lead = c.rolling(batch.words, gram)[place[kept]] & mask
            order = np.argsort(lead, kind="stable")
            for b, i, j in _slices(lead[order], buckets):
                text = b"".join([words[k] for k in order[i:j].tolist()])
                out.append((b, key[0].as_py(), c.pack_ids(about[:, order[i:j]].ravel()), zstandard.ZstdCompressor(level=1).compress(text)))
        return _rows(out)

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The places of each batch's windows that stand earlier elsewhere."""
        out, whose, about, texts = [], [], [], []
        for batch, values, extra in zip(*(table[x].to_pylist() for x in ("batch", "hashes", "extra")), strict=True):
            if not values:
                out.append((key[0].as_py(), batch, b"", extra))
                continue
            whose.append(batch)
            about.append(c.unpack_ids(values).reshape(4, -1))
            texts.append(zstandard.ZstdDecompressor().decompress(extra))
        if whose:
            left, count, ids, places = np.concatenate(about, axis=1)
            later = later_windows(b"".join(texts), left, count, ids, places, length)
            windows = np.repeat(places - left - (np.cumsum(count) - count), count) + np.arange(len(later))
            begin = 0
            for batch, mine in zip(whose, about, strict=True):
                end = begin + int(mine[1].sum())
                if later[begin:end].any():
                    out.append((key[0].as_py(), batch, b"", c.pack(np.sort(windows[begin:end][later[begin:end]]).astype(U64))))
                begin = end
        return _rows(out)

    def remove(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        batch = Batch(left, length)
        total = len(batch.words)
        gone = np.zeros(total, bool)
        if right.num_rows:
            marks = np.zeros(total, bool)
            marks[np.concatenate([c.unpack(x) for x in right["extra"].to_pylist()]).astype(np.int64)] = True
            gone = c.covered(marks, length, total)
        out = []
        for i, text in enumerate(batch.texts):
            mine = gone[batch.offsets[i] : batch.offsets[i + 1]]
            kept = text.split()
            if mine.any():
                kept = [w for w, g in zip(kept, mine.tolist(), strict=True) if not g]
            edges = np.flatnonzero(np.diff(mine.view(np.int8), prepend=0, append=0))
            out += batch.copies[i] * [(int(batch.ids[i]), batch.rids[i], len(mine), int(mine.sum()), c.sha(b" ".join(kept)), edges.tolist())]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int32())]
        return pa.table([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=["doc_id", "rid", "n_words", "n_removed", "kept_sha256", "spans"])

    def exchanged(lists: DataFrame, tag: int) -> DataFrame:
        return spread(lists, "bucket").groupBy("bucket").applyInArrow(_giving_back(meet(tag)), _LISTS)

    def beside(lists: DataFrame, step: Callable, schema: str) -> DataFrame:
        return texts.groupBy("batch").cogroup(spread(lists, "batch").groupBy("batch")).applyInArrow(_giving_back(step), schema)

    texts = spread(rows, "batch")
    shared = exchanged(texts.groupBy("batch").applyInArrow(_giving_back(offer), _LISTS), ANCHORS)
    windows = exchanged(beside(shared, widen, _LISTS), WINDOWS)
    stretches = spread(beside(shared.union(windows), send, _LISTS), "bucket")
    return beside(stretches.groupBy("bucket").applyInArrow(_giving_back(compare), _LISTS), remove, SPANS)


def _without_id(docs: DataFrame) -> DataFrame:
    """Rows whose id is null, left whole."""

    def whole(batches):
        for b in c.text_batches(batches):
            words = [t.split() for t in c.as_bytes(b["text"])]
            none = pa.nulls(len(words), pa.int64())
            counts, digests = pa.array([len(w) for w in words], pa.int64()), pa.array([c.sha(b" ".join(w)) for w in words], pa.string())
            zero, empty = pa.array([0] * len(words), pa.int64()), pa.array([[]] * len(words), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([none, none, counts, zero, digests, empty], names=["doc_id", "rid", "n_words", "n_removed", "kept_sha256", "spans"])

    return docs.where("doc_id is null").select("doc_id", "text").mapInArrow(whole, SPANS)


def substring_repeats(docs: DataFrame, length: int = 20, batch_bytes: int = BATCH_BYTES, bits: int | None = None) -> DataFrame:
    """Words covered by a window of ``length`` words that starts earlier, found by fixed-block anchors.

    Blocks have half the length, so every window holds a whole block of the earlier place whatever its alignment. Blocks
    that a rolling window meets are extended on the words, to both sides, to maximal repeats.
    A null text has no words. A row without id cannot be ordered: it stays whole and is no reference. See repeated_spans
    for rows that share an id. Other columns are not read; an empty table gives an empty result.
    """
    block = (length + 1) // 2
    found = repeated_spans(docs, length, block, lambda w, o: fixed_blocks(w, o, block), batch_bytes, bits)
    return found.union(_without_id(docs))


def suffix_repeats(docs: DataFrame, length: int = 50, batch_bytes: int = BATCH_BYTES // 2, bits: int | None = None) -> DataFrame:
    """Words covered by a window of ``length`` words that starts earlier, found by a sparse suffix array.

    Suffixes begin at the minimisers of ``length // 2`` neighbouring k-grams, so that each window of ``length`` words holds
    a kept suffix. Those whose first k words occur twice are sorted by their words, compared with their neighbours by common
    prefix, and extended to the left in the same way.
    The rules for nulls, repeated and empty rows are those of substring_repeats.
    """
    span = length // 2
    gram = length - span + 1
    found = repeated_spans(docs, length, gram, lambda w, o: minimisers(w, o, gram, span), batch_bytes, bits)
    return found.union(_without_id(docs))


RESULT = ("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_repeats(c.table(spark, sf_dir, "documents"), 20).select(*RESULT)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats(c.table(spark, sf_dir, "documents"), 50).select(*RESULT)
