"""Packing of tokenised documents by cutting-stock column generation.

A document is cut into full sequences and a rest; of a rest of half a sequence or more, half a sequence is cut off, which
lets the linear program end within seconds and with less padding than whole rests would. The histogram of piece lengths, in steps of ``GRAIN`` tokens, is the demand
of a cutting-stock problem: a linear program over patterns, whose columns a knapsack dynamic program prices. The patterns,
rounded down, and a best-fit packing of what rounding leaves, say which lengths go together; pieces are ranked within their
length and take the slots of the patterns by rank. The driver sees the histogram and the patterns, never a piece.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelscore.llm import common as c
from panelscore.session import pin

CAPACITY, GRAIN, END = 2048, 8, 1
#: Tokens whose ids a worker remembers; beyond it only those of its last texts stay.
REMEMBERED = 400_000
_MARKS = ".,;:!?"
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts, each distinct word encoded once.

    The tokenizer splits at white space and between a letter and a run of marks, so the ids of a text are those of its
    pieces one after the other. Words of letters only are encoded many at a time; the ids that end a word part them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.tokens: dict[str, int] = {}
        self.flat, self.first, self.made_of = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros((0, 2), np.int64)
        self.parts: dict[str, int] = {"": 0}
        self.part_flat, self.part_first = np.zeros(0, np.uint32), np.zeros(2, np.int64)
        self.last: list[str] = []

    def _forget(self) -> None:
        """Keep the tokens of the last texts only, and their parts."""
        slots = np.fromiter(map(self.tokens.__getitem__, self.last), np.int64, len(self.last))
        used, made_of = np.unique(self.made_of[slots], return_inverse=True)
        used, made_of = (used, made_of) if len(used) and used[0] == 0 else (np.concatenate(([0], used)), made_of + 1)
        names = list(self.parts)
        self.parts = {names[k]: n for n, k in enumerate(used.tolist())}
        self.tokens = dict(zip(self.last, range(len(slots)), strict=True))
        self.made_of = made_of.reshape(-1, 2)
        self.flat, sizes = _gather(self.flat, self.first, slots)
        self.part_flat, part_sizes = _gather(self.part_flat, self.part_first, used)
        self.first, self.part_first = (np.concatenate(([0], np.cumsum(x))) for x in (sizes, part_sizes))

    def _learn(self, words: list[str]) -> None:
        """Remember new parts of tokens by their ids."""
        plain = [w for w in words if w.isalpha()]
        odd = [w for w in words if not w.isalpha()]
        ids, sizes, order = [], [], []
        for low in range(0, len(plain), 1000):
            part = plain[low : low + 1000]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[got]) + 1
            if len(stops) != len(part) or stops[-1] != len(got):
                odd += part
                continue
            ids.append(got)
            sizes.append(np.diff(stops, prepend=0))
            order += part
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
        ids.append(np.fromiter(chain.from_iterable(lists), np.uint32))
        sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        self.parts.update(zip(order + odd, range(len(self.part_first) - 1, len(self.part_first) - 1 + len(words)), strict=True))
        self.part_flat = np.concatenate([self.part_flat, *ids])
        self.part_first = np.concatenate([self.part_first, self.part_first[-1] + np.cumsum(np.concatenate(sizes))])

    def _meet(self, tokens: pa.Array) -> None:
        """Remember new tokens: the ids of the word, then those of the run of marks that ends it."""
        cores = pc.utf8_rtrim(tokens, _MARKS)
        last = pc.utf8_slice_codeunits(cores, -1).dictionary_encode()
        closed = np.array([bool(x) and _closes(x) for x in last.dictionary.to_pylist()], bool)[last.indices.to_numpy()]
        extra = pc.binary_length(tokens).to_numpy() - pc.binary_length(cores).to_numpy()
        marked = closed & (extra > 0)
        cores = pc.if_else(pa.array(marked), cores, tokens)
        cores = pc.if_else(pc.string_is_ascii(cores), pc.ascii_lower(cores), cores)
        n = len(tokens)
        # Marks are single bytes, and most runs a single mark.
        tails = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(tokens, -1), pa.scalar("", tokens.type))
        longer = marked & (extra > 1)
        if longer.any():
            tails = pc.replace_with_mask(tails, pa.array(longer), pa.array([t[-n:] for t, n in zip(tokens.filter(pa.array(longer)).to_pylist(), extra[longer].tolist(), strict=True)], tokens.type))
        parts = pa.concat_arrays([cores, tails]).dictionary_encode()
        names = _strings(parts.dictionary)
        if new := [w for w in names if w not in self.parts]:
            self._learn(new)
        slots = np.fromiter(map(self.parts.__getitem__, names), np.int64, len(names))[parts.indices.to_numpy()]
        pairs = np.stack((slots[:n], slots[n:]), axis=1)
        ids, sizes = _gather(self.part_flat, self.part_first, pairs.ravel())
        self.made_of = np.concatenate((self.made_of, pairs))
        self.tokens.update(zip(_strings(tokens), range(len(self.first) - 1, len(self.first) - 1 + n), strict=True))
        self.flat = np.concatenate([self.flat, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes[0::2] + sizes[1::2])])

    def encode(self, texts: list[str | None], remembered: int = REMEMBERED) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by END, and where each begins."""
        lists = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        words = lists.flatten().dictionary_encode()
        if len(self.tokens) > remembered:
            self._forget()
        self.last = names = _strings(words.dictionary)
        slots = np.fromiter(map(self.tokens.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = len(self.first) - 1 + np.arange(len(new))
            self._meet(words.dictionary.take(pa.array(new)))
        ids, sizes = _gather(self.flat, self.first, slots[words.indices.to_numpy()])
        stops = np.concatenate(([0], np.cumsum(sizes)))[lists.offsets.to_numpy()]
        ids = np.insert(ids, stops[1:], END)
        return ids.astype("<u4", copy=False), stops + np.arange(len(stops))


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _gather(flat: np.ndarray, first: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices flat[first[s] : first[s + 1]] one after the other, and their sizes."""
    sizes = first[slots + 1] - first[slots]
    ends = np.cumsum(sizes)
    return flat[np.repeat(first[slots] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes


def _closes(char: str) -> bool:
    """Whether a run of marks after this character is a token of its own."""
    return "0" <= char <= "9" or char.isalpha() and len(char.lower()) == 1


def encoder(path: str) -> Encoder:
    """One encoder for each file in a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, rid, start, length, ids_crc32, doc_tokens): full and half sequences, then the rest, of every row of ``docs``."""

    def cut(batches):
        for b in c.text_batches(batches):
            ids, first = encoder(path).encode(b["text"].to_pylist(), remembered)
            out = []
            for i, (d, r) in enumerate(zip(b["doc_id"].to_pylist(), b["rid"].to_pylist(), strict=True)):
                own = memoryview(ids[first[i] : first[i + 1]]).cast("B")
                n = len(own) // 4
                s = 0
                while s < n:
                    m = next(x for x in (capacity, capacity // 2, n - s) if x <= n - s)
                    out.append((d, r, s, m, zlib.crc32(own[4 * s : 4 * (s + m)]), n))
                    s += m
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "rid", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"), "text")
    return rows.mapInArrow(cut, "doc_id long, rid long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the worth and the counts of the best pattern."""
    useful = np.flatnonzero(values > 1e-12)
    counts = np.zeros(len(sizes), np.int64)
    if not len(useful):
        return 0.0, counts
    v, s = values[useful], sizes[useful]  # sizes ascend
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(s[0]), capacity + 1):
        n = np.searchsorted(s, room, side="right")
        worth = best[room - s[:n]] + v[:n]
        i = int(worth.argmax())
        best[room], choice[room] = (worth[i], i) if worth[i] > best[room - 1] else (best[room - 1], -1)
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[useful[choice[room]]] += 1
            room -= int(s[choice[room]])
    return float(best[capacity]), counts


def cutting_stock(demand: dict[int, int], capacity: int, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Patterns (count by size) with the number of times each is used; together they make exactly ``demand``.

    Revised simplex over the generated columns; after ``rounds`` columns the best basis so far is taken.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], np.float64)
    columns = np.diag(capacity // sizes)
    inverse = np.diag(1.0 / (capacity // sizes))
    used = inverse @ need
    for _ in range(rounds):
        worth, column = best_pattern(inverse.sum(0), sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        used = np.maximum(used - ratio[out] * step, 0)
        used[out] = ratio[out]
        inverse[out] /= step[out]
        others = step.copy()
        others[out] = 0
        inverse -= np.outer(others, inverse[out])
        columns[:, out] = column
    whole: Counter = Counter()
    left = need.astype(np.int64)
    for j in np.argsort(-used):
        column = columns[:, j]
        many = int(min([np.floor(used[j] + 1e-6), *(left[column > 0] // column[column > 0])]))
        if many > 0:
            left -= many * column
            whole[tuple(column)] += many
    for key in _best_fit(left, sizes, capacity):
        whole[key] += 1
    return [({int(sizes[i]): int(n) for i, n in enumerate(key) if n}, many) for key, many in whole.items()]


def _best_fit(left: np.ndarray, sizes: np.ndarray, capacity: int):
    """Best-fit decreasing of the pieces that rounding leaves: at most one pattern's worth for each size."""
    rooms: list[int] = []
    bins: list[np.ndarray] = []
    for i in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[i])):
            fits = [(r, j) for j, r in enumerate(rooms) if r >= sizes[i]]
            if fits:
                j = min(fits)[1]
            else:
                j = len(bins)
                rooms.append(capacity)
                bins.append(np.zeros(len(sizes), np.int64))
            rooms[j] -= int(sizes[i])
            bins[j][i] += 1
    return [tuple(b) for b in bins]


def _places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each size, rows (first rank, first sequence, times, first slot) in order of rank."""
    rows: dict[int, list] = {}
    taken: Counter = Counter()
    sequence = 0
    for counts, many in patterns:
        slot = 0
        for size, n in counts.items():
            rows.setdefault(size, []).append((taken[size], sequence, many, slot))
            taken[size] += n * many
            slot += n
        sequence += many
    return {size: np.array(x, np.int64) for size, x in rows.items()}


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, grain: int = GRAIN, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    Every row of ``docs`` is a document, repeated rows and null ids too; a null or empty text is its end id alone. Sequences
    hold at most ``capacity`` ids, offsets are gapless. A worker remembers about ``remembered`` tokens, which saves time and takes
    memory, and changes no result. Other columns are not read; no rows give no pieces.
    """
    spark = docs.sparkSession
    cut = pin(pieces(docs, path, capacity, remembered)).withColumn("size", F.ceil(F.col("length") / grain))
    demand = {r["size"]: r["count"] for r in cut.groupBy("size").count().collect()}
    places = spark.sparkContext.broadcast(_places(cutting_stock(demand, capacity // grain)))

    parts = 4 * c.parallelism(spark)
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("rid", "start"), F.lit(parts)))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("size", "part").count().select("size", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("size", "part").orderBy("doc_id", "rid", "start")
    ranked = dealt.withColumn("own", F.row_number().over(within)).join(base, ["size", "part"])

    def assign(batches):
        for b in batches:
            size, rank = b["size"].to_numpy(), b["rank"].to_numpy()
            sequence, slot = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                rows, mine = places.value[int(s)], size == s
                at = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1]
                past = rank[mine] - at[:, 0]
                sequence[mine], slot[mine] = at[:, 1] + past % at[:, 2], at[:, 3] + past // at[:, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(slot)], names=[*b.schema.names[:5], "sequence_id", "slot"])

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = ranked.select(*kept, "size", (F.col("base") + F.col("own") - 1).alias("rank")).mapInArrow(
        assign, ", ".join(f"{k} long" for k in [*kept, "sequence_id", "slot"])
    )
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*kept, "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(c.table(spark, sf_dir, "documents"), tokenizer_path())
