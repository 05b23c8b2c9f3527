"""Periodic runs of words, found with longest common extensions from a difference cover.

A run with period q and at least e periods makes words q apart equal over a stretch of (e - 1) * q places, so every run shows
at one of the places 0, g, 2g, ... with g = (e - 1) * q: this grid, harmonic in q, has n log n places in all. Places that pass
a look at a few words are extended both ways by longest common extension: suffixes at the places of a difference cover alone
are sorted, two places compare fewer words than the cover's period until both stand in the cover, and a sparse table of range
minima over neighbours' common prefixes gives the rest. Left extensions use the reversed words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscore.llm import common as c

#: A run has at least so many periods, and words.
PERIODS, LEAST = 4, 6
#: The cover's period, a square; and the words looked at on either side of a grid place before it is extended.
COVER, LOOK = 64, 8
#: Grid places that are looked at together.
PLACES = 1 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Extensions:
    """Longest common extensions to the right within ``words``, whose last word occurs nowhere else."""

    def __init__(self, words: np.ndarray, period: int = COVER):
        root = isqrt(period)
        self.words, self.period = words, period
        cover = np.unique(np.concatenate((np.arange(root), np.arange(0, period, root))))
        self.index = np.full(period, -1)
        self.index[cover] = np.arange(len(cover))
        # For each difference d modulo the period, a cover place a such that a + d is one too.
        self.meet = np.array([next(a for a in cover.tolist() if self.index[(a + d) % period] >= 0) for d in range(period)])
        self.width = len(cover)
        starts = np.arange(0, len(words), period)
        places = (starts[:, None] + cover).ravel()
        places = places[places < len(words)]
        self._sort(places)

    def _sort(self, places: np.ndarray) -> None:
        padded = np.concatenate((self.words.astype(">u4"), np.zeros(self.period, ">u4")))
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.period)
        heads = np.ascontiguousarray(windows[places]).view(np.dtype((np.void, 4 * self.period))).ravel()
        rank = np.unique(heads, return_inverse=True)[1].astype(np.int64)
        del heads
        n, step, ranks = len(places), self.width, [rank]
        while n > 1 and int(rank.max()) < n - 1:
            ahead = np.zeros(n, np.int64)
            ahead[: max(n - step, 0)] = rank[step:] + 1
            rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
            ranks.append(rank)
            step *= 2
        self.rank = rank
        order = np.argsort(rank)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            # Equal ranks: the next period * 2^k words are the same.
            inside = np.maximum(a, b) < n
            same = np.zeros(len(a), bool)
            same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
            common[same] += self.period << k
            a[same] += self.width << k
            b[same] += self.width << k
        inside = np.flatnonzero(np.maximum(a, b) < n)
        for low in range(0, len(inside), 1 << 14):
            at = inside[low : low + (1 << 14)]
            common[at] += (windows[places[a[at]]] != windows[places[b[at]]]).argmax(1)
        self.table = [common.astype(np.int32)]
        while 2 << (len(self.table) - 1) <= len(common):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words from i and j on, for i < j."""
        ahead = (self.meet[(j - i) % self.period] - i) % self.period
        out = np.zeros(len(i), np.int64)
        alive = np.arange(len(i))
        while True:
            alive = alive[out[alive] < ahead[alive]]
            if not len(alive):
                break
            alive = alive[self.words[i[alive] + out[alive]] == self.words[j[alive] + out[alive]]]
            out[alive] += 1
        met = np.flatnonzero(out == ahead)
        if len(met):
            x, y = (self.rank[p // self.period * self.width + self.index[p % self.period]] for p in (i[met] + ahead[met], j[met] + ahead[met]))
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp(high - low)[1] - 1
            least = np.empty(len(met), np.int64)
            for k in np.unique(level).tolist():
                at = np.flatnonzero(level == k)
                least[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
            out[met] += least
        return out


def _matching(words: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """Equal words from i and j on in one direction, LOOK at most."""
    out = np.zeros(len(i), np.int64)
    alive = np.arange(len(i))
    for k in range(LOOK):
        alive = alive[words[i[alive] + k * step] == words[j[alive] + k * step]]
        if not len(alive):
            break
        out[alive] += 1
    return out


def _grid(sizes: np.ndarray, periods: int, least: int):
    """Slices of (text, period, place) over the grids of all texts."""
    most = np.where(sizes >= least, sizes // periods, 0)
    done = np.cumsum(most)
    total = int(done[-1]) if len(done) else 0
    for low in range(0, total, PLACES):
        entry = np.arange(low, min(low + PLACES, total))
        text = np.searchsorted(done, entry, side="right")
        q = entry - (done[text] - most[text]) + 1
        count = -(-(sizes[text] - q) // ((periods - 1) * q))
        upto = np.cumsum(count)
        at = 0
        while at < len(entry):
            before = int(upto[at - 1]) if at else 0
            end = max(int(np.searchsorted(upto, before + PLACES, side="right")), at + 1)
            own = np.repeat(np.arange(at, end), count[at:end])
            place = (np.arange(len(own)) + before - (upto - count)[own]) * (periods - 1) * q[own]
            yield text[own], q[own], place
            at = end


def runs(texts: list[np.ndarray], periods: int = PERIODS, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each text, given as word numbers below 2^31, all runs (start, length, smallest period) by start, then period.

    A run has at least ``periods`` times its period and ``least`` words, and no neighbouring word extends it.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(texts) or sizes.max() < least:
        return out
    words, begin = _joined(texts)
    hits = []
    for text, q, place in _grid(sizes, periods, least):
        i = begin[text] + place
        same = np.flatnonzero(words[i] == words[i + q])
        text, q, i = text[same], q[same], i[same]
        # The stretch of equal words around the place is long; LOOK words of it, or half of it, lie on one side.
        need = np.minimum(-(-np.maximum((periods - 1) * q, least - q) // 2), LOOK)
        good = np.flatnonzero(_matching(words, i, i + q, 1) >= need)
        rest = np.setdiff1d(np.arange(len(i)), good, assume_unique=True)
        good = np.concatenate((good, rest[_matching(words, i[rest], i[rest] + q[rest], -1) >= need[rest]]))
        hits.append(np.stack((text[good], q[good], i[good] - begin[text[good]])))
    text, q, place = np.concatenate(hits, axis=1)
    if not len(text):
        return out
    # Only texts with such places are sorted.
    kept = np.unique(text)
    words, begin = _joined([texts[k] for k in kept.tolist()])
    text = np.searchsorted(kept, text)
    i = begin[text] + place
    right = Extensions(words)(i, i + q)
    left = Extensions(words[::-1].copy())(len(words) - i - q, len(words) - i)
    start, length = place - left, left + right + q
    long = np.flatnonzero(length >= np.maximum(periods * q, least))
    found = np.unique(np.stack((text[long], start[long], length[long], q[long])), axis=1)
    # The same stretch also shows with multiples of its period; the smallest comes first.
    first = np.ones(found.shape[1], bool)
    first[1:] = (found[:3, 1:] != found[:3, :-1]).any(0)
    t, s, n, p = found[:, first]
    for k in np.lexsort((p, s, t)).tolist():
        out[int(kept[t[k]])].append((int(s[k]), int(n[k]), int(p[k])))
    return out


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each between two words of their own, and where each begins."""
    top = 1 + max(int(t.max()) if len(t) else 0 for t in texts)
    parts = [np.array([top], np.int64)]
    for k, t in enumerate(texts, 1):
        parts += [t, np.array([top + k], np.int64)]
    begin = np.cumsum([1] + [len(t) + 1 for t in texts[:-1]])
    return np.concatenate(parts).astype(np.uint32), begin


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that are in no run behind its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def find_runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, periods: int = PERIODS, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of every row's words, by start and period, and the text without repetitions.

    Words are what ASCII white space parts, compared byte by byte. ``rewrite`` may change a row's words first. A null, empty or
    blank text has no words, no runs and an empty collapsed text; a null id stays null; rows that repeat give repeated rows; no
    rows give none. Texts are sliced by bytes, one very long text is a slice of its own. Other columns are not read.
    """

    def solve(batches):
        for b in c.text_batches(batches):
            ids = b["doc_id"].to_pylist()
            words = [_WORD.findall(t) for t in c.as_bytes(b["text"])]
            if rewrite:
                words = [rewrite(d, w) for d, w in zip(ids, words, strict=True)]
            known: dict[bytes, int] = {}
            number = known.setdefault
            coded = [np.array([number(w, len(known)) for w in row], np.int64) for row in words]
            found = runs(coded, periods, least)
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"],
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": p} for s, n, p in row] for row in found], _RUNS),
                    pa.array([b" ".join(collapsed(w, row)).decode() for w, row in zip(words, found, strict=True)], pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(solve, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The rewriting of the contract: in one of ten documents, by the crc32 of its id, the words from some place on repeat."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


#: crc32 of the decimal id, bit by bit; equal words at most a quarter of the text apart, by stretches of one distance.
ORACLE = r"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words,
    xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda d: list_transform(range(8), lambda k: CAST((ascii(d) >> k) & 1 AS BIGINT)))),
      lambda c, b: CASE WHEN (c & 1) <> b THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS h
  FROM documents),
tail AS (SELECT *, len(words) AS n, coalesce(h % 10 = 0, false) AND len(words) > 0 AS again, (h // 10) % greatest(len(words), 1) AS a FROM doc),
part AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM tail),
word AS (
  SELECT r, n, i, CASE WHEN again AND i >= a THEN words[a + (i - a) % p + 1] ELSE words[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM part)),
same AS (SELECT x.r, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
stretch AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM same) GROUP BY r, q, g
  HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT r, start, length, min(q) AS period FROM stretch GROUP BY ALL),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM word
  WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.r = word.r AND i >= start + period AND i < start + length) GROUP BY r),
best AS (
  SELECT r, count(*) AS n_runs, min(struct_pack(n := -length, s := start, p := period)) AS b,
    sha256(string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period)) AS runs_sha256
  FROM run GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, -b.n AS length, b.p AS period, (-1000 * b.n) // b.p AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM doc LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all ``documents`` as digests: the count, the longest run, all runs and the collapsed text.

    A null text has no words; a row without a run has nulls for the longest one, and the digests of an empty list and of its
    whole text. Rows without an id are taken as they are.
    """
    found = find_runs(c.table(spark, sf_dir, "documents"), repeat_tail)
    order = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period")))), "\n")
    best = F.col("best")
    return found.withColumn("best", order).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        (-best["n"]).alias("length"),
        best["period"].alias("period"),
        F.expr("(-1000 * best.n) div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
