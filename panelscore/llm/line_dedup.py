"""Line deduplication by pairwise alignment.

Every later holder of a line is paired with the line's first holder, never with all others, so copies by the thousand give
as many pairs as lines, and a line of very many documents one pair for each of them. The same holds for the shortest runs of
short lines that make a block, so that a block is compared with a document that has it as a whole. Each pair is aligned by a patience diff of
its line hashes, and aligned blocks leave the later document; a line long enough to be a block goes with or without alignment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscore.llm import common as c
from panelscore.session import pin

#: Documents that a line may be in to make pairs: any number. Characters of an aligned block at least.
RARE, BLOCK_CHARS = float("inf"), 40
KEY = ("doc_id", "rid")


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))


def block_keys(hashes: np.ndarray, chars: np.ndarray, least: int) -> np.ndarray:
    """Distinct hashes of the lines, and of the shortest run of two lines or more from each line that has so many characters.

    Blank lines (hash 0) are no key and begin no run. Each block of at least so many characters holds such a run or line.
    """
    n = len(hashes)
    total = np.concatenate(([0], np.cumsum(chars)))
    start = np.flatnonzero((hashes != 0) & (chars < least))
    end = np.searchsorted(total, total[start] + least)
    start, end = start[end <= n], end[end <= n]
    up, down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64)))) for x in (_STEP, _BACK))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c.mix(hashes.view(np.uint64)) * up[:n], dtype=np.uint64)))
    runs = c.mix((sums[end] - sums[start]) * down[start]).view(np.int64)
    return np.unique(np.concatenate((hashes[hashes != 0], runs)))


def _unique(lines: list[int], low: int, high: int) -> dict[int, int]:
    place: dict[int, int] = {}
    for i in range(low, high):
        place[lines[i]] = -1 if lines[i] in place else i
    return {x: i for x, i in place.items() if i >= 0}


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs that ascends in both places; the pairs ascend in the first."""
    from bisect import bisect_left

    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back[k] = ends[at - 1] if at else -1
        if at == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences: equal ends first, then the longest ascending run of the lines that are unique in
    both, then the gaps between them in the same way."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        mine, other = _unique(a, a0, a1), _unique(b, b0, b1)
        run = _ascending([(i, other[x]) for x, i in mine.items() if x in other])
        for (i, j), (ni, nj) in zip([(a0 - 1, b0 - 1), *run], [*run, (a1, b1)], strict=True):
            if run and i + 1 <= ni and j + 1 <= nj:
                todo.append((i + 1, ni, j + 1, nj))
        out += run
    return sorted(out)


def common_lines(later: list[int], earlier: list[int], chars: list[int], least: int) -> list[int]:
    """Lines of the later document in aligned blocks of at least so many characters.

    A line of that length is a block by itself, and goes wherever it stands: the diff would leave it where it is repeated or
    comes in another order.
    """
    known = set(earlier)
    out = [i for i, x in enumerate(later) if chars[i] >= max(least, 1) and x in known]
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(later, earlier), (-9, -9)]:
        if (i - 1, j - 1) != last:
            if sum(chars[k] for k in block) >= least:
                out += block
            block = []
        block.append(i)
        last = (i, j)
    return out


def repeated_lines(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, rid, removed): positions of the lines to delete, one row per document that loses any."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), lines.alias("lines"))
    held = pin(
        rows.select(
            *KEY,
            F.transform("lines", lambda x: F.when(F.trim(x) == "", F.lit(0)).otherwise(F.xxhash64(x))).alias("hashes"),
            F.transform("lines", lambda x: F.length(F.trim(x))).alias("chars"),
        ).dropDuplicates(list(KEY))
    )

    def keys(batches):
        for b in batches:
            found = [block_keys(np.array(h, np.int64), np.array(n, np.int64), block_chars) for h, n in zip(b["hashes"].to_pylist(), b["chars"].to_pylist(), strict=True)]
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["rid"], lists], names=["doc_id", "rid", "lines"])

    postings = held.select(*KEY, "hashes", "chars").mapInArrow(keys, "doc_id long, rid long, lines array<long>").select(*KEY, F.explode("lines").alias("line"))
    # Written, so that the join below has an exchange on either side and a line of very many documents can be split there.
    first = pin(postings.groupBy("line").agg(F.min(F.struct(*KEY)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    pairs = (
        postings.join(first, "line")
        .where("doc_id <> first.doc_id or rid <> first.rid")
        .select(*KEY, F.col("first.doc_id").alias("first_id"), F.col("first.rid").alias("first_rid"))
        .distinct()
    )
    earlier = held.select(F.col("doc_id").alias("first_id"), F.col("rid").alias("first_rid"), F.col("hashes").alias("first_hashes"))
    both = pairs.join(held, list(KEY)).join(earlier, ["first_id", "first_rid"]).select(*KEY, "hashes", "chars", "first_hashes")

    def align(batches):
        for b in batches:
            columns = (b[x].to_pylist() for x in ("hashes", "first_hashes", "chars"))
            found = [common_lines(a, e, n, block_chars) for a, e, n in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["rid"], pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "rid", "removed"])

    cut = both.mapInArrow(align, "doc_id long, rid long, removed array<int>").where("size(removed) > 0")
    return cut.groupBy(*KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))


def _cut(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as (row, own_id, removed); removed is null where nothing goes."""
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_rid"))
    return own.join(removed, (F.col("own_id") == F.col("doc_id")) & (F.col("own_rid") == F.col("rid")), "left").select("row", "own_id", "removed")


def _left(text: str | None, removed: list[int] | None) -> tuple[list[str], int]:
    lines = [] if text is None else text.split("\n")
    if not removed:
        return lines, 0
    keep = np.ones(len(lines), bool)
    keep[removed] = False
    return [x for x, k in zip(lines, keep.tolist(), strict=True) if k], len(removed)


def drop_repeated_lines(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with repeated blocks of lines deleted from the later document, all columns kept.

    Documents come in the order of (id, hash of text); rows that share both are one document and get the same text. Rows with
    a null id cannot be ordered: they stay whole and are no reference. Null and empty texts stay as they are; blank lines
    never pair documents. A document of which nothing but blank lines is left is dropped. Judged on the input throughout. A column
    ``n_chars`` follows the text where it changes.
    """
    names = docs.columns
    at, counted = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    joined = _cut(docs, repeated_lines(docs, block_chars)).select("row.*", "removed")
    joined = joined.toDF(*[f"c{i}" for i in range(len(names))], "removed")

    def rewrite(batches):
        for b in c.text_batches(batches, text=at):
            out = []
            for text, removed in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                left, n = _left(text, removed)
                out.append(text if not n else "\n".join(left))
            keep = pa.array([not r or bool(t.strip()) for t, r in zip(out, b.column(len(names)).to_pylist(), strict=True)], pa.bool_())
            columns = b.columns[:-1]
            columns[at] = pa.array(out, b.schema.field(at).type)
            if counted is not None:
                sizes = zip(b.column(counted).to_pylist(), b.column(at).to_pylist(), out, strict=True)
                columns[counted] = pa.array([n if new == old else len(new) for n, old, new in sizes], b.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1]).filter(keep)

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return joined.mapInArrow(rewrite, schema).toDF(*names)


def count_repeated_lines(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) for each row; a null text has no lines."""
    joined = _cut(docs.select("doc_id", "text"), repeated_lines(docs, block_chars)).select("own_id", "row.text", "removed")

    def count(batches):
        for b in c.text_batches(batches):
            found = [(*_left(t, r), t) for t, r in zip(b["text"].to_pylist(), b["removed"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b["own_id"],
                    pa.array([len(x) + n for x, n, _ in found], pa.int64()),
                    pa.array([n for _, n, _ in found], pa.int64()),
                    pa.array([c.sha("\n".join(x).encode()) for x, _, _ in found], pa.string()),
                ],
                names=["doc_id", "n_lines", "n_removed", "kept_sha256"],
            )

    return joined.mapInArrow(count, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_repeated_lines(c.table(spark, sf_dir, "documents"))
