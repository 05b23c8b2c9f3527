"""Near-duplicate documents by circulant MinHash.

Two permutations of the 32-bit numbers make a whole signature: the first scatters a document's shingles, the second, shifted
circularly by another step for each coordinate, orders them; a coordinate is the least place. Signatures are cut into bands,
texts that agree in a band share a bucket. Each text of a bucket is first held against one of its texts only. Buckets whose
texts are linked by that are done; in the others all pairs of texts that are not yet linked are looked at, tile by tile.
Every link is confirmed by exact counts over whole shingle sets, no pairs but those are kept that links need.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscore.llm import common as c
from panelscore.llm.graph import components
from panelscore.session import pin

WORDS, PERCENT = 5, 85
#: 32 bands of 5 coordinates miss a pair of similarity 0.85 with a probability of 7e-9, less above it.
BANDS, ROWS = 32, 5
#: Texts, and shingles, of a tile's side.
SIDE, SIDE_SHINGLES = 256, 500_000
#: Texts by key are sent to all tasks up to so many keys, to leave other texts where they are.
SENT_KEYS = 500_000
_SHIFT = np.uint32(0x9E3779B9)
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32) * _SHIFT
#: Stands for the sides that comps share.
_SHARED = bytearray(b"")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers: xor of higher bits and products with odd numbers can be undone. Changes x."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signature(grams: np.ndarray) -> np.ndarray:
    """BANDS * ROWS least places of shingle hashes; at least one is needed."""
    scattered = _permute((grams >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.full(len(_SHIFTS), np.iinfo(np.uint32).max, np.uint32)
    for low in range(0, len(scattered), 256):
        shifted = scattered[low : low + 256, None] + _SHIFTS
        np.minimum(out, _permute(shifted, 0x21F0AAAD, 0xD35A2D97).min(0), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    parts = sig.astype(np.uint64).reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = c.mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return h.view(np.int64)


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Distinct hashes of n consecutive words; of fewer words the hash of them all."""
    return np.unique(c.rolling(words, min(n, len(words)))) if len(words) else np.zeros(0, np.uint64)


def _named(batches, n: int):
    """(batch, row, name of its words, shingles) of rows with words; equal names mean equal words (a cryptographic digest)."""
    for b in c.text_batches(batches):
        texts = c.as_bytes(b["text"])
        hashes, offsets = c.word_hashes(texts, c.NOT_SPACE, lower=True)
        for i, text in enumerate(texts):
            if offsets[i] < offsets[i + 1]:
                name = hashlib.sha256(b" ".join(_WORD.findall(text.lower()))).digest()[:16]
                yield b, i, name, shingles(hashes[offsets[i] : offsets[i + 1]], n)
            else:
                yield b, i, None, np.zeros(0, np.uint64)


def _flushed(rows, schema: pa.Schema, size: int = 500):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def enough(common, x, y, percent: int):
    """Whether sets of x and y elements with so many in common reach the similarity, in whole numbers."""
    return 100 * common >= percent * (x + y - common)


def _sets(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(class, grams): the shingle set of each class in ``wanted`` (class, key), from the rows that have its key."""
    schema = pa.schema([("class", pa.binary()), ("grams", pa.binary())])

    def build(batches):
        yield from _flushed(((name, g.tobytes()) for _, _, name, g in _named(batches, n) if name), schema)

    keys = wanted.select("key").distinct()
    keys = F.broadcast(keys) if keys.count() <= SENT_KEYS else keys
    found = rows.join(keys, "key", "left_semi").select("text").mapInArrow(build, "class binary, grams binary")
    # One row of a class: several rows can share its key.
    return found.join(wanted.select("class"), "class", "left_semi").groupBy("class").agg(F.first("grams").alias("grams"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar enough."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def count(batches):
        for b in batches:
            good = []
            for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(bool(enough(common, len(x), len(y), percent)))
            yield b.select(["a", "b"]).filter(pa.array(good)).cast(schema)

    left = sets.select(F.col("class").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("grams").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(count, "a binary, b binary")


def _spanning(n: int, groups: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join what is not joined yet, by ``groups`` or earlier pairs."""
    root = list(range(n))
    first: dict = {}
    for k, g in enumerate(groups.tolist()):
        root[k] = first.setdefault(g, k)

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append((i, j))
    return out


def similar(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (one of left, one of right) of similar sets, counted by products over slices of the shingles that several have."""
    used = np.union1d(left, right)
    sizes = np.array([len(g) for g in grams])
    values, code, times = np.unique(np.concatenate([grams[u] for u in used]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(used)), sizes[used])
    shared = times[code] > 1
    code, owner = (np.cumsum(times > 1) - 1)[code[shared]], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    l, r = np.searchsorted(used, left), np.searchsorted(used, right)
    common = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        a, b = np.searchsorted(code, [low, low + 4096])
        x = np.zeros((len(used), 4096), np.float32)
        x[owner[a:b], code[a:b] - low] = 1
        common += x[l] @ x[r].T
    good = enough(common.astype(np.int64), sizes[left][:, None], sizes[right], percent)
    i, j = np.nonzero(good)
    i, j = left[i], right[j]
    return np.stack((i[i != j], j[i != j]), axis=1)


def _tiles(members: DataFrame, sets: DataFrame, percent: int, cells: int) -> DataFrame:
    """Links (a, b) between classes of different ``comp`` in one ``unit``; a unit is cut into sides, two sides are a tile.

    A side holds classes of one ``comp`` or of several: the comp that spreads over more than one side has sides of its own,
    so that a tile of two such sides of one comp, which cannot have a new link, is left out.
    """
    count, words = F.count(F.lit(1)), F.sum("n_shingles")
    sides = lambda: F.greatest(F.ceil(count / SIDE), F.ceil(words / SIDE_SHINGLES)).cast("long")
    own = members.groupBy("unit", "comp").agg(sides().alias("sides"), count.alias("n"), words.alias("n_shingles"))
    # Comps that fit a side share the sides of the rest of their unit.
    rest = own.where("sides = 1").groupBy("unit").agg(F.greatest(F.ceil(F.sum("n") / SIDE), F.ceil(F.sum("n_shingles") / SIDE_SHINGLES)).cast("long").alias("shared"))
    large = own.where("sides > 1").select("unit", "comp", "sides")
    placed = members.join(large, ["unit", "comp"], "left").join(rest, "unit", "left")
    mine = lambda n: F.pmod(F.xxhash64("class"), n)
    placed = pin(
        placed.select(
            "unit", "class", "comp",
            F.when(F.col("sides").isNotNull(), F.col("comp")).otherwise(F.lit(_SHARED)).alias("kind"),
            F.when(F.col("sides").isNotNull(), mine(F.col("sides"))).otherwise(mine(F.col("shared"))).alias("side"),
        )
    )
    every = placed.select("unit", "kind", "side").distinct()
    other = every.select("unit", F.col("kind").alias("kind2"), F.col("side").alias("side2"))
    me, it = F.struct("kind", "side"), F.struct("kind2", "side2")
    tiles = every.join(other, "unit").where((F.struct("kind", "side") <= F.struct("kind2", "side2")) & ((F.col("kind") != F.col("kind2")) | (F.col("kind") == F.lit(_SHARED))))
    tiles = tiles.withColumn("tile", F.xxhash64("unit", "kind", "side", "kind2", "side2"))
    ends = tiles.select("unit", "tile", "kind", "side", F.lit(True).alias("first")).union(
        tiles.where(me != it).select("unit", "tile", F.col("kind2").alias("kind"), F.col("side2").alias("side"), F.lit(False).alias("first"))
    )
    cell = F.when(F.col("alone"), F.col("tile")).otherwise(F.pmod("unit", F.lit(cells)))
    many = every.groupBy("unit").agg((F.count(F.lit(1)) > 1).alias("alone"))
    dealt = placed.join(ends.join(many, "unit"), ["unit", "kind", "side"]).select("class", "comp", "unit", "tile", "first", cell.alias("cell"))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found: dict[int, list] = {}
        columns = (table[k].to_pylist() for k in ("unit", "tile", "class", "comp", "first", "grams"))
        for unit, tile, *row in zip(*columns, strict=True):
            found.setdefault((unit, tile), []).append(row)
        out = []
        for rows in found.values():
            names, comps, first, data = zip(*rows, strict=True)
            grams = [np.frombuffer(d, np.uint64) for d in data]
            groups = np.unique(np.array([x.hex() for x in comps]), return_inverse=True)[1]
            first = np.array(first)
            left, right = np.flatnonzero(first), np.flatnonzero(~first)
            pairs = similar(grams, left, right if len(right) else left, percent)
            out += [(names[i], names[j]) for i, j in _spanning(len(names), groups, pairs)]
        columns = list(zip(*out, strict=True)) if out else [[], []]
        return pa.table([pa.array(x, pa.binary()) for x in columns], schema=schema)

    return dealt.join(sets, "class").groupBy("cell").applyInArrow(solve, "a binary, b binary")


def _units(buckets: DataFrame) -> DataFrame:
    """(unit, class): buckets (band, class, least) as units, or all buckets that hang together as one where that is less work."""
    whole = components(buckets.where("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b")))
    placed = buckets.join(whole.select(F.col("node").alias("class"), "label"), "class")
    size = placed.groupBy("label", "band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("who"))
    # Buckets of the same classes count once.
    size = size.groupBy("label", "n", "who").agg(F.min("band").alias("band"))
    each = size.groupBy("label").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("cost"))
    classes = whole.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    together = classes.join(each, "label").select("label", (F.col("n").cast("double") * F.col("n") <= F.col("cost")).alias("together"))
    kept = size.join(together, "label")
    alone = placed.select("band", "class").join(kept.where("not together").select("band"), "band").select(F.col("band").alias("unit"), "class")
    joined = whole.join(together.where("together"), "label").select(F.xxhash64("label").alias("unit"), F.col("node").alias("class"))
    return alone.union(joined)


def _key(column: Column) -> Column:
    """An id to join on; null is a value of its own."""
    return F.coalesce(column, F.lit(-(2**63)))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs``.

    Documents are linked if their sets of ``words``-word shingles (of fewer words: the whole sequence) have a Jaccard similarity
    of ``percent`` or more; words are what ASCII white space parts, A-Z lower-cased. ``component_id`` is the smallest doc_id that
    is reached over links, the own included. Null, empty and blank texts have no shingles, stay on their own and are kept. Rows
    that repeat, and equal word sequences, are linked; all rows with the smallest id are kept. A null id is never the smallest,
    unless there is no other in its component: then component_id is null and its rows are kept. Very long texts are hashed as
    a whole, in slices by bytes. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sketch(batches):
        yield from _flushed(((b["doc_id"][i].as_py(), len(g), name, bands(signature(g)) if name else None) for b, i, name, g in _named(batches, words)), schema)

    sketches = pin(rows.mapInArrow(sketch, "doc_id long, n_shingles long, class binary, bands array<long>"))
    classes = sketches.where("class is not null").groupBy("class")
    classes = pin(classes.agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    banded = classes.select("class", F.explode("bands").alias("band"))
    shared = pin(banded.groupBy("band").agg(F.min("class").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    buckets = pin(banded.join(shared, "band"))
    facts = classes.select("class", _key(F.col("least_id")).alias("key"), "n_shingles")
    sets = pin(_sets(rows.withColumn("key", _key(F.col("doc_id"))), facts.join(buckets.select("class").distinct(), "class"), words))
    links = pin(_confirm(buckets.where("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b")).distinct(), sets, percent))

    reached = components(links).select(F.col("node").alias("class"), F.col("label").alias("comp"))
    held = buckets.where("n > 2").join(reached, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    split = held.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band")
    open_ = pin(held.join(split, "band").select("band", "class", "least"))
    if not open_.isEmpty():
        members = _units(open_).join(reached, "class", "left").withColumn("comp", F.coalesce("comp", "class")).join(facts.drop("key"), "class")
        links = links.union(pin(_tiles(pin(members), sets, percent, 4 * c.parallelism(spark))))
    linked = components(links).withColumnRenamed("node", "class")
    named = pin(classes.select("class", "least_id").join(linked, "class", "left"))
    least = named.where("label is not null").groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_class = named.join(least, "label", "left").select("class", F.when(F.col("label").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"))
    return sketches.select("doc_id", "n_shingles", "class").join(of_class, "class", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: Copies first, then pairs that share a shingle; the components by least ids, until they no longer change.
ORACLE = r"""
WITH RECURSIVE doc AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
shingle AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS s FROM (SELECT r, w, unnest(range(greatest(len(w) - 4, least(len(w), 1)))) AS i FROM doc)),
size AS (SELECT r, count(*) AS n FROM shingle GROUP BY r),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.s = y.s AND x.r <> y.r GROUP BY ALL)
  JOIN size p ON p.r = a JOIN size q ON q.r = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT r AS a, r AS b FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(e.doc_id) AS component_id, d.doc_id IS NOT DISTINCT FROM min(e.doc_id) AS kept
FROM doc d LEFT JOIN size USING (r) JOIN reach ON reach.a = d.r JOIN doc e ON e.r = reach.b GROUP BY d.r, d.doc_id
"""


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents`` at a similarity of 0.85 over five-word shingles.

    Texts without words stay on their own and are kept; ids may repeat or be null as in near_duplicates.
    """
    return near_duplicates(c.table(spark, sf_dir, "documents"))
