"""Vectorised words, rolling hashes and packed hash lists shared by the text operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_SEED = np.random.default_rng(20240229)
_BYTE_VALUE = _SEED.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_STEP = U64(0xC2B2AE3D27D4EB4F)


#: Rows that go to a Python worker at once; the default of ten thousand whole texts takes tens of MB on either side.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3, F.lit(0))


def drawn(draw: Column, bound: Column | int) -> Column:
    """Whether a 64-bit hash falls within a share of all hashes, given as ``hash_bound``."""
    return draw.bitwiseAND(F.lit(2**62 - 1)) < bound


def hash_bound(wanted: int, count: int) -> int:
    """The bound for about ``wanted`` of ``count`` rows, in whole numbers of 2^-62: it does not vanish for any count."""
    return 2**62 if wanted >= count else 2**62 * wanted // count


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """256 flags: True for bytes of a word, False for those inside one of the separator spans."""
    flags = np.ones(256, bool)
    for low, high in spans:
        flags[low : high + 1] = False
    return flags


#: Words of the contracts: all but ASCII white space; letters, digits and everything beyond ASCII.
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of products lose their structure."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes], word: np.ndarray, lower: bool = False, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and where each text's words begin (one more entry than texts).

    Works through slices of ``limit`` bytes, or of one text: the arrays per byte are many times as large as the text.
    """
    parts, begins, done = [], [np.zeros(1, np.int64)], 0
    start, held = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (i > start and held + len(texts[i]) > limit):
            hashes, offsets = _word_hashes(texts[start:i], word, lower)
            parts.append(hashes)
            begins.append(offsets[1:] + done)
            done += len(hashes)
            start, held = i, 0
        held += len(texts[i]) if i < len(texts) else 0
    return np.concatenate(parts), np.concatenate(begins)


def _word_hashes(texts: list[bytes], word: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    if lower:
        joined = ASCII_LOWER[joined]
    flags = word[joined]
    edges = np.flatnonzero(np.diff(flags.view(np.int8), prepend=0, append=0))
    starts, ends = edges[0::2], edges[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    if not len(starts):
        return np.zeros(0, U64), offsets
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    values = _BYTE_VALUE[joined[flags]] * _powers(_BASE, int(lengths.max()))[place]
    return mix(np.add.reduceat(values, first)), offsets


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[p : p + n] for each p, by doubling; shorter than words by n - 1."""
    if len(words) < n:
        return np.zeros(0, U64)
    out, have = words, 1
    for bit in bin(n)[3:]:
        out = out[: len(out) - have] + out[have:] * _powers(_STEP, have + 1)[have]
        have *= 2
        if bit == "1":
            out = out[:-1] + words[have : have + len(out) - 1] * _powers(_STEP, have + 1)[have]
            have += 1
    return mix(out)


def inside(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """Flags of the positions at which n words lie within one text; as long as rolling()'s result."""
    size = max(total - n + 1, 0)
    edge = np.zeros(total + 1, np.int64)
    ends = offsets[1:]
    np.add.at(edge, np.maximum(np.maximum(ends - n + 1, offsets[:-1]), 0), 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge)[:size] == 0


def covered(marks: np.ndarray, n: int, total: int) -> np.ndarray:
    """Flags of the words that lie in a marked window of n words."""
    edge = np.zeros(total + 1, np.int64)
    at = np.flatnonzero(marks)
    edge[at] += 1
    np.subtract.at(edge, at + n, 1)
    return np.cumsum(edge)[:total] > 0


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def pack(values: np.ndarray) -> bytes:
    """A sorted uint64 array as compressed bytes: differences, byte planes, zstandard."""
    steps = np.diff(values, prepend=U64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(U64), dtype=U64)


def pack_ids(values: np.ndarray) -> bytes:
    """Any int64 array: byte planes, zstandard."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_ids(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.int64)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [b"" if t is None else t.encode() for t in column.to_pylist()]


def _trimmer():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


_trim: list = []


def give_back() -> None:
    """Return memory that a worker has freed: several live beside the JVM, and what one task needed stays with it otherwise."""
    if not _trim:
        _trim.append(_trimmer())
    pa.default_memory_pool().release_unused()
    _trim[0](0)


def text_batches(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20, text: str | int = "text") -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text, or of one row; what they took is given back now and then, and at the end."""
    passed = 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            n = n or 0
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
        passed += sum(n or 0 for n in sizes)
        if passed > 8 * limit:
            give_back()
            passed = 0
    give_back()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column; one pass that combines before the shuffle."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]
