"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is lower-cased, everything but letters becomes one space, and all its 1- to 3-grams of characters are hashed into
``BUCKETS`` embeddings; their mean feeds a softmax. Embeddings and softmax are trained together by stochastic gradient
descent in numpy on a bounded sample, with one class more: text of no language, made from the sample by moving and exchanging
letters. Part of the sample is kept for a temperature and for the threshold beyond which a text is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscore.llm import common as c

BUCKETS = 1 << 14
#: Training rows per language. The driver holds at most this many sparse count vectors of BUCKETS entries each.
PER_LANGUAGE = 500
#: How much worse it is to reject a text of a learned language than to keep one of none.
KEEPING = 20.0
UNKNOWN = "und"
SPACE = 32
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once in a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def subwords(text: str) -> np.ndarray:
    """Bucket of each 1- to 3-gram of a text; empty if it has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[code]
    if not letter.any():
        return np.zeros(0, np.uint32)
    kept = np.where(letter, code, SPACE)[letter | np.append(True, letter[:-1])]
    kept = np.concatenate((np.full(1, SPACE, np.uint32), kept, np.full(1, SPACE, np.uint32))).astype(np.uint32)
    out, h = [], np.zeros(len(kept), np.uint32)
    for n in range(3):
        h = (h[: len(kept) - n] + kept[n:]) * _MULTIPLIERS[n]
        out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(18))
    return np.concatenate(out)


@dataclass
class Model:
    """Languages and, for each bucket, what it adds to each language's logit (embedding times softmax weights)."""

    langs: list[str]
    #: One column for each language and a last one for text of none.
    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    temperature: float = 1.0
    threshold: float = 1.0

    def logits(self, grams: np.ndarray) -> np.ndarray:
        if len(grams) < BUCKETS // 4:
            total = self.table[grams].sum(0)
        else:
            total = np.bincount(grams, minlength=BUCKETS).astype(np.float32) @ self.table
        return total / len(grams) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        grams = subwords(text or "")
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0, True
        p = softmax(self.logits(grams)[None] / self.temperature)[0]
        best = int(p[:-1].argmax())
        return self.langs[best], float(min(p[best] / max(p[:-1].sum(), 1e-30), 1.0)), bool(p[-1] > self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (at, n) in enumerate(rows):
        x[i, at] = n / n.sum()
    return x


def fit(rows: list[tuple[str, bool, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 12, rate: float = 60.0, seed: int = 7) -> Model:
    """Train on (language or UNKNOWN, whether it is a whole text, buckets, counts); one text in five, with all that was made
    of it, is kept from training and calibrates.

    Rows of one text stand one after the other, its whole first. Whole texts set the temperature; the threshold is the one that
    loses least, with the share of whole texts that it rejects counted KEEPING times.
    """
    langs = sorted({r[0] for r in rows} - {UNKNOWN})
    if not langs:
        return Model([])
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(r[0]) if r[0] != UNKNOWN else len(langs) for r in rows])
    text = np.cumsum([r[1] for r in rows]) - 1
    kept = rng.permutation(text[-1] + 1)[: max(1, (text[-1] + 1) // 5)]
    held = np.flatnonzero(np.isin(text, kept))
    train = np.flatnonzero(~np.isin(text, kept)) if text[-1] else held
    embed = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    weight, bias = rng.normal(0, 0.3, (dim, len(langs) + 1)).astype(np.float32), np.zeros(len(langs) + 1, np.float32)
    steps = epochs * -(-len(train) // 32)
    done = 0
    for _ in range(epochs):
        train = rng.permutation(train)
        for low in range(0, len(train), 32):
            pick = train[low : low + 32]
            x = _dense([rows[i][2:] for i in pick])
            h = x @ embed
            g = softmax(h @ weight + bias)
            g[np.arange(len(pick)), y[pick]] -= 1
            g /= len(pick)
            now = rate * (1 - done / steps)
            grad = g @ weight.T
            weight -= 0.02 * now * (h.T @ g)
            bias -= 0.002 * now * g.sum(0)
            embed -= now * (x.T @ grad)
            done += 1
    model = Model(langs, (embed @ weight).astype(np.float32), bias)
    logits = np.concatenate([_dense([rows[i][2:]]) @ model.table for i in held]) + bias
    whole = np.array([rows[i][1] for i in held])
    scales = np.geomspace(0.05, 20, 60)
    losses = [-np.log(np.maximum(softmax(logits[whole] / t)[np.arange(whole.sum()), y[held][whole]], 1e-12)).mean() for t in scales]
    model.temperature = float(max(scales[int(np.argmin(losses))], 0.25))
    none = softmax(logits / model.temperature)[:, -1]
    clean, other = none[whole], none[y[held] == len(langs)]
    bars = np.linspace(0.05, 0.95, 91)
    lost = KEEPING * (clean[:, None] > bars).mean(0) + ((other[:, None] <= bars).mean(0) if len(other) else 0)
    model.threshold = float(np.median(bars[lost <= lost.min() + 1e-9]))
    return model


def of_no_language(text: str, draw: int) -> list[str]:
    """Texts with the look of ``text`` in no language: its letters in another order, and each letter taken for another one of
    its own alphabet, or of a far one."""
    rng = np.random.default_rng(draw & (2**63 - 1))
    signs = list(text)
    at = [k for k, ch in enumerate(signs) if ch.isalpha()]
    shuffled = signs.copy()
    for k, j in zip(at, rng.permutation(len(at)).tolist(), strict=True):
        shuffled[k] = signs[at[j]]
    own = sorted({signs[k].lower() for k in at} | set("abcdefghijklmnopqrstuvwxyz"))
    other = dict(zip(own, [own[j] for j in rng.permutation(len(own)).tolist()], strict=True))
    far = int(rng.choice([0x370, 0x410, 0x5D0, 0x620, 0x905, 0x4E00, 0xAC00]))
    return ["".join(shuffled), "".join(other.get(ch.lower(), ch) for ch in signs), "".join(chr(far + own.index(ch.lower())) if ch.lower() in other else ch for ch in signs)]


def sample(docs: DataFrame, usable, per_language: int = PER_LANGUAGE) -> list[tuple[str, bool, np.ndarray, np.ndarray]]:
    """Counts of the sampled rows: about ``per_language`` of each language, by a hash of the row, each as a whole, as a short
    span, since short texts are to be told apart too, and as spans made into text of no language. Counting happens on the executors."""
    spark = docs.sparkSession
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text", "doc_id").alias("draw"))
    sizes = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).groupBy("lang").count().collect()
    if not sizes:
        return []
    share = spark.createDataFrame([(r["lang"], c.hash_bound(per_language, r["count"])) for r in sizes], "lang string, share long")
    if len(sizes) <= 10_000:
        share = F.broadcast(share)
    picked = rows.join(share, "lang").where(c.drawn(F.col("draw"), F.col("share"))).select("lang", "text", "draw")

    def count(batches):
        for b in batches:
            out = []
            for lang, text, draw in zip(b["lang"].to_pylist(), b["text"].to_pylist(), b["draw"].to_pylist(), strict=True):
                words = text.split()
                first = abs(draw) % max(1, len(words) - 12)
                short = " ".join(words[first : first + 3 + abs(draw) % 20])
                made = of_no_language(" ".join(words[first : first + 8 + abs(draw) % 60]), draw)
                if not len(subwords(text)):
                    continue
                for order, (name, part) in enumerate([(lang, text), (lang, short), *((UNKNOWN, m) for m in made)]):
                    grams = subwords(part)
                    if len(grams):
                        at, n = np.unique(grams, return_counts=True)
                        out.append((draw, lang, order, name, at.astype(np.uint16).tobytes(), n.astype(np.float32).tobytes()))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["draw", "lang", "order", "name", "at", "n"])

    found = picked.mapInArrow(count, "draw long, lang string, order long, name string, at binary, n binary").collect()
    found.sort(key=lambda r: (r.draw, r.lang, r.order, r.at))
    return [(r.name, r.order == 0, np.frombuffer(r.at, np.uint16), np.frombuffer(r.n, np.float32)) for r in found]


def train(docs: DataFrame, usable=None, per_language: int = PER_LANGUAGE) -> Model:
    return fit(sample(docs, F.lit(True) if usable is None else usable, per_language))


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and lang_pred, score, rejected: one row per row of ``docs``, from its whole text alone.

    lang_pred is ``und`` (score 0, rejected) if the text is null or has no letter, or if there was nothing to learn from.
    The score compares learned languages only. A text is rejected if its calibrated probability of being in none of them is above
    the model's threshold. Ties go to the first language by name; very long texts are counted as a whole; repeated rows get equal
    results; columns other than ``keep`` and the text are not read.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", lang_pred string, score double, rejected boolean"

    def label(batches):
        for b in c.text_batches(batches, text="text_"):
            found = [held.value.predict(t) for t in b["text_"].to_pylist()]
            lang, score, rejected = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*b.schema.names[:-1], "lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(label, schema)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose language is not rejected, with all columns of ``docs``; null texts and those without letters go."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches):
        for b in c.text_batches(batches, text=at):
            yield b.filter(pa.array([not held.value.predict(t)[2] for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    model = train(docs, c.crc_fold() != 1)
    found = identify(docs, model)
    return found.select("doc_id", (c.crc_fold() == 1).alias("held_out"), "lang_pred", "score", "rejected")
