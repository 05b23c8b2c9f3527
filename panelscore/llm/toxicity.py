"""Toxicity scores of deobfuscated text.

Noisy channel: a token with digits or signs among its letters, with letters repeated three times or more or all of them twice,
or a text spelt out letter by letter becomes a lattice of what each sign may stand for, with a gap between words or none.
Viterbi decoding under a character trigram model, counted over all documents, picks the likeliest words. Signs without width
are left out. The restored words and their beginnings are matched with a lexicon
learned from a bounded sample of labelled documents and weighted by logistic regression.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscore.llm import common as c

#: Sampled documents of each label; entries of the lexicon; least evidence (log-likelihood ratio) and odds of an entry.
PER_LABEL, ENTRIES, EVIDENCE, ODDS = 1500, 500, 25.0, 3.0
TOXIC = 0.7
REMEMBERED = 200_000
#: Between two words of a decoded string; and the length from which on a token is not remembered.
GAP, WORD = "`", 64
#: What a sign may stand for. A star hides a vowel.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "*": "aeiou", "#": "h", "&": "a",
}
_EDGES = ".,;:!?\"'()[]{}«»“”‘’…-–—*_"
_OPENING = "\"'([{«“‘¿¡"
_SPELT = re.compile(r"(?:[^\W_]|[0-9@$!|+€*])(?:[.\-_*·/]+(?:[^\W_]|[0-9@$!|+€*])){2,}")
_LONG = re.compile(r"([^\W\d_])\1\1|^(?:([^\W\d_])\2){3,}$")
_DOUBLED = re.compile(r"(?:([^\W\d_])\1){3,}")
#: Soft hyphens, joiners and other signs without width.
_HIDDEN = r"[\x{00AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]"
_SIGN = re.compile(r"[0-9@$!|+€£(<*#&]")


def fold(char: str) -> str:
    """The base letter a-z of a character, or nothing."""
    base = unicodedata.normalize("NFKD", char.lower())[:1]
    return base if "a" <= base <= "z" else ""


_tables: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """1 to 26 for the letters of code points below 0x250 by their base, else 0."""
    if not _tables:
        _tables.append(np.array([ord(fold(chr(i)) or "`") - 96 for i in range(0x250)] + [0], np.int64))
    return _tables[0]


def trigrams(text: str) -> np.ndarray:
    """Codes 27 * 27 * a + 27 * b + c of neighbouring letters; 0 stands for the edge of a word."""
    code = letter_table()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x250)]
    code = np.concatenate(([0, 0], code, [0, 0]))
    return (code[:-2] * 27 + code[1:-1]) * 27 + code[2:]


def count_letters(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all texts: 27 ** 3 sums, whatever the size of the corpus."""

    def count(batches):
        total = np.zeros(27**3, np.int64)
        for b in c.text_batches(batches):
            for t in b["text"].to_pylist():
                if t:
                    total += np.bincount(trigrams(t), minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    out = np.zeros(27**3)
    for r in docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out


class Letters:
    """Costs (negative log probabilities) of a letter after two others, backing off to one and to none."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(27, 27, 27).copy()
        n[:, 0, 0] = 0
        one = n.sum((0, 1)) + 1
        two = n.sum(0)
        p1 = one / one.sum()
        p2 = (two + 10 * p1) / (two.sum(1, keepdims=True) + 10)
        p3 = (n + 10 * p2) / (n.sum(2, keepdims=True) + 10)
        self.cost = (-np.log(p3)).tolist()

    def decode(self, lattice: list[list[tuple[str, float]]]) -> list[str]:
        """The words of the cheapest string through a lattice; each step offers strings with the cost of the channel, and GAP
        stands between two words. A state is the last two letters, so the work grows with the steps alone."""
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in [*lattice, [(GAP, 0.0)]]:
            best: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                for letters, channel in options:
                    x, y, total = a, b, cost + channel
                    for ch in letters:
                        z = ord(ch) - 96
                        total += self.cost[x][y][z]
                        x, y = y, z
                    if (x, y) not in best or total < best[x, y][0]:
                        best[x, y] = (total, (path, letters) if letters else path)
            states = best
        path, out = min(states.values(), key=lambda s: s[0])[1], []
        while path:
            path, letters = path
            out.append(letters)
        return [w for w in "".join(reversed(out)).split(GAP) if w]


def lattice(token: str, doubled: bool = False) -> list[list[tuple[str, float]]]:
    """What each run of equal signs of a token may stand for; a separator between single signs stands for nothing.

    Three equal letters or more are one or two; of two the second may be too much, and is so rather where all are ``doubled``.
    Three equal signs or more are three.
    """
    out: list[list[tuple[str, float]]] = []
    for m in re.finditer(r"(.)\1*", token, re.DOTALL):
        char, n = m[1], len(m[0])
        letter = fold(char)
        if letter:
            if n >= 3:
                out.append([(letter, 0.7), (letter * 2, 0.7)])
            elif n == 2:
                out.append([(letter, 0.0), (letter * 2, 0.7)] if doubled else [(letter * 2, 0.0), (letter, 3.0)])
            else:
                out.append([(letter, 0.0)])
        elif char in SIGNS:
            for _ in range(min(n, 3)):
                out.append([(x, 1.0) for x in SIGNS[char]] + [("", 9.0)])
    return out


def spelt_lattice(signs: list[str]) -> list[list[tuple[str, float]]]:
    """Of single signs one after the other: between two of them there is nothing, or a gap between words."""
    out: list[list[tuple[str, float]]] = []
    for k, sign in enumerate(signs):
        out += [[("", 0.0), (GAP, 0.5)]] if k else []
        out += lattice(sign)
    return out


def needs_decoding(token: str) -> bool:
    return any(map(str.isalpha, token)) and bool(_SIGN.search(token) or _LONG.search(token)) or bool(_SPELT.fullmatch(token))


@dataclass
class Restorer:
    letters: Letters
    known: dict = field(default_factory=dict)

    def word(self, token: str) -> str:
        """A token without marks at its ends, in lower case; its base letters, decoded, where it is obfuscated."""
        token = token.lstrip(_OPENING).rstrip(_EDGES).lower()
        if token.isalpha() and token.isascii() and not _LONG.search(token):
            return token
        if not needs_decoding(token):
            return token
        if token in self.known:
            return self.known[token]
        plain = re.sub(r"[.\-_*·/]+", "", token) if _SPELT.fullmatch(token) else token
        word = "".join(self.letters.decode(lattice(plain, bool(_DOUBLED.fullmatch(plain)))))
        if len(token) <= WORD:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[token] = word
        return word

    def spelt(self, signs: list[str]) -> list[str]:
        """Words of a text that stands sign by sign: as the language model parts them, and what begins at each letter, since
        short words before or behind one may take letters from it."""
        parted = self.letters.decode(spelt_lattice(signs))
        whole = "".join(parted)
        return list(dict.fromkeys([*parted, *(whole[k : k + WORD] for k in range(len(whole) - 2))]))

    def joined(self, a: str, b: str) -> bool:
        """Whether two words are likelier one word that has been cut."""
        steps = [lattice(x) for x in (a, b)]
        return len(self.letters.decode([*steps[0], [("", 0.5), (GAP, 0.0)], *steps[1]])) == 1


def entries(word: str) -> list[str]:
    """A word and its beginnings (marked by a star) as entries of a lexicon."""
    if len(word) < 3:
        return []
    return [word, *(word[:n] + "*" for n in range(4, 9) if len(word) >= n)]


def document_entries(words: set[str], wanted: set[str] | None = None) -> set[str]:
    """Entries of a document's distinct words; a beginning that three of them share has one more."""
    found = Counter(e for w in words for e in entries(w) if wanted is None or e in wanted)
    return {*found, *(e + "3" for e, n in found.items() if n >= 3 and e[-1] == "*")}


def _words(texts: list[str | None], restorer: Restorer):
    """Distinct restored words of a slice of texts, and for each text which of them it has."""
    shown = pc.replace_substring_regex(pa.array([t or "" for t in texts], pa.large_string()), _HIDDEN, "")
    lists = pc.ascii_split_whitespace(shown)
    flat = lists.flatten().dictionary_encode()
    tokens = flat.dictionary.to_pylist()
    words = [restorer.word(t) for t in tokens]
    code = flat.indices.to_numpy(zero_copy_only=False)
    first = lists.offsets.to_numpy()
    single = np.array([len(t.strip(".,;:?")) == 1 for t in tokens], bool)[code] if len(tokens) else np.zeros(0, bool)
    edge = np.flatnonzero(np.diff(single.view(np.int8), prepend=0, append=0))
    extra: list[tuple[int, str]] = []
    for low, high in zip(edge[0::2], edge[1::2], strict=True):
        if high - low >= 3:
            at = int(low)
            for stop in [*first[np.searchsorted(first, low, side="right") : np.searchsorted(first, high)], high]:
                signs = [tokens[k].strip(".,;:?").lower() for k in code[at:stop]]
                if len(signs) >= 3:
                    doc = int(np.searchsorted(first, at, side="right")) - 1
                    extra += [(doc, w) for w in restorer.spelt(signs) if len(w) >= 3]
                at = int(stop)
    return words, code, first, extra


@dataclass
class Model:
    restorer: Restorer
    weights: dict[str, float]
    bias: float = -4.0

    def matches(self, texts: list[str | None]) -> list[list[str]]:
        """The lexicon entries of each text, sorted."""
        words, code, first, extra = _words(texts, self.restorer)
        wanted = {e.removesuffix("3") for e in self.weights}
        flags = np.array([any(e in wanted for e in entries(w)) for w in words], bool)
        at = np.flatnonzero(flags[code]) if len(code) else np.zeros(0, np.int64)
        held: list[set[str]] = [set() for _ in texts]
        for doc, k in zip((np.searchsorted(first, at, side="right") - 1).tolist(), code[at].tolist(), strict=True):
            held[doc].add(words[k])
        for doc, word in [*extra, *self._cut_words(words, code, first, wanted)]:
            held[doc].add(word)
        return [sorted(e for e in document_entries(s, wanted) if e in self.weights) if s else [] for s in held]

    def _cut_words(self, words: list[str], code: np.ndarray, first: np.ndarray, wanted: set[str]):
        """(text, word) of entries that a space cuts behind one to three letters."""
        heads = {e[:n] for e in wanted for n in (1, 2, 3)}
        short = np.array([w in heads for w in words], bool)
        at = np.flatnonzero(short[code[:-1]]) if len(code) else np.zeros(0, np.int64)
        inside = np.searchsorted(first, at, side="right") == np.searchsorted(first, at + 1, side="right")
        at = at[inside]
        pairs, which = np.unique(code[at].astype(np.int64) * len(words) + code[at + 1], return_inverse=True)
        good = {}
        for k, pair in enumerate(pairs.tolist()):
            a, b = words[pair // len(words)], words[pair % len(words)]
            if any(e in wanted for e in entries(a + b)) and self.restorer.joined(a, b):
                good[k] = a + b
        for k in np.flatnonzero(np.isin(which, list(good))).tolist() if good else ():
            yield int(np.searchsorted(first, at[k], side="right")) - 1, good[int(which[k])]

    def scores(self, texts: list[str | None]) -> list[float]:
        sums = np.array([self.bias + sum(self.weights[e] for e in found) for found in self.matches(texts)])
        return (1 / (1 + np.exp(-np.clip(sums, -50, 50)))).tolist()


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Letter counts of all ``docs``; lexicon and weights from about ``per_label`` labelled documents of each label.

    ``labels`` holds doc_id and toxic, null ones are ignored and all but 0 counts as toxic; a document labelled both ways counts as toxic. With one label
    or none the lexicon is empty and every score is the same.
    """
    spark = docs.sparkSession
    model = Model(Restorer(Letters(count_letters(docs))), {})
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        model.bias = 4.0 if 1 in sizes else -4.0
        return model
    bound = F.when(F.col("toxic") == 1, F.lit(c.hash_bound(per_label, sizes[1]))).otherwise(F.lit(c.hash_bound(per_label, sizes[0])))
    ids = spark.createDataFrame(known.where(c.drawn(F.xxhash64("doc_id"), bound)).collect(), "doc_id long, toxic int")
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    restorer = spark.sparkContext.broadcast(model.restorer)

    def count(batches):
        seen: list[Counter] = [Counter(), Counter()]
        for b in c.text_batches(batches):
            words, code, first, extra = _words(b["text"].to_pylist(), restorer.value)
            more: dict[int, set[str]] = {}
            for doc, word in extra:
                more.setdefault(doc, set()).add(word)
            for i, toxic in enumerate(b["toxic"].to_pylist()):
                own = document_entries({words[k] for k in np.unique(code[first[i] : first[i + 1]]).tolist()} | more.get(i, set()))
                seen[toxic].update(own)
                seen[toxic][""] += 1
        names = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([seen[0][x] for x in names], pa.int64()), pa.array([seen[1][x] for x in names], pa.int64())], names=["entry", "clean", "toxic"]
        )

    counts = rows.mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("n0"), F.sum("toxic").alias("n1"))
    # Every row of a text adds to the entry "", which so holds the sizes of the two samples.
    likely = counts.where("entry = '' or (n1 >= 8 and n1 > n0)").orderBy(F.col("entry") != "", F.desc("n1"), "entry").limit(100 * ENTRIES).collect()
    total = next(((r.n0, r.n1) for r in likely if r.entry == ""), (0, 0))
    if not min(total):
        return model
    found = []
    for r in likely:
        if r.entry:
            odds = np.log((r.n1 + 0.5) / (total[1] - r.n1 + 0.5)) - np.log((r.n0 + 0.5) / (total[0] - r.n0 + 0.5))
            expect = (r.n0 + r.n1) * np.array(total) / sum(total)
            g = 2 * sum(n * np.log(n / e) for n, e in zip((r.n0, r.n1), expect, strict=True) if n)
            if g >= EVIDENCE and odds >= np.log(ODDS):
                found.append((g, r.entry))
    names = [e for _, e in sorted(found, reverse=True)[:ENTRIES]]
    model.weights = dict.fromkeys(names, 0.0)
    held = spark.sparkContext.broadcast(model)

    def match(batches):
        for b in c.text_batches(batches):
            yield pa.RecordBatch.from_arrays([b["toxic"], pa.array(held.value.matches(b["text"].to_pylist()), pa.list_(pa.string()))], names=["toxic", "entries"])

    drawn_rows = rows.select("text", "toxic").mapInArrow(match, "toxic int, entries array<string>").collect()
    at = {e: i for i, e in enumerate(names)}
    x, y = np.zeros((len(drawn_rows), len(names) + 1)), np.array([r.toxic for r in drawn_rows], float)
    for i, r in enumerate(drawn_rows):
        x[i, [at[e] for e in r.entries]] = 1
    x[:, -1] = 1
    share = np.where(y == 1, sizes[1] / max(y.sum(), 1), sizes[0] / max((1 - y).sum(), 1))
    theta = _logistic(x, y, share / share.mean())
    model.weights, model.bias = dict(zip(names, theta[:-1].tolist(), strict=True)), float(theta[-1])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, shrink: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps with shrinkage of all but the last."""
    theta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], shrink)
    penalty[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * theta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        theta -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return theta


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the score (0 to 1) of each row's whole text; null and empty texts match no entry."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", score double"

    def rate(batches):
        for b in c.text_batches(batches, text="text_"):
            values = held.value.scores(b["text_"].to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(values, pa.float64())], names=[*b.schema.names[:-1], "score"])

    return rows.mapInArrow(rate, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    model = train(docs, c.table(spark, sf_dir, "labels").where(c.crc_fold() != 1))
    return score(docs, model).select("doc_id", (c.crc_fold() == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
