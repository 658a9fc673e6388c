"""Language identification by error-correcting output codes (operator 8).

Every language gets a codeword of several bits. For each bit, a binary classifier over hashed letter
trigrams predicts whether the text's language has the bit set. The classifiers are log-odds tables derived
from one relation of trigram counts per language, counted over all training documents. Decoding compares
the bits' margins with every codeword under a logistic loss, each bit weighted by its expected reliability,
takes the codeword of least loss and flags a text whose two best codewords are nearly tied.

Only the model passes through the driver: languages x ``BUCKETS`` counts, whatever the corpus size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod

#: Hash buckets of letter trigrams.
BUCKETS = 1 << 15
#: Characters hashed at a time; longer texts are taken in overlapping slices, whole.
_SLICE = 1 << 19


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def slices(texts: list[str | None], limit: int = _SLICE, overlap: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lower-cased code points, non-letters as 0, with the text's index at each place; bounded pieces.

    Each text stands between zeros. A text longer than ``limit`` comes in slices that share ``overlap``
    places, so every window of ``overlap + 1`` places is seen once.
    """
    letter = letter_table()

    def codes(parts, owners):
        c = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return np.where(letter[c], c, 0), np.repeat(np.array(owners), [len(p) for p in parts])

    parts, owners, size = [], [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        padded = f" {text.lower()}  "
        for at in range(0, max(1, len(padded) - overlap), limit):
            piece = padded[at:at + limit + overlap]
            if size + len(piece) > 2 * limit:
                yield codes(parts, owners)
                parts, owners, size = [], [], 0
            parts.append(piece)
            owners.append(k)
            size += len(piece)
    if parts:
        yield codes(parts, owners)


def trigrams(c: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the windows of three places whose middle is a letter, and their texts."""
    c = c.astype(np.uint32)
    at = np.flatnonzero((c[1:-1] != 0) & (owner[:-2] == owner[2:]))
    h = (c[at] * np.uint32(0x9E3779B1)) ^ (c[at + 1] * np.uint32(0x85EBCA77)) ^ (c[at + 2] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), owner[at]


def trigram_counts(rows: DataFrame) -> DataFrame:
    """``(lang, bucket, n)`` over all rows of ``(lang, text)``; summed in each task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            code = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            of = np.array([code[x] for x in langs])
            for c, owner in slices(b.column("text").to_pylist()):
                bucket, owner = trigrams(c, owner)
                n = np.bincount(of[owner] * BUCKETS + bucket, minlength=len(code) * BUCKETS).reshape(-1, BUCKETS)
                for lang, i in code.items():
                    total[lang] = total[lang] + n[i] if lang in total else n[i]
        for lang, n in total.items():
            used = np.flatnonzero(n)
            yield {"lang": [lang] * len(used), "bucket": used, "n": n[used]}

    return (arrow_map(rows, run, "lang string, bucket long, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def codewords(k: int) -> np.ndarray:
    """``k`` rows of +1 and -1. Up to five languages: every split of them; more: the best of 64 random codes."""
    if k < 2:
        return np.zeros((k, 0))
    if k <= 5:
        return np.array([[1 if i == 0 or not (s >> (i - 1)) & 1 else -1 for s in range(1, 1 << (k - 1))]
                         for i in range(k)], dtype=float)
    bits, best = max(15, 6 * math.ceil(math.log2(k))), None
    rng = np.random.default_rng(8)
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], size=(k, bits))
        code[:, np.abs(code.sum(axis=0)) == k] *= rng.choice([-1.0, 1.0], size=(k, 1))
        apart = ((bits - code @ code.T) / 2 + np.eye(k) * bits).min()
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


class Model:
    """Languages, codewords, one weight table per bit and the bits' reliabilities."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.code = codewords(len(self.langs))
        n = np.array([counts[x] for x in self.langs], dtype=float).reshape(len(self.langs), BUCKETS)
        p = (n + 0.5) / (n.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        tables, weights = [], []
        for bit in self.code.T:
            t = np.log(p[bit > 0].mean(axis=0) / p[bit < 0].mean(axis=0))
            mean = p @ t
            sd = np.sqrt(np.maximum((p @ t**2) - mean**2, 1e-12))
            # chance that twenty trigrams of each language get the bit right, worst language first
            right = min(0.5 * (1 + math.erf(z / math.sqrt(2))) for z in bit * mean / sd * math.sqrt(20))
            right = min(max(right, 0.55), 0.999)
            tables.append(t)
            weights.append(math.log(right / (1 - right)))
        self.table = np.array(tables, dtype=np.float32).reshape(len(self.code.T), BUCKETS).T.copy()
        self.weight = np.array(weights)

    def decode(self, sums: np.ndarray, grams: np.ndarray, tie: float):
        """Best language, its score in 0 to 1 and whether it is nearly tied, for each row of margin sums."""
        if len(self.langs) < 2:
            return np.zeros(len(sums), dtype=int), np.ones(len(sums)), np.zeros(len(sums), dtype=bool)
        z = sums / np.sqrt(np.maximum(grams, 1))[:, None]
        loss = np.zeros((len(z), len(self.langs)))
        for i, word in enumerate(self.code):
            loss[:, i] = (np.logaddexp(0, -z * word) * self.weight).sum(axis=1)
        loss /= max(self.weight.sum(), 1e-9)
        order = np.argsort(loss, axis=1, kind="stable")
        first, second = (np.take_along_axis(loss, order[:, i:i + 1], axis=1)[:, 0] for i in (0, 1))
        prob = np.exp(-(loss - first[:, None]) * len(self.weight))
        return order[:, 0], 1 / prob.sum(axis=1), second - first < tie


def fit(docs: DataFrame, train: Column) -> Model:
    """Model of the rows with ``train`` true, a language and a text."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts: dict[str, np.ndarray] = {}
    for lang, bucket, n in trigram_counts(rows).toLocalIterator():
        counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))[bucket] = n
    return Model(counts)


def identify(docs: DataFrame, model: Model, tie: float = 0.01) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every row.

    ``lang_pred`` is ``und`` and the score 0 where the text is null or has no letter, or where nothing was
    learned. ``ambiguous`` is true where the two best codewords' mean losses lie within ``tie`` (equal
    losses go to the language first in order of name). Texts of any length are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        for b in batches:
            sums = np.zeros((b.num_rows, len(m.weight)))
            grams = np.zeros(b.num_rows, dtype=np.int64)
            for c, owner in slices(b.column("text").to_pylist()):
                bucket, owner = trigrams(c, owner)
                if not len(owner):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                np.add.at(grams, owner[starts], np.diff(np.append(starts, len(owner))))
                if len(m.weight):
                    np.add.at(sums, owner[starts], np.add.reduceat(m.table[bucket], starts, axis=0, dtype=np.float64))
            best, score, tied = m.decode(sums, grams, tie)
            known = (grams > 0) & (len(m.langs) > 0)
            yield {"doc_id": b.column("doc_id"),
                   "lang_pred": [m.langs[i] if ok else "und" for i, ok in zip(best, known)],
                   "score": np.where(known, score, 0.0), "ambiguous": np.where(known, tied, False)}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                     "doc_id long, lang_pred string, score double, ambiguous boolean")


def learned_from() -> Column:
    """True for the rows that the model may learn from."""
    return crc_mod(F.col("doc_id"), 3) != 1


def language_id(docs: DataFrame) -> DataFrame:
    """Fit on the documents whose crc32(doc_id) mod 3 is not 1 and predict every document.

    A null ``doc_id`` is neither held out nor learned from. ``held_out`` tells the rows not learned from
    by that rule. An empty table gives an empty result.
    """
    part = crc_mod(F.col("doc_id"), 3)
    model = fit(docs, learned_from())
    return identify(docs, model).select(
        "doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
