"""Toxicity by weak supervision (operator 1).

1. *Voters.* Word and word-prefix features that occur mostly in texts labelled toxic are mined from a bounded,
   hash-chosen sample of the training labels and dealt into lexicon voters by kind and hash, so that the
   voters see different words. Seed lexicons of public insults, one per language, and text patterns vote too;
   one voter speaks for "clean" where no lexicon hits.
2. *Label model.* A generative model with a latent class: the votes of a class are Gaussian with a class mean
   per voter (its accuracy) and one full covariance (the voters' correlations, so that voters that always agree
   are not counted twice). Fitted by EM on the counts of vote patterns; it never sees a label.
3. *Classifier.* A logistic regression over the mined features, trained on the posterior labels, scores whole
   texts. Only the model (at most ``MAX_FEATURES`` weights) is broadcast.

Labels are read only where crc32(doc_id) mod 5 is not 0. ``lang``, ``source`` and ``doc_id`` are never inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod, cut
from .langid import slices

#: Labelled rows used for fitting, at most about this many (chosen by a hash of the id).
FIT_ROWS = 20_000
#: Mined features kept, at most.
MAX_FEATURES = 4096
PREFIXES = (4, 5)
#: Toxic share from which a mined feature counts as sure; sure and unsure ones vote apart.
SURE = 0.9
_GROUPS = 3

# Seed lexicons: common public insults (fixed values).
SEEDS = {
    "en": "idiot moron stupid loser scum trash worthless pathetic disgusting clown bastard bitch asshole dumbass retard "
          "filth vermin imbecile jerk pig",
    "de": "idiot dumm trottel arschloch abschaum versager widerlich wertlos dreckig schwein hurensohn depp",
    "fr": "idiot connard salaud abruti imbécile ordure débile minable crétin merde pourriture",
    "es": "idiota imbécil estúpido basura asqueroso inútil cabrón escoria mierda payaso tonto",
}
PATTERNS = (
    re.compile(r"\b(?:you|du|tu|tú)\b[^.!?]{0,30}\b(?:are|bist|es|eres)\b[^.!?]{0,30}\b(?:idiot\w*|stupid|dumm|trash|moron)", re.I),
    re.compile(r"\b(?:shut up|go away and die|kill yourself|halt die klappe|ta gueule|cállate)\b", re.I),
    re.compile(r"(?:\b\w+[*@#$%]{2,}\w*\b[^.\n]{0,20}!){1}"),
)
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    def run(base):
        x = np.full(n, base, dtype=np.uint64)
        x[:1] = 1
        return np.cumprod(x, dtype=np.uint64)
    return run(_BASE), run(_INVERSE)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """64-bit ids of the words and word prefixes of code-point arrays; words are runs of letters."""

    def __init__(self):
        self.up, self.down = _powers(0)

    def features(self, c: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(id, kind, text)`` per occurrence; kind 0 is a whole word, then the prefixes."""
        n = len(c)
        if n > len(self.up):
            self.up, self.down = _powers(n)
        inside = np.concatenate([[False], c != 0, [False]])
        starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
        ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        total = np.concatenate([[np.uint64(0)], np.cumsum(c.astype(np.uint64) * self.up[:n], dtype=np.uint64)])
        word = owner[starts]
        ids, kinds, texts = [], [], []
        for kind, cut_at in enumerate((None, *PREFIXES)):
            if cut_at is None:
                s, e, w = starts, ends, word
            else:
                longer = ends - starts > cut_at
                s = starts[longer]
                e, w = s + cut_at, word[longer]
            ids.append(_mix((total[e] - total[s]) * self.down[s] * np.uint64(31) + _SALT[kind]))
            kinds.append(np.full(len(s), kind, dtype=np.int8))
            texts.append(w)
        return np.concatenate(ids), np.concatenate(kinds), np.concatenate(texts)


def word_ids(words: list[str]) -> np.ndarray:
    """Ids of single words, as ``Hasher`` gives them for a whole word."""
    h, out = Hasher(), []
    for c, owner in slices(words):
        ids, kinds, texts = h.features(c, owner)
        out.append(ids[kinds == 0])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


@dataclass
class Lexicon:
    """Sorted feature ids, each with two columns: found at least once, found at least twice in the text.

    ``voter`` gives the voter of each column, -1 where the column is not used.
    """

    ids: np.ndarray
    voter: np.ndarray
    bits: np.ndarray = field(init=False)

    def __post_init__(self):
        self.bits = np.zeros(1 << 16, dtype=bool)  # of the low bits, to skip most lookups
        self.bits[self.ids & np.uint64(0xFFFF)] = True

    def find(self, ids: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """A code ``text * len(ids) + place`` for every occurrence of a feature of the lexicon."""
        if not len(self.ids):
            return np.zeros(0, dtype=np.int64)
        maybe = np.flatnonzero(self.bits[ids & np.uint64(0xFFFF)])
        found = ids[maybe]
        at = np.minimum(np.searchsorted(self.ids, found), len(self.ids) - 1)
        ok = self.ids[at] == found
        return texts[maybe][ok].astype(np.int64) * len(self.ids) + at[ok]

    def columns(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``(text, column)`` of the used columns, from all codes of a batch."""
        size = len(self.ids)
        if not codes or not size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        both, n = np.unique(np.concatenate(codes), return_counts=True)
        text = np.concatenate([both // size, both[n > 1] // size])
        col = np.concatenate([both % size, both[n > 1] % size + size])
        used = self.voter[col] >= 0
        return text[used], col[used]


def one_per_copy_group(rows: DataFrame) -> DataFrame:
    """One row per group of (near-)copies, by two minimum hashes of the words and the label.

    A toxic text copied a thousand times would otherwise make all of its words look like signs of toxicity.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        h = Hasher()
        for b in batches:
            texts = b.column("text").to_pylist()
            low = np.full((2, len(texts)), np.iinfo(np.uint64).max, dtype=np.uint64)
            for c, owner in slices(texts):
                ids, kinds, of = h.features(c, owner)
                whole = kinds == 0
                for k in range(2):
                    np.minimum.at(low[k], of[whole], _mix(ids[whole] ^ _SALT[k]))
            yield {"a": low[0].view(np.int64), "b": low[1].view(np.int64), "text": texts, "toxic": b.column("toxic")}

    return (arrow_map(rows.select("text", "toxic"), run, "a long, b long, text string, toxic int")
            .groupBy("a", "b", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))


def mine(rows: DataFrame, min_evidence: float = 14.0) -> list[tuple[int, int, int, float]]:
    """``(id, kind, level, toxic share)`` of the features that toxic texts hold more often than chance allows.

    Level 1 counts the texts that hold the feature, level 2 those that hold it twice at least.

    ``rows`` holds ``(text, toxic)``. Texts are counted once per feature; each task sums before the shuffle.
    A feature is kept if the log-likelihood ratio of its toxic share against the overall share is at least
    ``min_evidence`` (14: one chance in a million, as millions of words are tried) and the share is a half at least.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        h = Hasher()
        for b in batches:
            y = np.array(b.column("toxic").to_pylist(), dtype=np.int64)
            parts = [h.features(c, o) for c, o in slices(b.column("text").to_pylist())]
            if not parts:
                continue
            ids, kinds, texts = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((texts, ids))
            ids, kinds, texts = ids[order], kinds[order], texts[order]
            first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])]))
            times = np.diff(np.append(first, len(ids)))
            for level in (1, 2):
                keep = first[times >= level]
                if not len(keep):
                    continue
                i, hit = ids[keep], y[texts[keep]]
                run_at = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                yield {"id": i[run_at].view(np.int64), "kind": kinds[keep][run_at].astype(np.int64),
                       "level": np.full(len(run_at), level), "pos": np.add.reduceat(hit, run_at),
                       "n": np.diff(np.append(run_at, len(i)))}

    totals = rows.agg(F.sum("toxic"), F.count("*")).first()
    pos_all, all_ = int(totals[0] or 0), int(totals[1])
    if not pos_all or pos_all == all_:
        return []
    counted = (arrow_map(rows.select("text", F.col("toxic").cast("long").alias("toxic")), run,
                         "id long, kind long, level long, pos long, n long")
               .groupBy("id", "kind", "level").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")))
    rate = pos_all / all_
    neg = F.col("n") - F.col("pos")
    evidence = F.col("pos") * F.log(F.col("pos") / (F.col("n") * rate)) + F.when(
        neg > 0, neg * F.log(neg / (F.col("n") * (1 - rate)))).otherwise(0.0)
    best = (counted.where("pos > 0 and 2 * pos >= n").where(evidence >= min_evidence)
            .orderBy(F.col("pos").desc(), "id", "level").limit(MAX_FEATURES))
    return [(r.id & 0xFFFFFFFFFFFFFFFF, r.kind, r.level, r.pos / r.n) for r in best.collect()]


def label_model(votes: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Posterior probability of class 1 for each vote pattern (rows of -1, 0, 1) with its count.

    ``start`` is the first guess of the posterior. Class means are the voters' accuracies, the shared covariance their
    correlations; both are re-estimated from the posteriors until the rounds are used up.
    """
    if not len(votes):
        return np.zeros(0)
    x, w = votes.astype(float), counts.astype(float)
    q = start.astype(float)
    dims = x.shape[1]
    for _ in range(rounds):
        n1, n0 = max((w * q).sum(), 1e-6), max((w * (1 - q)).sum(), 1e-6)
        m1, m0 = (w * q) @ x / n1, (w * (1 - q)) @ x / n0
        d1, d0 = x - m1, x - m0
        cov = ((d1 * (w * q)[:, None]).T @ d1 + (d0 * (w * (1 - q))[:, None]).T @ d0) / (n1 + n0)
        cov += np.eye(dims) * 0.05
        lean = np.linalg.solve(cov, m1 - m0)
        logit = (x - (m1 + m0) / 2) @ lean + np.log(n1 / n0)
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if m1.sum() < m0.sum():  # the voters speak for class 1
            q = 1 - q
    return q


def train_linear(hits: list[list[int]], target: np.ndarray, dims: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 features with soft targets; L2-regularised, weights not below 0.

    The features were mined as signs of toxicity, so a negative weight would be noise.
    """
    rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    cols = np.array([c for h in hits for c in h], dtype=np.int64)
    w = np.zeros(dims)
    rate = 8.0 / max(len(hits), 1)
    base = float(np.clip(target.mean() if len(target) else 0.0, 1e-3, 0.4))
    bias = np.log(base / (1 - base)) - 1.5
    step2 = np.full(dims, 1e-8)
    for _ in range(rounds):
        z = bias + np.bincount(rows, weights=w[cols], minlength=len(hits)) if len(cols) else np.full(len(hits), bias)
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = (np.bincount(cols, weights=gap[rows], minlength=dims) if len(cols) else np.zeros(dims)) + 1e-3 * w
        step2 += grad**2
        w = np.maximum(w - 0.5 * grad / np.sqrt(step2), 0)
        bias = min(bias - rate * 0.1 * gap.sum(), -1.0)
    return w, float(bias)


@dataclass
class Model:
    lexicon: Lexicon
    weight: np.ndarray
    bias: float


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model of the training labels; see the module's description. Without labels the seeds alone decide."""
    known = (labels.where((crc_mod(F.col("doc_id"), 5) != 0) & F.col("toxic").isNotNull())
             .select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
             .groupBy("_id").agg(F.max("toxic").alias("toxic")))
    n = known.count()
    space = 1 << 20
    chosen = known.where(F.pmod(F.xxhash64("_id"), F.lit(space)) < int(min(1.0, FIT_ROWS / max(n, 1)) * space))
    rows = cut(one_per_copy_group(
        docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
        .join(chosen, F.col("doc_id") == F.col("_id"))), "toxic_fit")
    mined = mine(rows)
    # voters: sure and unsure mined features by hash group, one per seed lexicon, one per pattern, one for "clean"
    first_seed = 2 * _GROUPS
    n_voters = first_seed + len(SEEDS) + len(PATTERNS) + 1
    voter: dict[tuple[int, int], int] = {
        (i, level): (0 if share >= SURE else _GROUPS) + (i >> 40) % _GROUPS for i, _, level, share in mined}
    seeds = {i: first_seed + k for k, words in enumerate(SEEDS.values()) for i in word_ids(words.split()).tolist()}
    for i, v in seeds.items():
        voter.setdefault((i, 1), v)
    ids = np.array(sorted({i for i, _ in voter}), dtype=np.uint64)
    lexicon = Lexicon(ids, np.array([voter.get((i, level), -1) for level in (1, 2) for i in ids.tolist()], dtype=np.int64))
    seed_voter = np.array([seeds.get(i, -1) for i in ids.tolist()] + [-1] * len(ids))

    def vote(batches: Iterator[pa.RecordBatch]):
        h = Hasher()
        for b in batches:
            texts = b.column("text").to_pylist()
            codes = []
            for c, owner in slices(texts):
                f, _, of = h.features(c, owner)
                codes.append(lexicon.find(f, of))
            hits: list[list[int]] = [[] for _ in texts]
            votes = np.zeros((len(texts), n_voters), dtype=np.int8)
            for t, col in zip(*(x.tolist() for x in lexicon.columns(codes))):
                hits[t].append(col)
                votes[t, lexicon.voter[col]] = 1
                if seed_voter[col] >= 0:
                    votes[t, seed_voter[col]] = 1
            for t, text in enumerate(texts):
                for k, p in enumerate(PATTERNS):
                    if p.search(text):
                        votes[t, first_seed + len(SEEDS) + k] = 1
                if not votes[t].any():
                    votes[t, -1] = -1
            yield {"hits": hits, "votes": [v.tobytes() for v in votes]}

    sample = arrow_map(rows.select("text"), vote, "hits array<long>, votes binary").collect()  # FIT_ROWS at most
    patterns: dict[bytes, int] = {}
    for r in sample:
        patterns[bytes(r.votes)] = patterns.get(bytes(r.votes), 0) + 1
    keys = sorted(patterns)
    votes = np.array([np.frombuffer(k, dtype=np.int8) for k in keys]).reshape(-1, n_voters)
    sure = (votes[:, :_GROUPS].sum(axis=1) + votes[:, first_seed:-1].sum(axis=1)) > 0
    unsure = votes[:, _GROUPS:first_seed].sum(axis=1)
    start = np.where(sure, 0.95, np.where(unsure > 1, 0.6, np.where(unsure > 0, 0.3, 0.02)))
    posterior = dict(zip(keys, label_model(votes, np.array([patterns[k] for k in keys]), start)))
    weight, bias = train_linear([list(r.hits) for r in sample],
                                np.array([posterior[bytes(r.votes)] for r in sample]), 2 * len(ids))
    # a seed word that the sample never showed keeps a weight that decides by itself
    seen = np.zeros(2 * len(ids), dtype=bool)
    for r in sample:
        seen[r.hits] = True
    weight = np.where(~seen & (seed_voter >= 0), 1.0 - bias, weight)
    return Model(lexicon, weight, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` for every row; whole texts, each feature counted once per text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_FEATURES ids and weights

    def run(batches: Iterator[pa.RecordBatch]):
        m, h = shared.value, Hasher()
        for b in batches:
            codes = []
            for c, owner in slices(b.column("text").to_pylist()):
                ids, _, texts = h.features(c, owner)
                codes.append(m.lexicon.find(ids, texts))
            text, col = m.lexicon.columns(codes)
            z = m.bias + np.bincount(text, weights=m.weight[col], minlength=b.num_rows)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield {"doc_id": b.column("doc_id"), "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                     "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Empty and null texts get the score of a text without any sign. Several labels of one document count as
    toxic if one is. Rows with a null ``doc_id`` are scored, never learned from and not held out.
    """
    return score(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
