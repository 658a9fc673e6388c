"""Stupid-backoff language-model scores from the corpus's own counts (operator 6).

A word is a run of non-space bytes with A-Z lower-cased. A text's score is the mean log10 of its words' scores under
the counts of all *other* texts (a text's own counts are taken off, so that it cannot vouch for itself): with
``v w`` a word and its successor, ``count(v w) / count(v)`` where the pair is seen elsewhere, else
``BACKOFF * count(w) / N``, else ``BACKOFF / (N + 1)``.

The n-gram count tables are partitioned by hash range: each bucket sums the counts of its n-grams over the corpus. The
exploded n-grams meet them by equi-join on the hash. To spare the shuffle a row per n-gram, rows travel in blocks:
documents are dealt into chunks by hash; a chunk sends each bucket the sorted distinct n-grams it holds with their
counts, as one compressed block, and gets the corpus totals back in the same order. A word as frequent as "the" is one
entry per chunk, so no bucket is hot. Chunks and buckets have a fixed size, their number grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .toxicity import _mix, _powers

BACKOFF = 0.4
#: Bytes of text per chunk and n-grams per bucket, about.
CHUNK_BYTES = 12_000_000
BUCKET_GRAMS = 3_000_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a byte array."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    c = _LOWER[data].astype(np.uint64) + np.uint64(1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(c * up[:len(c)], dtype=np.uint64)])
    return _mix((total[ends] - total[starts]) * down[starts])


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of some texts in order, and the text each belongs to."""
    words, owner = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    up, down = _powers(1 << 18)
    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        if len(data) > len(up):
            up, down = _powers(len(data))
        w = word_hashes(data, up, down)
        words.append(w)
        owner.append(np.full(len(w), i, dtype=np.int64))
    return np.concatenate(words), np.concatenate(owner)


def bigrams(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the neighbouring pairs within a text, and the places of their second words."""
    at = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    return _mix(words[at - 1] * np.uint64(0x9E3779B97F4A7C15) + words[at]), at


def pack(column: np.ndarray, ascending: bool) -> bytes:
    """Integers as one compressed block: ascending ones as differences, bytes ordered by significance."""
    import zstandard
    x = np.diff(column, prepend=column.dtype.type(0)) if ascending else column
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(block: bytes, ascending: bool) -> np.ndarray:
    import zstandard
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), dtype=np.uint8)
    x = np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<u8")
    return np.cumsum(x, dtype=np.uint64) if ascending else x


def _cuts(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Places in sorted hashes where each of ``buckets`` equal hash ranges begins, and the end."""
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(grams, bounds), [len(grams)]])


def _send(buckets: int):
    """A chunk's distinct n-grams and counts, a block for each order and bucket."""
    def run(rows: pa.Table) -> pa.Table:
        chunk = rows.column("chunk")[0].as_py()
        words, owner = tokens(rows.column("text").to_pylist())
        out = {"bucket": [], "chunk": [], "grams": [], "counts": []}
        for order, grams in ((0, words), (1, bigrams(words, owner)[0])):
            distinct, n = np.unique(grams, return_counts=True)
            at = _cuts(distinct, buckets)
            for b, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
                if hi > lo:
                    out["bucket"].append(order * buckets + b)
                    out["chunk"].append(chunk)
                    out["grams"].append(pack(distinct[lo:hi], True))
                    out["counts"].append(pack(n[lo:hi], False))
        return pa.table(out, schema=pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("grams", pa.binary()),
                                               ("counts", pa.binary())]))

    return run


def _total(rows: pa.Table) -> pa.Table:
    """Corpus totals of a bucket's n-grams, for each chunk in the order of its block."""
    blocks = [unpack(b, True) for b in rows.column("grams").to_pylist()]
    counts = np.concatenate([unpack(b, False) for b in rows.column("counts").to_pylist()]).astype(np.int64)
    distinct, inverse = np.unique(np.concatenate(blocks), return_inverse=True)
    total = np.bincount(inverse, weights=counts).astype(np.int64)[inverse]
    ends = np.cumsum([len(b) for b in blocks])
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"),
                     "totals": [pack(total[e - len(b):e], False) for b, e in zip(blocks, ends)]},
                    schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("totals", pa.binary())]))


def _elsewhere(grams: np.ndarray, owner: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """For each occurrence, how often its n-gram stands in other texts."""
    distinct, inverse = np.unique(grams, return_inverse=True)
    texts = int(owner.max()) + 1 if len(owner) else 1
    _, own, times = np.unique(inverse * texts + owner, return_inverse=True, return_counts=True)
    return totals[inverse] - times[own]


def _score(rows: pa.Table, replies: pa.Table) -> pa.Table:
    """Per text: words, the sum of the logarithms without N, and how many words were divided by N and by N + 1."""
    n = rows.num_rows
    words, owner = tokens(rows.column("text").to_pylist())
    replies = replies.sort_by("bucket")
    blocks = [unpack(b, False).astype(np.int64) for b in replies.column("totals").to_pylist()]
    totals = np.concatenate([np.zeros(0, dtype=np.int64), *blocks])
    n_words = len(np.unique(words))  # the words' blocks come first, then the pairs'
    uni = _elsewhere(words, owner, totals[:n_words])
    pairs, at = bigrams(words, owner)
    bi = np.zeros(len(words), dtype=np.int64)
    bi[at] = _elsewhere(pairs, owner[at], totals[n_words:])
    history = np.ones(len(words), dtype=np.int64)
    history[at] = uni[at - 1]
    first = np.ones(len(words), dtype=bool)
    first[at] = False
    seen = bi > 0
    known = ~seen & (uni > 0)
    log = np.zeros(len(words))
    log[seen] = np.log10(bi[seen] / history[seen])
    log[known] = np.log10(uni[known])
    log[~seen & ~first] += np.log10(BACKOFF)
    add = lambda w: np.bincount(owner, weights=w, minlength=n)
    return pa.table({"doc_id": rows.column("doc_id"), "words": add(np.ones(len(words))).astype(np.int64), "logs": add(log),
                     "over_n": add(known).astype(np.int64), "over_n1": add(~seen & ~known).astype(np.int64)},
                    schema=pa.schema([("doc_id", pa.int64()), ("words", pa.int64()), ("logs", pa.float64()),
                                      ("over_n", pa.int64()), ("over_n1", pa.int64())]))


def backoff_scores(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, words, seen_share, score``.

    ``seen_share`` is the share of words whose pair with the word before is seen in another row; ``score`` the mean
    log10. Both are null for a text without words (null texts included). Rows that repeat a text count as other
    texts, whatever their id. The first word of a text has no pair and is scored by its own count, without the factor.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks, buckets = max(1, -(-size // CHUNK_BYTES)), max(1, -(-size // (6 * BUCKET_GRAMS)))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(chunks)).cast("long"))
    sent = dealt.groupBy("chunk").applyInArrow(_send(buckets), "bucket long, chunk long, grams binary, counts binary")
    replies = sent.groupBy("bucket").applyInArrow(_total, "chunk long, bucket long, totals binary")
    summed = cut(dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        _score, "doc_id long, words long, logs double, over_n long, over_n1 long"), "lm_sums")
    total = summed.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    rest = F.lit(total) - F.col("words")
    nonzero = F.when(F.col("words") > 0, F.col("words"))
    logs = (F.col("logs") - F.col("over_n") * F.log10(F.greatest(rest, F.lit(1))) - F.col("over_n1") * F.log10(rest + 1))
    return summed.select("doc_id", "words",
                         ((F.col("words") - F.col("over_n") - F.col("over_n1")) / nonzero).alias("seen_share"),
                         (logs / nonzero).alias("score"))
