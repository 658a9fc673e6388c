"""Benchmark decontamination by pigeonhole edit matching (operator 4).

An item of ``m`` characters has an error budget of ``m // EDIT_SHARE`` edits and is split into budget + 1 pieces.
A copy within the budget holds at least one piece unchanged (pigeonhole). An Aho-Corasick automaton of all pieces
finds the exact hits in one pass over each text; each hit opens a window around the place where the item would lie;
overlapping windows of an item are merged and verified with Myers' bit-parallel distance.

The items are broadcast in blocks of bounded size: a benchmark larger than ``BLOCK_CHARS`` is dealt into several
blocks by hash, and the corpus is scanned once per block. Documents never leave their tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .editdist import ends_within, find, masks

#: One edit for so many characters of an item.
EDIT_SHARE = 20
#: Characters of items that one broadcast holds, about.
BLOCK_CHARS = 4_000_000


def normalised(text: str) -> str:
    """Lower case, white space runs as one space."""
    return " ".join(text.lower().split())


class Items:
    """The items of one block: normalised texts, budgets and the automaton of their pieces."""

    def __init__(self, rows: list[tuple[int, str]]):
        import ahocorasick
        self.ids, self.text, self.budget, self.peq = [], [], [], []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in rows:
            text = normalised(raw)
            if not text:
                continue
            k = len(text) // EDIT_SHARE
            place = len(self.ids)
            self.ids.append(item_id)
            self.text.append(text)
            self.budget.append(k)
            self.peq.append(masks(text))
            for j in range(k + 1):
                lo, hi = j * len(text) // (k + 1), (j + 1) * len(text) // (k + 1)
                pieces.setdefault(text[lo:hi], []).append((place, lo))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(place, distance, start, length)`` of every item found in a normalised text, its best place each."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for place, offset in uses:
                start = end + 1 - size - offset
                k = self.budget[place]
                windows.setdefault(place, []).append((max(0, start - k), start + len(self.text[place]) + k))
        out = []
        for place, spans in windows.items():
            item, k = self.text[place], self.budget[place]
            best = None
            spans.sort()
            merged = [list(spans[0])]
            for lo, hi in spans[1:]:
                if lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            for lo, hi in merged:
                window = text[lo:hi]
                if k < 2:  # the best place may be inside a word: try all of them
                    for got in self._short_places(item, place, text, lo, hi):
                        if (best is None or got < best) and self._whole_words(text, got[1], got[2]):
                            best = got
                    continue
                at = window.find(item)
                if at >= 0:
                    got = (0, lo + at, len(item))
                else:
                    hit = find(item, self.peq[place], window, k)
                    if hit is None:
                        continue
                    distance, end = hit
                    head = window[:end][::-1]
                    _, size = find(item[::-1], masks(item[::-1]), head, distance)
                    got = (distance, lo + end - size, size)
                if best is None or got < best:
                    best = got
            if best:
                out.append((place, *best))
        return out

    def _short_places(self, item: str, place: int, text: str, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """``(distance, start, length)`` of every place in a window within a short item's budget."""
        k, back, peq = self.budget[place], item[::-1], masks(item[::-1])
        for distance, end in ends_within(item, self.peq[place], text[lo:hi], k):
            head = text[max(lo, lo + end - len(item) - k):lo + end][::-1]
            for d, size in ends_within(back, peq, head, distance, from_start=True):
                if size:
                    yield d, lo + end - size, size

    @staticmethod
    def _whole_words(text: str, start: int, size: int) -> bool:
        """Short items must not begin or end inside a word."""
        before, after = text[start - 1:start], text[start + size:start + size + 1]
        return not ((before and before.isalnum() and text[start].isalnum())
                    or (after and after.isalnum() and text[start + size - 1].isalnum()))


_ITEMS: dict[str, Items] = {}


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, distance, start, length``: each pair of a document and an item that it holds.

    ``start`` and ``length`` are places in the normalised text. A document that holds an item several times gives
    the place of least distance, then the first. Null or blank texts and items match nothing. Items of less
    than ``2 * EDIT_SHARE`` characters must stand as whole words. Rows that repeat a document's id give one row each;
    repeated items likewise.
    """
    items = benchmark.where(F.col("text").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for block in range(blocks):
        rows = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(rows)  # BLOCK_CHARS, about

        def run(batches: Iterator[pa.RecordBatch], shared=shared, token=uuid.uuid4().hex):
            if token not in _ITEMS:  # one automaton per worker process, of the last block seen
                _ITEMS.clear()
                _ITEMS[token] = Items(shared.value)
            it = _ITEMS[token]
            names = ("doc_id", "item_id", "distance", "start", "length")
            for b in batches:
                found = []
                if not it.empty:
                    for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                        found += [(doc, it.ids[p], *m) for p, *m in it.matches(normalised(text))]
                yield dict(zip(names, zip(*found) if found else [[]] * 5))

        got = arrow_map(texts, run, "doc_id long, item_id long, distance int, start long, length int")
        out = got if out is None else out.unionByName(got)
    return out
