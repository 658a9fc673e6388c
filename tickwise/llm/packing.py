"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds (operator 9).

A document's token ids end with id 0. A document longer than a sequence is cut: its first piece takes the
remainder, the others fill a sequence each. Every piece longer than half a sequence opens one, as no two of
them fit together. Then rounds repeat over the open pieces and the gaps:

1. pieces and gaps are range-sorted together by size;
2. every task sweeps its range upwards: a gap takes the largest open piece at or below its size (so the piece
   goes to its nearest successor gap), and goes on with what is left of it while its range has such pieces;
3. pieces left over in lower ranges are matched to gaps left over in higher ones, like brackets: a gap takes as
   many pieces of a range as fit for certain, of the next ranks downwards, and goes on with lower ranges in the
   room that is left. The ranges' counts and extreme sizes (a few rows per task) fix which ranks meet, and an
   equi-join on the gap's part and rank brings them together;
4. gaps shrink, gaps below the smallest open piece close, and the next round sorts anew.

When there is no gap or a round places nothing, no open piece fits any gap; the largest open pieces then open as
many sequences as their total length needs at least.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut

#: Rows that one task sweeps, about.
SWEEP_ROWS = 250_000
#: Hash buckets of the pieces of one size, of which some open sequences.
_TIE_BUCKETS = 4096
# How byte-level BPE files of this kind cut a text into units before merging, and how they write bytes.
_UNITS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHOWN = (*range(33, 127), *range(161, 173), *range(174, 256))


def _byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Tokens as bytes with their ids, if the file is a plain byte-level BPE whose merges stand in the order of their ids.

    Merging the pair of the least id first is then what the file's merge list says.
    """
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model["type"] == "BPE" and spec.get("normalizer") is None and cutter.get("type") == "ByteLevel"
             and not cutter.get("add_prefix_space") and cutter.get("use_regex", True) and not model.get("ignore_merges")
             and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
    if not plain:
        return None
    hidden = [b for b in range(256) if b not in set(_SHOWN)]
    byte_of = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {t["content"] for t in spec["added_tokens"]}
    vocabulary = {w: i for w, i in model["vocab"].items() if w not in added}
    merged = [vocabulary.get("".join(m) if not isinstance(m, str) else m.replace(" ", "", 1)) for m in model["merges"]]
    singles = [vocabulary.get(c) for c in byte_of]
    if None in merged or None in singles or any(x >= y for x, y in zip(merged, merged[1:])) or max(singles) >= min(merged):
        return None
    if len(vocabulary) != len(merged) + 256:
        return None
    return {bytes(map(byte_of.__getitem__, w)): i for w, i in vocabulary.items()}


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit bytes, by a vocabulary file of ``tokenizers``.

    A plain byte-level BPE file is read as merge ranks for ``tiktoken``, which gives the same ids several times faster;
    texts that hold an added token written out, and other files, are encoded by ``tokenizers``.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.added = re.compile("|".join(added) if added else "(?!)")
        ranks = _byte_ranks(spec)
        self.fast = tiktoken.Encoding("file", pat_str=_UNITS, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def ids(self, text: str) -> list[int]:
        if self.fast is None or self.added.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [np.array(self.ids(t or ""), dtype="<u4").tobytes() for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece; a null text is an empty one (length 1)."""
    def run(batches: Iterator[pa.RecordBatch]):
        enc = encoder(tokenizer)
        for b in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                ids = memoryview(ids + b"\0\0\0\0")
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    to = at + ((n - at) % capacity or capacity) if at == 0 else at + capacity
                    for key, value in zip(out, (doc, piece, at, to - at, zlib.crc32(ids[4 * at:4 * to]))):
                        out[key].append(value)
                    at, piece = to, piece + 1
            yield out

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                     "doc_id long, piece int, start long, length long, ids_crc32 long")


_ROUND = "what int, pid long, sid long, size long, at long, part int, rank long"
_PLACED, _GAP, _ITEM = 0, 1, 2


def _sweep(capacity: int):
    """Kernel of step 2: rows ``(size, kind, id)`` sorted by size, pieces (kind 0) before gaps (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]):
        part = TaskContext.get().partitionId()
        sizes, ids = [], []          # open pieces, ascending
        gaps = 0
        for b in batches:
            out = []
            for size, kind, i in zip(*(b.column(c).to_pylist() for c in ("size", "kind", "id"))):
                if kind == 0:
                    sizes.append(size)
                    ids.append(i)
                    continue
                left = size
                while sizes:
                    k = bisect_right(sizes, left) - 1
                    if k < 0:
                        break
                    n, pid = sizes.pop(k), ids.pop(k)
                    out.append((_PLACED, pid, i, n, capacity - left, part, 0))
                    left -= n
                if left == size:     # no piece below it in this range
                    out.append((_GAP, 0, i, left, 0, part, gaps))
                    gaps += 1
                elif left:           # used; its rest is sorted anew in the next round
                    out.append((_GAP, 0, i, left, 0, part, -1))
            yield {f.split()[0]: list(col) for f, col in zip(_ROUND.split(", "), zip(*out) if out else [[]] * 7)}
        yield {"what": [_ITEM] * len(ids), "pid": ids, "sid": [0] * len(ids), "size": sizes, "at": [0] * len(ids),
               "part": [part] * len(ids), "rank": list(range(len(ids)))}

    return run


class _Range(NamedTuple):
    """What a range's sweep left over: gaps without a piece and pieces without a gap."""
    gaps: int = 0
    least_gap: int = 0
    items: int = 0
    greatest_item: int = 0


class _Bracket(NamedTuple):
    """Pieces of the ranks ``item_rank`` and downwards that meet gaps of the ranks ``gap_rank`` and upwards."""
    item_part: int
    item_rank: int
    items: int
    gap_part: int
    gap_rank: int
    gaps: int
    each: int  # pieces that a gap takes; the last one may get fewer


def _brackets(ranges: dict[int, _Range]) -> list[_Bracket]:
    """Who meets in step 3. Within a range the gaps left over lie below the pieces left over.

    A range's gaps form groups with room for certain. A group takes from the highest range whose pieces fit that
    room; the gaps served wait with the room that is left until the others had their turn. Serving a whole group
    at least halves its room and everything else empties a range, so there are some times as many steps as ranges.
    """
    out: list[_Bracket] = []
    owners: list[list[int]] = []     # part, pieces left; ascending
    sizes: list[int] = []            # their greatest pieces
    for part in sorted(ranges):
        here = ranges[part]
        groups = deque([(0, here.gaps, here.least_gap)] if here.gaps else [])
        while groups and owners:
            start, n, room = groups.popleft()
            k = bisect_right(sizes, room) - 1
            if k < 0:
                continue
            owner, left = owners[k]
            each = room // sizes[k]
            items = min(left, each * n)
            full, rest = divmod(items, each)
            served = full + (rest > 0)
            out.append(_Bracket(owner, left - 1, items, part, start, served, each))
            if served < n:
                groups.appendleft((start + served, n - served, room))
            if full:
                groups.append((start, full, room - each * sizes[k]))
            if rest:
                groups.append((start + full, 1, room - rest * sizes[k]))
            if left > items:
                owners[k][1] -= items
            else:
                del owners[k], sizes[k]
        if here.items:
            owners.append([part, here.items])
            sizes.append(here.greatest_item)
    return out


def _meet(rows: DataFrame, brackets: list[_Bracket], of_gap: bool) -> DataFrame:
    """Adds ``key``: a gap's part and rank, for the gap and the pieces it meets; -1 for rows that meet none."""
    by_part: dict[int, list] = {}
    for b in brackets:
        if of_gap:
            by_part.setdefault(b.gap_part, []).append((b.gap_rank, b.gap_rank + b.gaps, b.gap_part, 0, 0, 1))
        else:
            by_part.setdefault(b.item_part, []).append(
                (b.item_rank - b.items + 1, b.item_rank + 1, b.gap_part, b.gap_rank, b.item_rank, b.each))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            part, rank = (batch.column(c).to_numpy() for c in ("part", "rank"))
            key = np.full(batch.num_rows, -1, dtype=np.int64)
            for p in np.unique(part):
                for low, high, gap_part, gap_rank, base, each in by_part.get(int(p), ()):
                    m = (part == p) & (rank >= low) & (rank < high)
                    key[m] = (gap_part << 40) + gap_rank + np.abs(rank[m] - base) // each
            yield {"id": batch.column("sid" if of_gap else "pid"), "size": batch.column("size"), "key": key}

    return arrow_map(rows, run, "id long, size long, key long")


def _placed_in(items: DataFrame, gaps: DataFrame, capacity: int) -> DataFrame:
    """``pid, sid, at, left, last`` of the pieces that meet a gap: one after another, the largest first."""
    order = Window.partitionBy("key").orderBy(F.desc("size"), "id")  # capacity rows at most
    items = items.where("key >= 0").select(
        "key", F.col("id").alias("pid"), "size", F.sum("size").over(order).alias("upto"),
        F.lead("id").over(order).isNull().alias("last"))
    gaps = gaps.where("key >= 0").select("key", F.col("id").alias("sid"), F.col("size").alias("gap"))
    return items.join(gaps, "key").select(
        "pid", "sid", (F.lit(capacity) - F.col("gap") + F.col("upto") - F.col("size")).alias("at"),
        (F.col("gap") - F.col("upto")).alias("left"), "last")


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """``pid, sequence_id, offset`` for rows ``(pid, length)`` with 1 <= length <= capacity and unique pid."""
    opens = F.col("length") * 2 > capacity
    first = items.where(opens).select("pid", F.col("pid").alias("sid"), F.lit(0).cast("long").alias("at"))
    placed = [first]
    gaps = items.where(opens & (F.col("length") < capacity)).select(
        F.col("pid").alias("id"), (F.lit(capacity) - F.col("length")).alias("size"))
    rest = items.where(~opens).select(F.col("pid").alias("id"), F.col("length").alias("size"))
    n_rest, least = rest.agg(F.count("*"), F.min("size")).first()
    n_gaps = gaps.where(F.col("size") >= F.lit(least)).count() if n_rest else 0
    while n_rest:
        if not n_gaps:
            rest, gaps, opened, n_seeds = _open(rest, gaps, capacity)
            placed.append(opened)
            n_rest, n_gaps = n_rest - n_seeds, n_seeds
            continue
        both = rest.select("size", F.lit(0).alias("kind"), "id").unionByName(
            gaps.where(F.col("size") >= least).select("size", F.lit(1).alias("kind"), "id"))
        swept = cut(arrow_map(both.repartitionByRange(-(-(n_rest + n_gaps) // SWEEP_ROWS), "size", "kind", "id")
                              .sortWithinPartitions("size", "kind", "id"), _sweep(capacity), _ROUND), "pack")
        stats = swept.groupBy("what", "part").agg(  # a few rows per range
            F.count("*").alias("n"), F.count_if(F.col("rank") >= 0).alias("ranked"),
            F.min("size").alias("least"), F.max("size").alias("greatest"),
            F.min(F.when(F.col("rank") >= 0, F.col("size"))).alias("least_ranked")).collect()
        ranges = {p: _Range() for p in {r.part for r in stats}}
        for r in stats:
            if r.what == _GAP and r.ranked:
                ranges[r.part] = ranges[r.part]._replace(gaps=r.ranked, least_gap=r.least_ranked)
            elif r.what == _ITEM:
                ranges[r.part] = ranges[r.part]._replace(items=r.n, greatest_item=r.greatest)
        brackets = _brackets(ranges)
        now = swept.where(F.col("what") == _PLACED)
        n_placed = sum(r.n for r in stats if r.what == _PLACED)
        if n_placed:
            placed.append(now.select("pid", "sid", "at"))
        left = [r for r in stats if r.what == _ITEM]
        n_rest, n_gaps = sum(r.n for r in left), sum(r.n for r in stats if r.what == _GAP)
        if not n_rest:
            break
        least = min(r.least for r in left)
        rest = swept.where(F.col("what") == _ITEM)
        gaps = swept.where(F.col("what") == _GAP)
        if brackets:
            met_items, met_gaps = _meet(rest, brackets, False), _meet(gaps, brackets, True)
            met = cut(_placed_in(met_items, met_gaps, capacity), "pack_met")
            placed.append(met.select("pid", "sid", "at"))
            rest = met_items.where("key < 0").select("id", "size")
            gaps = met_gaps.where("key < 0").select("id", "size").unionByName(
                met.where("last and left > 0").select(F.col("sid").alias("id"), F.col("left").alias("size")))
            n_rest -= sum(b.items for b in brackets)
        else:
            rest = rest.select(F.col("pid").alias("id"), "size")
            gaps = gaps.select(F.col("sid").alias("id"), "size")
            if not n_placed:
                n_gaps = 0
        if n_gaps and least > max(r.greatest for r in stats if r.what == _GAP):
            n_gaps = 0
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out.select("pid", F.col("sid").alias("sequence_id"), F.col("at").alias("offset"))


def _open(rest: DataFrame, gaps: DataFrame, capacity: int):
    """Open sequences with the largest pieces: as many as the open pieces' total length needs, about.

    Of the pieces of the last size that is needed, whole hash buckets are taken, so at most a bucket's share of
    them is missing (or one bucket too much, where it is the first); later rounds open what is still needed.
    """
    hist = sorted(((r["size"], r.n) for r in rest.groupBy("size").agg(  # capacity rows at most
        F.count("*").alias("n")).collect()), reverse=True)
    want = -(-sum(s * n for s, n in hist) // capacity)
    above = 0
    for size, n in hist:
        if above + n >= want:
            break
        above += n
    tie, bucket = F.col("size") == size, F.pmod(F.xxhash64("id"), F.lit(_TIE_BUCKETS))
    bound = 0
    for b, n in sorted((r.b, r.n) for r in rest.where(tie).groupBy(bucket.alias("b")).agg(
            F.count("*").alias("n")).collect()):
        if above and above + n > want:
            break
        above, bound = above + n, b + 1
    seed = (F.col("size") > size) | (tie & (bucket < bound))
    marked = cut(rest.select("id", "size", seed.alias("seed")), "pack_open")
    seeds = marked.where("seed")
    n_seeds = seeds.count()
    # no open piece fits a gap from before, so those are closed
    gaps = seeds.where(F.col("size") < capacity).select("id", (F.lit(capacity) - F.col("size")).alias("size"))
    opened = seeds.select(F.col("id").alias("pid"), F.col("id").alias("sid"), F.lit(0).cast("long").alias("at"))
    return marked.where("not seed").select("id", "size"), gaps, opened, n_seeds


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text is empty and gives one piece of length 1 (the closing id). Rows repeated in the input are
    packed each on their own. An empty table gives an empty result. ``tokenizer`` is the path of a
    ``tokenizers`` file that every executor can read.
    """
    found = cut(pieces(docs, tokenizer, capacity).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    where = pack(found.select("pid", "length"), capacity)
    return found.join(where, "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
