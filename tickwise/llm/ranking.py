"""Ranked lexical search for many items at once by sharing common subexpressions (operator 13).

An item's score for a document is a sum over its terms, and items have terms in common. The terms that occur in exactly
the same items form a class: its partial sum is computed once per document. Items are then sets of
classes. With the classes of most items first, the sets that items share are the paths of a frequent-pattern tree, and
the tree is the evaluation plan: a node is its parent's sum plus its class's, computed once per document for all items
below it; a class feeds every node that names it, so the plan is a DAG from classes to items.

The corpus is read once per block of items: every text becomes one row of the counts of those of its terms that some
item has (the partial accumulators, written to shared storage). Document frequencies and lengths come from these rows; a
second pass over them evaluates the DAG for batches of documents and keeps the best of every item per task. Only those
few rows are shuffled, never a document's scores for all items.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.operators.windows import top_k_per_group

from .common import arrow_map, cut

#: Characters of the items evaluated together; their terms and plan are sent to every task.
BLOCK_CHARS = 4_000_000
#: Sums held at a time in a task: documents of a batch times nodes of the plan.
CELLS = 4_000_000

# Letters and digits of ASCII and everything beyond it are parts of terms; only A-Z is lower-cased.
_TERM_BYTES = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text as UTF-8, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


class SharingPlan:
    """The evaluation DAG of a set of items given as sets of term numbers.

    ``class_of[t]`` is the class of term ``t``. Node 0 is the empty sum; node ``i`` is node ``parent[i]`` plus class
    ``adds[i]``, nodes are numbered by depth and ``levels`` are the ends of the depths. ``node_of[item]`` is an item's sum.
    """

    def __init__(self, items: list[Iterable[int]], n_terms: int):
        holders: dict[int, list[int]] = defaultdict(list)
        for i, item in enumerate(items):
            for t in set(item):
                holders[t].append(i)
        members: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for t in sorted(holders):
            members[tuple(holders[t])].append(t)
        ordered = sorted(members.items(), key=lambda m: (-len(m[0]), m[1]))  # shared by most items first
        self.class_of = np.full(n_terms, -1, dtype=np.int64)
        classes: list[list[int]] = [[] for _ in items]
        for c, (of, ts) in enumerate(ordered):
            self.class_of[ts] = c
            for i in of:
                classes[i].append(c)
        self.n_classes = len(ordered)

        parent, adds, levels = [0], [-1], [1]
        at = [0] * len(items)
        depth = 0
        going = [i for i, cs in enumerate(classes) if cs]
        while going:
            nodes: dict[tuple[int, int], int] = {}
            for i in going:
                step = (at[i], classes[i][depth])
                if step not in nodes:
                    nodes[step] = len(parent)
                    parent.append(step[0])
                    adds.append(step[1])
                at[i] = nodes[step]
            levels.append(len(parent))
            depth += 1
            going = [i for i in going if len(classes[i]) > depth]
        self.parent, self.adds = np.array(parent), np.array(adds)
        self.levels, self.node_of = levels, np.array(at, dtype=np.int64)

    def evaluate(self, sums: np.ndarray) -> np.ndarray:
        """All nodes' sums (node x document) from the classes' sums (class x document)."""
        out = np.zeros((len(self.parent), sums.shape[1]), dtype=np.int64)
        for lo, hi in zip(self.levels, self.levels[1:]):
            np.add(out[self.parent[lo:hi]], sums[self.adds[lo:hi]], out=out[lo:hi])
        return out


class _Best:
    """The ``k`` best documents of every item: higher score, then smaller id, null last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in range(items)]
        self.bar = np.zeros(items, dtype=np.int64)  # scores below never enter; 0 never does

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """``scores`` is item x document."""
        fits = (scores >= self.bar[:, None]) & (scores > 0)
        for i in np.flatnonzero(fits.any(axis=1)):
            at = np.flatnonzero(fits[i])
            s, m, d = (np.concatenate(p) for p in zip(self.rows[i], (scores[i, at], missing[at], ids[at])))
            order = np.lexsort((d, m, -s))[:self.k]
            self.rows[i] = (s[order], m[order], d[order])
            if len(order) == self.k:
                self.bar[i] = s[order[-1]]


def _postings(vocabulary) -> callable:
    def run(batches: Iterator[pa.RecordBatch]):
        number = vocabulary.value
        for b in batches:
            sizes, found, counts = [], [], []
            for text in b.column("text").to_pylist():
                ts = terms(text)
                hit = [(number[t], n) for t, n in Counter(ts).items() if t in number]
                sizes.append(len(ts))
                found.append([t for t, _ in hit])
                counts.append([n for _, n in hit])
            yield {"doc_id": b.column("doc_id"), "n": sizes, "terms": found, "tf": counts}

    return run


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]):
        plan, rows, weight, documents, length = shared.value
        best = _Best(len(rows), k)
        per = max(1, CELLS // (len(plan.parent) + plan.n_classes + 1))
        for whole in batches:
            for lo in range(0, whole.num_rows, per):
                b = whole.slice(lo, per)
                found = b.column("terms")
                t = found.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = b.column("tf").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(b.num_rows), np.diff(found.offsets.to_numpy()))
                m = np.array([10 + (90 * n * documents) // length for n in b.column("n").to_pylist()], dtype=np.int64)
                part = weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                sums = np.zeros((plan.n_classes, b.num_rows), dtype=np.int64)
                np.add.at(sums, (plan.class_of[t], doc), part)
                ids = b.column("doc_id")
                best.add(plan.evaluate(sums)[plan.node_of], ids.fill_null(0).to_numpy(zero_copy_only=False),
                         ids.is_null().to_numpy(zero_copy_only=False))
        for row, (s, m, d) in zip(rows, best.rows):
            if len(s):
                yield {"row": [row] * len(s), "doc_id": pa.array(d, mask=m), "score": s}

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score above 0 for each item.

    Equal scores are ranked by ascending ``doc_id``, null last. Null and empty texts have no term; such a document scores
    nothing, such an item finds nothing. Every row of ``items`` is an item, also one that repeats or lacks an id; every
    row of ``docs`` is a document. A table without a term gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = cut(items.select(F.col(id_col).cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
                 .withColumn("row", F.monotonically_increasing_id()), "items")
    chars = listed.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    found = spark.createDataFrame([], "row long, doc_id long, score long")
    for block in range(blocks):
        # about BLOCK_CHARS characters
        rows = listed.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "text").collect()
        sets = [sorted(set(terms(r.text))) for r in rows]
        number = {t: i for i, t in enumerate(sorted(set().union(*sets)))}
        if not number:
            continue
        plan = SharingPlan([[number[t] for t in s] for s in sets], len(number))
        postings = cut(arrow_map(texts, _postings(spark.sparkContext.broadcast(number)),
                                 "doc_id long, n long, terms array<int>, tf array<long>"), "postings")
        documents, length = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            continue
        weight = np.zeros(len(number), dtype=np.int64)
        for t, df in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the block's terms
            weight[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        shared = spark.sparkContext.broadcast((plan, [r.row for r in rows], weight, documents, length))
        found = found.unionByName(arrow_map(postings, _search(shared, k), "row long, doc_id long, score long"))
    best = top_k_per_group(found, "row", [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k)
    return best.join(listed.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


#: The same ranking in DuckDB SQL, item by item.
ORACLE_SQL = """
with doc_terms as (
  select row, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from (select row_number() over () as row, * from documents)),
sizes as (select row, count(*) as n from doc_terms group by row),
totals as (select count(*)::hugeint as docs, sum(n)::hugeint as len from sizes),
item_terms as (
  select distinct item_row, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from (select row_number() over () as item_row, * from benchmark)),
counts as (select row, doc_id, term, count(*)::hugeint as tf from doc_terms
           where term in (select term from item_terms) group by all),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w
            from counts, totals group by term, docs),
parts as (select row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // len))) as part
          from counts join weights using (term) join sizes using (row), totals),
scores as (select item_row, item_id, row, doc_id, sum(part)::bigint as score
           from item_terms join parts using (term) group by all having sum(part) > 0),
ranked as (select item_id, row_number() over (partition by item_row order by score desc, doc_id nulls last) as rank,
                  doc_id, score from scores)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10"""
