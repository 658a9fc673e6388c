"""SimHash near-duplicates: popcount embedding, grid range-join, exact check, components (operator 7).

A fingerprint is embedded as its vector of bit counts over segments of two bits. Flipping one bit changes
one coordinate by one, so the Manhattan distance of two vectors is a lower bound of the Hamming distance.
The 32 coordinates are dealt into ``max_bits // 2 + 1`` parts (two at least); two fingerprints within ``max_bits`` have, in
at least one part, vectors at Manhattan distance 0 or 1 (pigeonhole). The grid has one cell per vector of a
part. Each occupied cell is joined to itself and to the occupied cells one step up, so only cell keys are
exploded and shuffled, never pairs of documents. Equal fingerprints are one row from the start.

Pairs of cells that hold one fingerprint each are verified on the JVM (``bit_count`` of the XOR). Larger cells
are dealt into blocks of at most about ``block`` fingerprints; each pair of blocks is one group, compared by
numpy, and only a spanning forest of its links leaves the task, so a dense cell costs neither one large task
nor all its pairs as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, connected_components, cut

_SEGMENTS = 32
#: Shingles hashed at a time, so that a very long text needs bounded memory.
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text, unsigned; zero if it has no word."""
    from itertools import islice

    import xxhash
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        m = min(_CHUNK, n - at)
        h = np.fromiter((digest(g, 42) for g in islice(grams, m)), dtype="<u8", count=m)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(m, 64).sum(axis=0, dtype=np.int64)
    bits = counts * 2 > n
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield {"doc_id": b.column("doc_id"), "fp": fps.view(np.int64)}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                     "doc_id long, fp long")


def _links_of_runs(max_bits: int):
    """Kernel: rows sorted by group; a spanning forest of the links of each group."""
    def forest(a: np.ndarray, b: np.ndarray):
        nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
        ia, ib = inv[:len(a)], inv[len(a):]
        parent = list(range(len(nodes)))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for at in range(0, len(a), 256):
            near = np.bitwise_count(a[at:at + 256, None] ^ b[None, :]) <= max_bits
            for i, j in zip(*np.nonzero(near)):
                x, y = find(ia[at + i]), find(ib[j])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((nodes[ia[at + i]], nodes[ib[j]]))
        return out

    def close(g, side, fp):
        """Links of complete runs held in the three arrays."""
        out = []
        for lo, hi in zip(*(lambda s: (s[:-1], s[1:]))(np.concatenate(
                [[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]]))):
            f, s = fp[lo:hi].view(np.uint64), side[lo:hi]
            a, b = f[s == 0], f[s == 1]
            if len(a):
                out += forest(a, b if len(b) else a)
        links = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return {"u": links[:, 0], "v": links[:, 1]}

    def run(batches: Iterator[pa.RecordBatch]):
        held = None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "side", "fp")]
            held = new if held is None else [np.concatenate(p) for p in zip(held, new)]
            last = int(np.searchsorted(held[0], held[0][-1], side="left"))  # the last run may go on
            if last:
                yield close(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield close(*held)

    return run


def links(fps: DataFrame, max_bits: int = 3, block: int = 2048) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints (column ``fp``) that differ in at most ``max_bits`` bits.

    Connectivity is complete: two fingerprints within the bound end in one component. Links inside a crowded
    pair of cells are reduced to a spanning forest.
    """
    parts = max(2, max_bits // 2 + 1)
    edge = [j * _SEGMENTS // parts for j in range(parts + 1)]

    def cell_of(j: int):  # one two-bit field per segment, 0 to 2
        bits = F.shiftrightunsigned("fp", 2 * edge[j]).bitwiseAND(F.lit((1 << 2 * (edge[j + 1] - edge[j])) - 1))
        even = F.lit(0x55555555)
        return bits.bitwiseAND(even) + F.shiftrightunsigned(bits, 1).bitwiseAND(even)

    cells_of_fp = (fps.select("fp", F.explode(F.array(
        *[F.struct(F.lit(j).alias("part"), cell_of(j).alias("c")) for j in range(parts)])).alias("x"))
        .select("x.part", "x.c", "fp"))
    cells = cells_of_fp.groupBy("part", "c").agg(F.count("*").alias("n"), F.min("fp").alias("one"))

    width = max(edge[j + 1] - edge[j] for j in range(parts))
    size = F.element_at(F.array(*[F.lit(edge[j + 1] - edge[j]) for j in range(parts)]), F.col("part") + 1)
    steps = [F.when((F.lit(s) < size) & (F.shiftrightunsigned("c", 2 * s).bitwiseAND(F.lit(3)) < 2),
                    F.col("c") + F.lit(1 << 2 * s)) for s in range(width)]
    up = cells.select("part", F.explode(F.array_compact(F.array(*steps))).alias("c"),
                      F.col("c").alias("a"), F.col("n").alias("na"), F.col("one").alias("fa"))
    cross = up.join(cells, ["part", "c"]).select("part", "a", "na", "fa", F.col("c").alias("b"),
                                                 F.col("n").alias("nb"), F.col("one").alias("fb"))
    pairs = cut(cross.where((F.col("na") > 1) | (F.col("nb") > 1)
                            | (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= max_bits))
                .unionByName(cells.where("n > 1").select("part", F.col("c").alias("a"), F.col("n").alias("na"),
                                                         F.col("one").alias("fa"), F.col("c").alias("b"),
                                                         F.col("n").alias("nb"), F.col("one").alias("fb"))),
                "simhash_cells")
    direct = pairs.where("na = 1 and nb = 1").select(F.col("fa").alias("u"), F.col("fb").alias("v"))

    blocks = lambda n: F.ceil(F.col(n) / F.lit(float(block))).cast("int")
    grid = (pairs.where("na > 1 or nb > 1")
            .select("*", blocks("na").alias("ka"), blocks("nb").alias("kb"))
            .select("*", F.explode(F.sequence(F.lit(0), F.col("ka") - 1)).alias("i"))
            .select("*", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(0),
                                              F.col("kb") - 1)).alias("j"))
            .select("part", "a", "b", "i", "j", F.xxhash64("part", "a", "b", "i", "j").alias("g")))
    sides = grid.select("part", F.col("a").alias("c"), F.col("i").alias("blk"), "g", F.lit(0).alias("side")).unionByName(
        grid.where("a <> b or i <> j").select("part", F.col("b").alias("c"), F.col("j").alias("blk"), "g",
                                              F.lit(1).alias("side")))
    members = cells_of_fp.join(cells.select("part", "c", "n"), ["part", "c"]).select(
        "part", "c", "fp", F.pmod(F.xxhash64("fp"), blocks("n").cast("long")).cast("int").alias("blk"))
    crowded = (sides.join(members, ["part", "c", "blk"]).select("g", "side", "fp")
               .repartition("g").sortWithinPartitions("g"))
    return direct.unionByName(arrow_map(crowded, _links_of_runs(max_bits), "u long, v long"))


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and into shingles of ``shingle`` words.
    Null and empty texts, and texts without a word, have fingerprint zero and are linked like any other.
    ``component_id`` is the smallest ``doc_id`` reachable over links of at most ``max_bits`` differing bits.
    Rows repeated in the input are repeated in the output; a null ``doc_id`` counts as larger than any.
    An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, shingle), "simhash_fp")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comps = connected_components(links(distinct.select("fp"), max_bits), "simhash_cc")
    linked = comps.join(distinct, comps.node == distinct.fp).select("fp", "root", "first_id")
    roots = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    class_of = (distinct.join(linked.select("fp", "root").join(roots, "root").select("fp", "component_id"), "fp", "left")
                .select("fp", F.coalesce("component_id", "first_id").alias("component_id")))
    return fps.join(class_of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
