"""Hilbert-curve sharding with DataFrame functions only (operator 3).

Several metadata dimensions are quantised to ``2**bits`` levels each. A document's cell in that grid has an
index on the Hilbert curve, so cells that are close on the curve are close in every dimension. Documents are
ordered by curve index and the order is cut into runs of equal row counts: each shard covers a compact box of
every dimension, and file statistics on any of them prune shards.

The order needs no sort of all rows in one task: a histogram of (cell, sub-bucket of the id hash) gives every
group its offset, and rows are numbered inside their group. A cell that holds a third of all rows is spread
over groups of about ``GROUP_ROWS`` rows by a hash of the row. The histogram has one row per cell and group that has any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Rows numbered in one task, about.
GROUP_ROWS = 500_000


def _curve_steps(dims: int) -> tuple[list[int], list[int]]:
    """Tables of the curve: for state ``s`` and corner ``c`` at ``s * 2**dims + c``, the place of the corner
    along the curve and the next state. Derived from Gray codes; a state is (entry corner, direction)."""
    size = 1 << dims
    states, places, nexts, todo = {(0, 0): 0}, [], [], [(0, 0)]

    def rotate(x: int, by: int) -> int:  # right, in dims bits
        by %= dims
        return ((x >> by) | (x << (dims - by))) & (size - 1)

    def trailing_ones(i: int) -> int:
        return ((i + 1) & -(i + 1)).bit_length() - 1

    while todo:
        entry, direction = todo.pop(0)
        for corner in range(size):
            t = rotate(corner ^ entry, direction + 1)
            w, g = 0, t
            while g:  # inverse Gray code
                w ^= g
                g >>= 1
            e = 0 if w == 0 else (2 * ((w - 1) // 2)) ^ ((2 * ((w - 1) // 2)) >> 1)
            d = 0 if w == 0 else trailing_ones(w - 1 if w % 2 == 0 else w) % dims
            left = dims - (direction + 1) % dims
            following = (entry ^ rotate(e, left), (direction + d + 1) % dims)
            if following not in states:
                states[following] = len(states)
                todo.append(following)
            places.append(w)
            nexts.append(states[following])
    return places, nexts


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a cell given by its level (0 to ``2**bits - 1``) in every dimension."""
    dims = len(levels)
    places, nexts = _curve_steps(dims)
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")) for p, n in zip(places, nexts)])
    corners = F.array(*[sum((F.shiftright(x, b).bitwiseAND(F.lit(1)) * F.lit(1 << i) for i, x in enumerate(levels)),
                            F.lit(0)).cast("int") for b in range(bits - 1, -1, -1)])

    def step(acc: Column, corner: Column) -> Column:
        at = F.element_at(table, acc["s"] * F.lit(1 << dims) + corner + 1)
        return F.struct((acc["h"] * F.lit(1 << dims) + at["p"]).cast("long").alias("h"), at["n"].cast("int").alias("s"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("int").alias("s"))
    return F.aggregate(corners, start, step, lambda acc: acc["h"])


def _quantised(docs: DataFrame, numeric: list[str], labels: list[str], bits: int) -> list[Column]:
    """Levels: numbers by approximate quantiles (null: 0), labels by hash bits of the value (null: 0)."""
    top = 1 << bits
    marks = [i / top for i in range(1, top)]
    row = docs.agg(*[F.percentile_approx(F.col(c).cast("double"), marks, 1000).alias(f"q{i}")
                     for i, c in enumerate(numeric)]).first() if numeric else ()
    out = []
    for c, cuts in zip(numeric, row):
        level = F.lit(0)
        for x in cuts or []:
            level = level + F.when(F.col(c).cast("double") > F.lit(x), 1).otherwise(0)
        out.append(level.cast("int"))
    for c in labels:
        out.append(F.coalesce(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(top)).cast("int")
                              * F.col(c).isNotNull().cast("int"), F.lit(0)))
    return out


def hilbert_shards(docs: DataFrame, shards: int = 16, numeric: tuple[str, ...] = ("n_chars",),
                   labels: tuple[str, ...] = ("lang", "source"), bits: int = 4, group_rows: int = GROUP_ROWS,
                   row: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve``.

    Law ``rows``: shard counts differ by one at most. ``slot`` numbers a shard's rows from 0 without gaps in
    curve order. ``size`` is the UTF-8 length plus 1; a null text has size 1 and the checksum of an empty one.
    Null metadata fall into level 0. Rows equal in every column are numbered in any order, which gives the
    same rows. An empty table gives an empty result; fewer rows than shards leave shards empty. With ``row``, the name of
    a column of different values, it is returned too and decides among equal rows.
    """
    sub = max(16, -(-docs.count() // group_rows))  # groups of a cell that holds all rows
    own = F.col(f"`{row}`") if row else F.lit(0)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        hilbert_index(_quantised(docs, list(numeric), list(labels), bits), bits).alias("curve"), own.alias("row"),
        F.pmod(F.xxhash64("doc_id", text, own), F.lit(sub)).cast("int").alias("sub"))

    groups = rows.groupBy("curve", "sub").agg(F.count("*").alias("n"))
    cells = groups.groupBy("curve").agg(F.sum("n").alias("cell_n"))
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("curve", F.coalesce(F.sum("cell_n").over(before), F.lit(0)).alias("cell_at"),
                           F.sum("cell_n").over(Window.partitionBy(F.lit(0))).alias("total"))
    inside = Window.partitionBy("curve").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.join(offsets, "curve").select(
        "curve", "sub", "total", (F.col("cell_at") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("at"))
    order = Window.partitionBy("curve", "sub").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size", "row")
    placed = (rows.withColumn("k", F.row_number().over(order)).join(starts, ["curve", "sub"])
              .select("doc_id", "size", "text_crc32", "curve", "row", "total", (F.col("at") + F.col("k") - 1).alias("r")))
    # shard s holds the ranks from ceil(s * total / shards) on
    shard = F.expr(f"(r * {shards}) div total")
    first = F.expr(f"((shard * total) + {shards - 1}) div {shards}")
    return (placed.withColumn("shard", shard).withColumn("slot", F.col("r") - first)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                    F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
                    *([F.col("row").alias(row)] if row else [])))


def write_shards(docs: DataFrame, path: str, shards: int = 16, folder: str = "shard", **how) -> str:
    """Write the documents as one folder of files per shard, in curve order, for min/max pruning on read.

    Every row is written once, whatever its ``doc_id``, and the columns stay as they are. The folders are named
    ``<folder>=<n>``; where a column has that name already, underscores are added. Returns the name. A shard is cut into
    several sorted files by the session's partition size.
    """
    while folder in docs.columns:
        folder += "_"
    rows = cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                           F.monotonically_increasing_id().alias("id")), "shard_rows")
    row = folder + "_row"
    while row in docs.columns:
        row += "_"
    place = hilbert_shards(rows.select("doc.*", F.col("id").alias(row)), shards, row=row, **how).select(
        F.col(row).alias("id"), "shard", "slot")
    (rows.join(place, "id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .select("doc.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path))
    return folder
