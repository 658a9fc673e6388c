"""Ordered computations that stay parallel when one key holds most rows.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. The
helpers here split each key's ordered sequence into buckets of the ordering
column (a time or sequence bucket), compute within ``(key, bucket)`` in
parallel, then carry a small per-bucket summary across buckets – the classic
two-pass parallel prefix. Only one summary row per (key, bucket) is ever held
per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cols(x):
    return [x] if isinstance(x, (str, Column)) else list(x)


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` where NULL keys match NULL keys; the keys appear once."""
    r = right.select(*[F.col(k).alias(f"_r{i}") if k in keys else F.col(k) for i, k in enumerate(right.columns)])
    names = {k: f"_r{i}" for i, k in enumerate(right.columns) if k in keys}
    cond = [left[k].eqNullSafe(r[names[k]]) for k in keys]
    return left.join(r, cond, "left").drop(*names.values())


def prefix_sums(df: DataFrame, keys, order, values: dict, bucket: Column, inclusive: bool = True) -> DataFrame:
    """Running sums of several ``values`` ({out: column}) per key in ``order``, in one pass.

    Sums are computed per (key, bucket), then offset by the totals of the
    earlier buckets of the same key (one small row per bucket). ``bucket`` must
    be monotone in ``order`` (e.g. ``floor(turn / 1024)`` or the date of a
    timestamp).
    """
    keys, order = _cols(keys), _cols(order)
    end = Window.currentRow if inclusive else -1
    b = df.withColumn("_bucket", bucket)
    tmp = {out: f"_v{i}" for i, out in enumerate(values)}
    for out, v in values.items():
        b = b.withColumn(tmp[out], F.col(v) if isinstance(v, str) else v)
    w_local = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = b
    for out in values:
        local = local.withColumn(f"{tmp[out]}_l", F.coalesce(F.sum(tmp[out]).over(w_local), F.lit(0)))
    totals = b.groupBy(*keys, "_bucket").agg(*[F.sum(tmp[o]).alias(f"{tmp[o]}_t") for o in values])
    w_b = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", *[
        F.coalesce(F.sum(f"{tmp[o]}_t").over(w_b), F.lit(0)).alias(f"{tmp[o]}_o") for o in values])
    out_df = _join_null_safe(local, offsets, [*keys, "_bucket"])
    for out in values:
        out_df = out_df.withColumn(out, F.col(f"{tmp[out]}_l") + F.col(f"{tmp[out]}_o"))
    drop = ["_bucket"] + [c for o in values for c in (tmp[o], f"{tmp[o]}_l", f"{tmp[o]}_o")]
    return out_df.drop(*drop)


def prefix_sum(df: DataFrame, keys, order, value, bucket: Column, out: str, inclusive: bool = True) -> DataFrame:
    """Running sum of one ``value`` per key in ``order`` (see ``prefix_sums``)."""
    return prefix_sums(df, keys, order, {out: value}, bucket, inclusive)


def carry_forward(df: DataFrame, keys, order, value: str, bucket: Column, out: str) -> DataFrame:
    """Last non-null ``value`` at or before each row per key (``last(..., ignorenulls)``)."""
    keys, order = _cols(keys), _cols(order)
    b = df.withColumn("_bucket", bucket)
    w_local = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumn("_local", F.last(value, ignorenulls=True).over(w_local))
    ord_struct = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    # One summary row per bucket: its last non-null value (``max_by`` skips rows
    # whose ordering is NULL, and a bucket of NULLs keeps a NULL summary).
    per_bucket = b.groupBy(*keys, "_bucket").agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), ord_struct)).alias("_bl"))
    w_b = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    summary = per_bucket.select(*keys, "_bucket", F.last("_bl", ignorenulls=True).over(w_b).alias("_carry"))
    return (_join_null_safe(local, summary, [*keys, "_bucket"])
            .withColumn(out, F.coalesce(F.col("_local"), F.col("_carry")))
            .drop("_bucket", "_local", "_carry"))


def with_halo(df: DataFrame, keys, order, bucket: Column, halo_rows: int) -> DataFrame:
    """Rows grouped by (key, bucket), each group preceded by a halo of the last
    ``halo_rows`` rows of the same key from earlier buckets.

    A window with at most ``halo_rows`` preceding rows, partitioned by
    ``(*keys, "_bucket")`` and ordered by ``order``, then gives exactly the
    per-key result; drop the rows with ``_halo`` afterwards. The halo is built
    from bounded pieces only: the last ``halo_rows`` rows of every bucket (a
    window group limit) and, per bucket, the ids of the ``halo_rows`` buckets
    before it (every listed bucket has at least one row, so they suffice).
    """
    keys, order = _cols(keys), _cols(order)
    b = df.withColumn("_bucket", bucket).withColumn("_halo", F.lit(False))
    if halo_rows <= 0:
        return b
    desc = [F.col(o).desc() if isinstance(o, str) else o.desc() for o in order]
    tails = top_k_per_group(b, [*keys, "_bucket"], desc, halo_rows, "_tail_rank").drop("_tail_rank")
    buckets = b.select(*keys, "_bucket").distinct()
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(-halo_rows, -1)
    sources = (buckets.withColumn("_prev", F.collect_list("_bucket").over(w))
               .select(*keys, F.col("_bucket").alias("_target"), F.explode("_prev").alias("_bucket")))
    halo = (tails.join(sources, [*keys, "_bucket"])
            .withColumn("_bucket", F.col("_target")).drop("_target"))
    halo = top_k_per_group(halo, [*keys, "_bucket"], desc, halo_rows, "_tail_rank").drop("_tail_rank")
    return b.unionByName(halo.withColumn("_halo", F.lit(True)))


def linear_scan(df: DataFrame, keys, order, decay: Column, gain: Column, start: Column, bucket: Column, out: str) -> DataFrame:
    """Linear recurrence ``s = decay * s_before + gain`` per key in ``order``; ``start`` is the state of the first row that
    has one (a NULL ``start`` leaves the state unset). Decay and gain must not be NULL.

    Steps of the recurrence compose: ``(a, b)`` then ``(c, d)`` is ``(a c, b c + d)``. Each (key, bucket) is scanned
    alone, which gives every row its composed step from the bucket's beginning and its state if none comes in. One
    composed step per bucket is then chained per key, and each row applies its own to the state that comes in. One Python
    call takes all groups of a task, a batch of rows at a time.
    """
    keys, order = _cols(keys), _cols(order)
    b = (df.withColumn("_bucket", bucket).withColumn("_a", decay.cast("double")).withColumn("_b", gain.cast("double"))
         .withColumn("_s", start.cast("double")))
    group = [*keys, "_bucket"]
    # a window leaves a task's groups one after the other, each in order; ``_n`` is 1 where one begins
    ranked = b.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))

    def scan(batches):
        import pyarrow as pa
        x, y, z = 1.0, 0.0, float("nan")
        for batch in batches:
            n, *columns = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("_n", "_a", "_b", "_s"))
            out = []
            for i, a, gain, begin in zip(n, *columns):
                if i == 1:
                    x, y, z = 1.0, 0.0, float("nan")
                x, y = x * a, a * y + gain
                z = begin if z != z else a * z + gain
                out.append((x, y, z))
            moved = dict(zip(("_a", "_b", "_s"), (pa.array(v, pa.float64()) for v in zip(*out)))) if out else {}
            yield pa.RecordBatch.from_arrays([moved.get(c, batch.column(c)) for c in batch.schema.names], schema=batch.schema)

    local = ranked.mapInArrow(scan, T.StructType([T.StructField(f.name, f.dataType, True) for f in ranked.schema.fields])).drop("_n")
    ord_struct = F.struct(*[F.col(o) for o in order])
    last = local.groupBy(*group).agg(F.max_by(F.struct("_a", "_b", "_s"), ord_struct).alias("_l"))
    steps = last.select(*group, "_l._a", "_l._b", "_l._s").withColumn(
        "_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_bucket").asc_nulls_last())))

    def chain(batches):
        import pyarrow as pa
        state = float("nan")
        for batch in batches:
            came = []
            for n, a, y, z in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("_n", "_a", "_b", "_s"))):
                state = float("nan") if n == 1 else state
                came.append(state)
                state = z if state != state else a * state + y
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in group), pa.array(came, pa.float64())], names=[*group, "_in"])

    come_in = steps.mapInArrow(chain, T.StructType([*(T.StructField(c, steps.schema[c].dataType, True) for c in group),
                                                    T.StructField("_in", T.DoubleType(), True)]))
    joined = _join_null_safe(local, come_in, group)
    state = F.nanvl("_in", F.lit(None))
    return (joined.withColumn(out, F.when(state.isNull(), F.nanvl("_s", F.lit(None))).otherwise(F.col("_a") * state + F.col("_b")))
            .drop("_bucket", "_a", "_b", "_s", "_in"))


def dense_rank_desc(df: DataFrame, value: str, out: str, partitions: int | None = None) -> DataFrame:
    """``dense_rank() over (order by value desc)`` without a single-partition window.

    Distinct values (hot values collapse to one row) are range-partitioned in
    descending order and sorted inside each partition; there
    ``monotonically_increasing_id`` is ``partition << 33 | row``, so the row
    part is the rank inside the partition and no second shuffle is needed.
    A partition's offset is the number of distinct values in the partitions
    before it (one row per partition). Rows with a NULL ``value`` get a NULL rank.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = (df.select(F.col(value).alias("_v")).where(F.col("_v").isNotNull()).distinct()
           .repartitionByRange(n, F.col("_v").desc())
           .sortWithinPartitions(F.col("_v").desc())
           .withColumn("_id", F.monotonically_increasing_id()))
    local = ids.select("_v", F.shiftright("_id", 33).alias("_pid"),
                       (F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_r"))
    counts = local.groupBy("_pid").agg(F.max("_r").alias("_n"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    # ``offsets`` has one row per range partition: a proven size bound.
    ranks = local.join(F.broadcast(offsets), "_pid").select("_v", (F.col("_r") + F.col("_off")).alias(out))
    return df.join(ranks, df[value] == ranks["_v"], "left").drop("_v")


def latest_per_key(df: DataFrame, keys, order) -> DataFrame:
    """W8 – the row with the greatest ``order`` per key, as one partial aggregate.

    ``max_by`` over a struct of all other columns aggregates map-side, so a hot
    key costs one row per map task in the shuffle.
    """
    keys, order = _cols(keys), _cols(order)
    others = [c for c in df.columns if c not in keys]
    ord_struct = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*others), ord_struct).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in others])


def top_k_per_group(df: DataFrame, keys, order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """W6 – ``row_number() <= k`` per group; planned as a partial + final WindowGroupLimit,

    so at most k rows per group and map task are shuffled.
    """
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
