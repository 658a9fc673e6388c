"""Versioned snapshots, change feed by diff, and upsert by key.

There is no transactional table format in this environment, so a table with
history is a directory of immutable versions ``<root>/version=<n>``. A version
is visible once its ``_SUCCESS`` marker exists (written last by the Parquet
committer); readers take the highest committed version. One writer per root.
A keyed index is a series of such versions that each hold only the hash buckets
a batch touched, with a manifest that names the version of every bucket.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

CHANGE_TYPE = "_change_type"
#: Order of the changes of a key within a feed.
SEQUENCE = "_sequence"
INSERT, UPDATE, DELETE = "insert", "update_postimage", "delete"


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def committed_versions(spark: SparkSession, root: str) -> list[int]:
    fs, jroot = _fs(spark, root)
    if not fs.exists(jroot):
        return []
    out = []
    for st in fs.listStatus(jroot):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("version="):
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(int(name.split("=", 1)[1]))
    return sorted(out)


def snapshot(df: DataFrame, root: str, version: int | None = None) -> int:
    """S10 – write ``df`` as the next (or the given) version of ``root``; returns the version.

    An uncommitted leftover of the same version (a failed earlier attempt) is
    replaced; a committed one is never overwritten.
    """
    versions = committed_versions(df.sparkSession, root)
    v = version if version is not None else ((versions[-1] + 1) if versions else 1)
    if v in versions:
        raise FileExistsError(f"version {v} already committed under {root}")
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/version={v}")
    return v


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Read one committed version (the latest by default)."""
    versions = committed_versions(spark, root)
    if not versions:
        raise FileNotFoundError(f"no committed version under {root}")
    v = versions[-1] if version is None else version
    if v not in versions:
        raise FileNotFoundError(f"version {v} not committed under {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/version={v}")


def _row_equal(cols: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b,
                  [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in cols], F.lit(True))


def changes_between(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """S11/J10 – row-level changes from ``old`` to ``new`` by primary key.

    Full outer join on the key; a row whose non-key columns differ (NULL-safe)
    is an update. Output: the post-image columns (pre-image for deletes) and
    ``_change_type`` ∈ {insert, update_postimage, delete}. Unchanged rows are
    not emitted.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in new.columns if c not in keys]
    o = old.withColumn("_there", F.lit(True)).alias("o")
    n = new.withColumn("_there", F.lit(True)).alias("n")
    joined = o.join(n, _row_equal(keys, "o", "n"), "full_outer")
    o_missing, n_missing = F.col("o._there").isNull(), F.col("n._there").isNull()
    change = (F.when(o_missing, F.lit(INSERT))
              .when(n_missing, F.lit(DELETE))
              .when(~_row_equal(cols, "o", "n"), F.lit(UPDATE)))
    image = [F.when(n_missing, F.col(f"o.`{c}`")).otherwise(F.col(f"n.`{c}`")).alias(c) for c in [*keys, *cols]]
    return joined.select(*image, change.alias(CHANGE_TYPE)).where(F.col(CHANGE_TYPE).isNotNull())


def last_changes(changes: DataFrame, key: str | list[str]) -> DataFrame:
    """The last change of each key by ``_sequence``; without that column the keys must be unique already."""
    if SEQUENCE not in changes.columns:
        return changes
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in changes.columns if c not in (*keys, SEQUENCE)]
    rank = Window.partitionBy(*keys).orderBy(F.col(SEQUENCE).desc())
    return changes.withColumn("_nth", F.row_number().over(rank)).where("_nth = 1").select(*keys, *rest)


def apply_changes(base: DataFrame, changes: DataFrame, key: str | list[str]) -> DataFrame:
    """U4 – upsert in one full outer join on the key (NULL keys match NULL keys).

    A key without a change keeps its row, an inserted or updated one takes the
    post-image, a deleted one goes. Several changes of a key in one batch are
    resolved by their ``_sequence`` (see ``last_changes``).
    """
    keys = [key] if isinstance(key, str) else list(key)
    b = base.withColumn("_there", F.lit(True)).alias("b")
    c = last_changes(changes, keys).alias("c")
    joined = b.join(c, _row_equal(keys, "b", "c"), "full_outer")
    changed = F.col(f"c.{CHANGE_TYPE}").isNotNull()
    return (joined.where(~changed | (F.col(f"c.{CHANGE_TYPE}") != F.lit(DELETE)))
            .select(*[F.when(changed, F.col(f"c.`{x}`")).otherwise(F.col(f"b.`{x}`")).alias(x) for x in base.columns]))


# --------------------------------------------------------------------------- keyed index
#: Hash buckets of an index; a batch rewrites only the buckets that its keys fall into.
INDEX_BUCKETS = 64
_MANIFEST = "_manifest.json"


def _index_state(spark: SparkSession, root: str) -> dict | None:
    """The newest committed manifest: bucket → version, schema and the last batch of every feed."""
    for version in reversed(committed_versions(spark, root)):
        fs, path = _fs(spark, f"{root.rstrip('/')}/version={version}/{_MANIFEST}")
        if fs.exists(path):
            stream = fs.open(path)
            try:
                return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
    return None


def _commit_index(spark: SparkSession, root: str, state: dict) -> None:
    """Write the manifest under a temporary name and rename it: the version counts from then on."""
    folder = f"{root.rstrip('/')}/version={state['version']}"
    fs, tmp = _fs(spark, f"{folder}/{_MANIFEST}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(json.dumps(state).encode()))
    finally:
        out.close()
    if not fs.rename(tmp, _fs(spark, f"{folder}/{_MANIFEST}")[1]):
        raise OSError(f"could not commit {folder}")


def _read_buckets(spark: SparkSession, root: str, state: dict, buckets=None) -> DataFrame:
    schema = T.StructType.fromJson(state["schema"])
    paths = [f"{root.rstrip('/')}/version={v}/_bucket={b}" for b, v in state["buckets"].items()
             if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """The index as of its newest committed version: each bucket from the version that wrote it last."""
    state = _index_state(spark, root)
    if state is None:
        raise FileNotFoundError(f"no committed index under {root}")
    return _read_buckets(spark, root, state)


def sync_index(spark: SparkSession, changes: DataFrame, root: str, key: str | list[str],
               transform=None, batch: tuple[str, int] | None = None) -> int:
    """K4 – apply a batch of changes to the bucketed index at ``root``; returns its version.

    The changes are reduced to the last one per key (``_sequence``), then
    ``transform`` (e.g. embedding) runs on the inserted and updated rows. Only
    the hash buckets of changed keys are rewritten, as the next free version.
    ``batch`` is (feed, number): a batch that the manifest has recorded for the
    same feed is a replay and changes nothing; a new feed (a fresh checkpoint)
    starts its own numbers, so none of its batches is mistaken for a replay.
    """
    keys = [key] if isinstance(key, str) else list(key)
    state = _index_state(spark, root)
    if state is not None and batch is not None and batch[1] <= state["feeds"].get(batch[0], -1):
        return state["version"]
    last = last_changes(changes, keys)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(INDEX_BUCKETS)).cast("int")
    touched = {r[0] for r in last.select(bucket.alias("b")).distinct().collect()}     # INDEX_BUCKETS at most
    live = last.where(F.col(CHANGE_TYPE) != F.lit(DELETE))
    live = transform(live) if transform is not None else live
    upserts = live.unionByName(last.where(F.col(CHANGE_TYPE) == F.lit(DELETE)), allowMissingColumns=True)
    if state is None:
        new = upserts.where(F.col(CHANGE_TYPE) != F.lit(DELETE)).drop(CHANGE_TYPE)
        versions = committed_versions(spark, root)
        state = {"version": versions[-1] if versions else 0, "buckets": {}, "feeds": {}}
    else:
        new = apply_changes(_read_buckets(spark, root, state, touched), upserts, keys)
    state["version"] += 1
    state["schema"] = new.schema.jsonValue()
    folder = f"{root.rstrip('/')}/version={state['version']}"
    (new.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite")
     .partitionBy("_bucket").parquet(folder))
    fs, jfolder = _fs(spark, folder)
    written = {int(st.getPath().getName().split("=", 1)[1]) for st in fs.listStatus(jfolder)
               if st.getPath().getName().startswith("_bucket=")}
    state["buckets"] = {b: v for b, v in state["buckets"].items() if int(b) not in touched} | {
        str(b): state["version"] for b in sorted(written)}
    if batch is not None:
        state["feeds"][batch[0]] = batch[1]
    _commit_index(spark, root, state)
    return state["version"]
