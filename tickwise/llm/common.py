"""Helpers shared by the corpus operators: reading, cutting lineage, hashing and connected components.

Conventions that hold for every operator of this subpackage:

* an operator selects the columns it needs first, so extra columns of any name never clash;
* a null text is treated as stated in each docstring, never dropped silently;
* intermediate tables are Parquet below ``spark.checkpoint.dir`` (shared storage), so a lost executor
  only costs a re-read, and no result passes through the driver unless its size is bounded.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.session import shared_dir

#: Rows per Arrow batch handed to Python; with texts of some kB a batch stays at a few MB.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small and ship this package to the executors, once per context."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    if not any(os.path.basename(p) == "tickwise_ship.zip" for p in sc._python_includes):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="tickwise-ship-"), "tickwise_ship.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(package)))
        sc.addPyFile(path)


#: Whether shuffle files go with the end of the query that wrote them, not with the driver's next garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: recomputation starts here, and the shuffles that
    led here are freed."""
    spark, schema = df.sparkSession, df.schema
    path = shared_dir(spark, "llm", name)
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once all that is made of them is written too."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(id_col: Column, modulus: int) -> Column:
    """CRC-32 of the id written as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` of a function from an iterator of record batches to an iterator of column dicts."""
    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow_schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            arrays = [pa.array(columns[f.name], type=f.type) for f in arrow_schema]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)

    return df.mapInArrow(run, spark_schema)


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Components of an undirected graph given as ``(u long, v long)`` rows.

    Returns ``(node, root)`` for every node of an edge between two different nodes; ``root`` is the smallest
    node of the component. Alternates the large-star and small-star steps: every node hands its larger
    neighbours, then its smaller ones, to the smallest node it knows. Each round is two aggregations and
    two joins on the edge list, written to shared storage; the number of rounds grows with the logarithm
    of the longest path. Self-loops, repeated edges and an empty edge list are fine.
    """
    def canonical(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = cut(canonical(edges), name)
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = cut(canonical(small), name)
        was, seen = seen, mark(now)
        if seen == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
