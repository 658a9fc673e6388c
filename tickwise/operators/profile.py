"""A11 over loads: data-gap profiles kept as mergeable sketches.

Each load of a table is profiled once, in one aggregation: rows, NULLs, a Theta sketch for the distinct values and, for
numbers, a KLL sketch for the quantiles of every column. The sketches are stored as binary, one folder per load;
the profile of any set of loads is merged from them without reading the data again. A Theta sketch of ``2**lg`` entries
is exact up to that many distinct values and then errs by about ``1 / sqrt(2**lg)``; a KLL sketch of size ``k`` errs in
rank by about ``1.7 / k``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LG_ENTRIES = 14
KLL_SIZE = 400
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
_LAYOUT = "column_name string, row_count long, null_count long, theta binary, kll binary"


def _sketched(df: DataFrame, c: str):
    """A column as a type that Theta sketches take."""
    kind = df.schema[c].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
        return F.col(f"`{c}`")
    return F.col(f"`{c}`").cast("bigint" if isinstance(kind, (T.ShortType, T.ByteType)) else "string")


def profile_loads(df: DataFrame, load: str, path: str, columns: list[str] | None = None) -> None:
    """Append the sketches of each load in ``df`` (values of column ``load``) below ``path``, one folder per load.

    Loads are independent: a new load reads and writes only its own rows, and loading one again replaces its folder.
    """
    columns = columns or [c for c in df.columns if c != load]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(columns):
        aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}"),
                 F.theta_sketch_agg(_sketched(df, c), F.lit(LG_ENTRIES)).alias(f"_t{i}")]
        if isinstance(df.schema[c].dataType, T.NumericType):
            aggs.append(F.kll_sketch_agg_double(F.col(f"`{c}`").cast("double"), F.lit(KLL_SIZE)).alias(f"_q{i}"))
    one = df.groupBy(F.col(f"`{load}`").cast("string").alias("load")).agg(*aggs)
    rows = F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col("_rows").alias("row_count"), F.col(f"_n{i}").alias("null_count"),
        F.col(f"_t{i}").alias("theta"),
        (F.col(f"_q{i}") if f"_q{i}" in one.columns else F.lit(None).cast("binary")).alias("kll"))
        for i, c in enumerate(columns)])
    (one.select("load", F.inline(rows)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("load").parquet(path))


def merged_profile(spark: SparkSession, path: str, loads: list[str] | None = None) -> DataFrame:
    """One row per column over all stored loads, or the given ones: ``column_name, row_count, null_count, null_rate,
    n_distinct, quantiles`` (at ``QUANTILES``; NULL for columns that are not numeric or have no value)."""
    table = spark.read.schema(_LAYOUT + ", load string").parquet(path)
    if loads is not None:
        table = table.where(F.col("load").isin(loads))
    has = F.kll_sketch_get_n_double(F.col("_k")) > 0
    return table.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
        F.theta_sketch_estimate(F.theta_union_agg("theta", F.lit(LG_ENTRIES))).alias("n_distinct"),
        F.count("kll").alias("_sketches"), F.kll_merge_agg_double("kll").alias("_k"),
    ).select(
        "column_name", "row_count", "null_count", (F.col("null_count") / F.col("row_count")).alias("null_rate"), "n_distinct",
        F.when((F.col("_sketches") > 0) & has,
               F.kll_sketch_get_quantile_double("_k", F.array(*[F.lit(q) for q in QUANTILES]))).alias("quantiles"))
