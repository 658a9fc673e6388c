"""Table sinks (K1-K3): documented tables, overwrite that keeps comments, landing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _sql_string(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def declare_table(spark: SparkSession, name: str, schema: T.StructType, comment: str | None = None,
                  location: str | None = None, fmt: str = "parquet") -> None:
    """K1 – ``CREATE TABLE IF NOT EXISTS`` with column and table comments.

    Column comments come from ``StructField.metadata['comment']``. Give a
    ``location`` on a shared file system; the table then survives the session.
    """
    cols = []
    for f in schema.fields:
        c = f"`{f.name}` {f.dataType.simpleString()}"
        if f.metadata and f.metadata.get("comment"):
            c += f" COMMENT {_sql_string(f.metadata['comment'])}"
        cols.append(c)
    ddl = f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(cols)}) USING {fmt}"
    if comment:
        ddl += f" COMMENT {_sql_string(comment)}"
    if location:
        ddl += f" LOCATION {_sql_string(location)}"
    spark.sql(ddl)


def overwrite_table(df: DataFrame, name: str) -> None:
    """K2 – replace the contents of an existing table, matching columns by name.

    ``insertInto`` keeps the table definition (and so its comments), unlike
    ``saveAsTable(mode='overwrite')`` which re-creates a Parquet table.
    """
    spark = df.sparkSession
    target = [f.name for f in spark.table(name).schema.fields]
    present = {c.lower(): c for c in df.columns}
    missing = [c for c in target if c.lower() not in present]
    if missing:
        raise ValueError(f"columns missing for {name}: {missing}")
    df.select(*[df[f"`{present[c.lower()]}`"].alias(c) for c in target]).write.insertInto(name, overwrite=True)


def land(df: DataFrame, path: str, key: str = "DL_REQUEST_ID") -> None:
    """K3 – land responses under one directory per request (``key=value``).

    Dynamic partition overwrite replaces only the requests present in ``df``;
    readers prune to a request by filtering on ``key``.
    """
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(key).parquet(path))
