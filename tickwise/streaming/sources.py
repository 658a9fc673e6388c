"""Streaming sources over a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Files that one trigger takes at most, so that a backlog arrives in bounded batches.
MAX_FILES_PER_TRIGGER = 1000


def stream_table(spark: SparkSession, folder: str, name: str,
                 max_files_per_trigger: int = MAX_FILES_PER_TRIGGER) -> DataFrame:
    """Stream the Parquet table ``folder/name``, a directory of files or a single file.

    The schema is taken from the files present now (a stream source needs a
    fixed schema); later files must share it.
    """
    path = f"{folder.rstrip('/')}/{name}"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_available_now(df: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet",
                      output_mode: str = "append", state_partitions: int | None = None) -> None:
    """Process everything available now, exactly once (file sink + checkpoint), then stop.

    Stateful operators keep one state-store partition per shuffle partition,
    fixed when the query first starts. By default the count is the cluster's
    parallelism (not the session's batch setting); the session value is
    restored after the start.
    """
    spark = df.sparkSession
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions or spark.sparkContext.defaultParallelism))
    try:
        q = (df.writeStream.format(fmt).outputMode(output_mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(out_path))
    finally:
        spark.conf.set(key, old)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
