"""Scans of vendor responses and configuration files.

All readers are Spark readers: files are split by Spark, decoded on executors
and never pass through the driver. gzip is handled by the Hadoop codec chosen
from the file extension (a ``.gz`` file is not splittable, so one task reads
it; repartition afterwards if it is large).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import media_type

# ---------------------------------------------------------------------------
# Media types of vendor responses and the marked-text markers.
# ---------------------------------------------------------------------------
CONTENT_TYPE_CSV = "text/csv"
CONTENT_TYPE_MARKED = "text/vnd.blp.dl.std"
CONTENT_TYPE_JSON = "application/json"
CONTENT_TYPE_TAR = "application/x-tar"
START_OF_DATA = "START-OF-DATA"
END_OF_DATA = "END-OF-DATA"
COMMENT_PREFIX = "#"
TOOL_TYPES = ("vector", "function", "genie")
ERR_LISTING = "Could not parse response content"
ERR_TOOL = "Unsupported tool [%s], invalid format [%s]"
ERR_FORMAT = "Unsupported format {}"

POSITIONS_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType(), True),
    T.StructField("number_of_shares", T.LongType(), True),
])


POSITIONS_SCHEMA_DOC = T.StructType([
    T.StructField("ticker", T.StringType(), True, {"comment": "Vendor identifier of the equity, e.g. 'BG US Equity'"}),
    T.StructField("number_of_shares", T.LongType(), True, {"comment": "Shares held"}),
])


def scan_positions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """S1 – positions from a JSON array file (``multi_line``) or JSON lines; explicit schema.

    A top-level array in a file becomes one row per element; nothing is read
    through the driver.
    """
    return spark.read.schema(POSITIONS_SCHEMA).option("multiLine", multi_line).json(path)


def scan_vendor_json(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None,
                     multi_line: bool = True) -> DataFrame:
    """S2 – JSON response: a top-level array becomes one row per element."""
    reader = spark.read.option("multiLine", multi_line).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def scan_vendor_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, header: bool = True,
                    sep: str = ",", corrupt_col: str | None = None) -> DataFrame:
    """S3 – CSV response with a declared schema (no inference)."""
    reader = spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    if corrupt_col:
        schema = T.StructType(schema.fields + [T.StructField(corrupt_col, T.StringType(), True)])
        reader = reader.option("columnNameOfCorruptRecord", corrupt_col)
    return reader.schema(schema).csv(path)


def _positioned_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines with a sortable position that follows the order inside each file.

    Lines of one file split are read by one task in file order, so
    (block start, monotonically increasing id) orders them; splits of one
    file are ordered by their block start.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("seq")).alias("pos"),
        F.col("value"),
    )


def scan_marked_text(spark: SparkSession, path: str | list[str], start: str = START_OF_DATA, end: str = END_OF_DATA,
                     comment: str = COMMENT_PREFIX, max_broadcast_files: int = 100_000) -> DataFrame:
    """S4 – keep the lines after the first start marker up to the next end marker.

    A file without start marker yields nothing; without end marker, the data
    runs to the end of the file; lines starting with ``comment`` are dropped.
    Only the marker lines are aggregated; the data lines are filtered in place
    against per-file bounds (one small row per file).
    """
    lines = _positioned_lines(spark, path)
    markers = lines.where(F.col("value").isin(start, end))
    starts = markers.where(F.col("value") == start).groupBy("file").agg(F.min("pos").alias("start_pos"))
    ends = (markers.where(F.col("value") == end).join(starts, "file")
            .where(F.col("pos") > F.col("start_pos"))
            .groupBy("file").agg(F.min("pos").alias("end_pos")))
    bounds = starts.join(ends, "file", "left")
    # One bound row per input file: the file count is known before running, so
    # the broadcast is size-checked; beyond the limit a shuffle join is used.
    n_files = len(lines.inputFiles())
    if n_files <= max_broadcast_files:
        bounds = F.broadcast(bounds)
    data = lines.join(bounds, "file")
    keep = (F.col("pos") > F.col("start_pos")) & (F.col("end_pos").isNull() | (F.col("pos") < F.col("end_pos")))
    keep = keep & ~F.col("value").startswith(comment) if comment else keep
    return data.where(keep).select("file", "pos", "value")


def split_marked_lines(df: DataFrame, names: list[str], sep: str = "|", keep: list[str] | None = None) -> DataFrame:
    """Split the data lines of a marked-text response into string columns."""
    import re
    parts = F.split(F.col("value"), re.escape(sep))
    return df.select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)], *(keep or []))


def scan_tar_parquet(spark: SparkSession, path: str | list[str], schema: T.StructType,
                     rows_per_batch: int = 65_536) -> DataFrame:
    """S5 – Parquet members of tar archives; non-file members skipped; ``member`` keeps the name.

    Only the archive paths are scanned (``binaryFile`` splits them over tasks by
    size). Each task opens its archives as streams on the executor and reads the
    members one after another; a member is decoded in memory (Parquet needs
    random access) and emitted in record batches of ``rows_per_batch``, so
    nothing larger than one member is held and nothing is written to disk.
    """
    out_schema = T.StructType(schema.fields + [T.StructField("member", T.StringType(), True)])
    names = [f.name for f in schema.fields]

    def unpack(batches):
        import tarfile

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs
        for pdf in batches:
            for archive in pdf["path"]:
                filesystem, fpath = fs.FileSystem.from_uri(archive)
                with filesystem.open_input_stream(fpath) as stream, tarfile.open(fileobj=stream, mode="r|") as tar:
                    for member in tar:
                        if not member.isfile():
                            continue
                        fh = tar.extractfile(member)
                        if fh is None:
                            continue
                        table = pq.read_table(pa.BufferReader(fh.read()))
                        for n in names:
                            if n not in table.column_names:
                                table = table.append_column(n, pa.nulls(table.num_rows))
                        table = table.select(names)
                        for batch in table.to_batches(max_chunksize=rows_per_batch):
                            part = batch.to_pandas()
                            part["member"] = member.name
                            yield part

    archives = spark.read.format("binaryFile").load(path).select("path")
    return archives.mapInPandas(unpack, out_schema)


def scan_response(spark: SparkSession, content_type: str, path: str | list[str],
                  schema: T.StructType | None = None, marked_columns: list[str] | None = None,
                  json_multi_line: bool = True) -> DataFrame:
    """S7 – decode landed responses of one media type (text before ``;``).

    ``path`` may be a list: all responses of one type are read by one reader.
    """
    kind = content_type.split(";")[0]
    paths = [path] if isinstance(path, str) else list(path)
    src = F.col("_metadata.file_path").alias("source_file")
    if kind == CONTENT_TYPE_CSV:
        if schema is None:
            raise ValueError("CSV responses need a schema")
        return scan_vendor_csv(spark, paths, schema).select("*", src)
    if kind == CONTENT_TYPE_JSON:
        return scan_vendor_json(spark, paths, schema, multi_line=json_multi_line).select("*", src)
    if kind == CONTENT_TYPE_MARKED:
        lines = scan_marked_text(spark, paths).withColumnRenamed("file", "source_file")
        if not marked_columns:
            return lines
        split = split_marked_lines(lines, marked_columns, keep=["source_file"])
        if schema is None:
            return split
        from .schemas import conform
        return conform(split, schema, keep=["source_file"]).drop("_corrupt_fields")
    if kind == CONTENT_TYPE_TAR:
        if schema is None:
            raise ValueError("archive responses need a schema")
        return scan_tar_parquet(spark, paths, schema)
    raise ValueError(ERR_FORMAT.format(content_type))


def scan_responses(spark: SparkSession, manifest: DataFrame, schema: T.StructType,
                   marked_columns: list[str] | None = None, json_multi_line: bool = True) -> DataFrame:
    """S7/U3 – decode every landed response listed in ``manifest`` (content_type, output_dir).

    The manifest is split by media type; each type is read by one reader over
    all of its directories, and the (at most four) parts are unioned by name;
    ``source_file`` (``member`` for archives) tells where a row came from.
    Only the directory list – metadata that a file scan lists on the driver
    anyway – is brought to the driver.
    """
    groups = (manifest.select(media_type("content_type").alias("kind"), "output_dir")
              .groupBy("kind").agg(F.sort_array(F.collect_set("output_dir")).alias("dirs"))
              .orderBy("kind").collect())
    if not groups:
        raise ValueError("empty manifest")
    parts = [scan_response(spark, row["kind"], row["dirs"], schema, marked_columns, json_multi_line)
             for row in groups]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


MANIFEST_SCHEMA = T.StructType([T.StructField("contains", T.ArrayType(T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("metadata", T.StructType([T.StructField("DL_REQUEST_ID", T.StringType())])),
    T.StructField("headers", T.StructType([T.StructField("Digest", T.StringType()),
                                           T.StructField("Content-Type", T.StringType())])),
])))])


def scan_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """S12 – response listing pages → one typed row per response, with its page order.

    ``multi_line``: one listing document per file (as served); False reads one
    listing page per line.
    """
    pages = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", multi_line).json(path)
    return (pages.select(F.col("_metadata.file_path").alias("page"), F.posexplode("contains").alias("idx", "r"))
            .select("page", "idx",
                    F.col("r.key").alias("key"),
                    F.col("r.metadata.DL_REQUEST_ID").alias("DL_REQUEST_ID"),
                    F.col("r.headers.Digest").alias("digest"),
                    F.col("r.headers.`Content-Type`").alias("content_type")))


CATALOGS_SCHEMA = T.StructType([T.StructField("contains", T.ArrayType(T.StructType([
    T.StructField("identifier", T.StringType()), T.StructField("description", T.StringType())])))])


def scan_catalogs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """S13 – ``contains[].identifier → description``; the last duplicate wins.

    A listing without ``contains`` raises (checked on the executors).
    """
    pages = spark.read.schema(CATALOGS_SCHEMA).option("multiLine", multi_line).json(path)
    checked = pages.select(
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                 F.monotonically_increasing_id()).alias("page"),
        F.when(F.col("contains").isNull(), F.raise_error(F.lit(ERR_LISTING)))
        .otherwise(F.col("contains")).alias("contains"))
    items = checked.select("page", F.posexplode("contains").alias("idx", "c"))
    return (items.groupBy(F.col("c.identifier").alias("identifier"))
            .agg(F.max_by(F.col("c.description"), F.struct("page", "idx")).alias("description")))


TOOL_SCHEMA = T.StructType([
    T.StructField("tool_id", T.StringType()), T.StructField("tool_name", T.StringType()),
    T.StructField("tool_enabled", T.BooleanType()), T.StructField("tool_type", T.StringType()),
    T.StructField("tool_description", T.StringType()), T.StructField("tool_coordinates", T.StringType()),
    T.StructField("tool_description_details", T.StringType()),
    T.StructField("tool_columns", T.ArrayType(T.StringType())),
])
TOOL_CATALOG_TYPE = T.MapType(T.StringType(), T.ArrayType(TOOL_SCHEMA))


def tool_catalog_from_json(text_df: DataFrame, text_col: str = "value") -> DataFrame:
    """S14 – JSON map provider → tools, flattened; provider and list order kept.

    An unknown ``tool_type`` fails the job with the tool's id, as in the
    configuration loader of the application.
    """
    parsed = text_df.select(F.from_json(F.col(text_col), TOOL_CATALOG_TYPE).alias("m"))
    providers = parsed.select(F.posexplode(F.map_entries("m")).alias("provider_pos", "e"))
    tools = providers.select("provider_pos", F.col("e.key").alias("provider"),
                             F.posexplode("e.value").alias("tool_pos", "t"))
    flat = tools.select("provider_pos", "provider", "tool_pos", "t.*")
    bad = ~F.col("tool_type").isin(*TOOL_TYPES) | F.col("tool_type").isNull()
    return flat.withColumn(
        "tool_type",
        F.when(bad, F.raise_error(F.format_string(ERR_TOOL,
                                                  F.col("tool_id"), F.coalesce(F.col("tool_type"), F.lit("null")))))
        .otherwise(F.col("tool_type")))


def scan_tool_catalog(spark: SparkSession, path: str) -> DataFrame:
    """S14 – read the tool catalog file (one JSON document per file)."""
    text = spark.read.option("wholetext", True).text(path)
    return tool_catalog_from_json(text)
