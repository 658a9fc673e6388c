"""File round trips: responses, listings and tables written from the generated
tables to the shared folder, then read back with the engine's readers.

Every query writes under ``shared_dir(spark)`` (below ``spark.checkpoint.dir``),
a fresh folder per call, and returns the lazily read result. The oracle is the
SQL view the files were written from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest_algorithm, digest_value, media_type
from ..session import shared_dir
from ..sinks import snapshots as snap
from ..sinks import tables as tb
from ..sources import readers as rd
from . import views as V
from .queries import _CT_SQL, _DAY_REQ_SQL, _manifest_rows, query

PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
PART_SQL_ALL = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"
MARKED_HEADER = ["START-OF-FILE", "PROGRAMNAME=getdata", "START-OF-DATA", "# fields: " + "|".join(PART_COLS)]
MARKED_TRAILER = ["END-OF-DATA", "0|ignored|after|end|0|0", "END-OF-FILE"]
JSON_TYPES = ["ECONOMY", "SMALL"]          # part types landed as JSON in the dispatch round trip
CSV_TYPES = ["MEDIUM", "LARGE"]            # … as CSV; the remaining types as marked text


def _part(spark, d) -> DataFrame:
    return V.read(spark, d, "part").select(*PART_COLS)


def write_marked_text(df: DataFrame, path: str, group: str, cols: list[str],
                      rows_per_file: int = 50_000) -> None:
    """Write ``df`` as marked-text files, each framed by its own markers.

    The number of files per value of ``group`` follows the row count (rows are
    dealt by a hash of the first column), so a large group is written by several
    tasks. Header,
    data and trailer lines form one DataFrame, clustered by file and sorted by
    (section, line) inside each partition; the writer keeps that order.
    """
    files_per_group = max(2, -(-df.count() // rows_per_file))
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    file_key = F.concat_ws("-", F.col(group).cast("string"),
                           F.pmod(F.xxhash64(F.col(cols[0])), F.lit(files_per_group)).cast("string"))
    data = df.select(file_key.alias("_g"), F.lit(1).alias("_sec"), F.col(cols[0]).cast("long").alias("_seq"),
                     line.alias("value"))
    frame_rows = [(0, i, v) for i, v in enumerate(MARKED_HEADER)] + [(2, i, v) for i, v in enumerate(MARKED_TRAILER)]
    frame = F.array(*[F.struct(F.lit(sec).alias("_sec"), F.lit(i).cast("long").alias("_seq"),
                               F.lit(v).alias("value")) for sec, i, v in frame_rows])
    # one row per file, expanded into its header and trailer lines (no join)
    framed = data.select("_g").distinct().select("_g", F.inline(frame))
    allrows = data.unionByName(framed.select("_g", "_sec", "_seq", "value"))
    (allrows.repartition("_g").sortWithinPartitions("_g", "_sec", "_seq")
     .select("_g", "value").write.partitionBy("_g").text(path))


def write_tar_archives(df: DataFrame, path: str, rows_per_archive: int = 50_000, members_per_archive: int = 2) -> int:
    """Write ``df`` as tar archives of Parquet members (plus a directory entry), built on the executors.

    The number of archives follows the row count, so one archive – the unit a
    single task must build – holds about ``rows_per_archive`` rows whatever the
    table size. ``path`` is opened through pyarrow's file systems (local, HDFS,
    object stores). Archive names are deterministic, so a retried task rewrites
    the same file. Returns the number of archives.
    """
    n_archives = max(1, -(-df.count() // rows_per_archive))
    key = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(n_archives)).alias("_archive")
    jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    conf = df.sparkSession._jsc.hadoopConfiguration()
    uri = jpath.getFileSystem(conf).makeQualified(jpath).toString()     # scheme of the default file system
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    cols = df.columns
    out_schema = "archive long, n_rows long"

    def build(pdf):
        import io
        import tarfile

        import pandas as pd
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs
        archive = int(pdf["_archive"].iloc[0])
        data = pdf[cols].reset_index(drop=True)
        buf = io.BytesIO()
        with tarfile.open(fileobj=buf, mode="w") as tar:
            d = tarfile.TarInfo("data")
            d.type = tarfile.DIRTYPE
            tar.addfile(d)
            step = -(-len(data) // members_per_archive)
            for m in range(members_per_archive):
                part = data.iloc[m * step:(m + 1) * step]
                if part.empty:
                    continue
                pb = io.BytesIO()
                pq.write_table(pa.Table.from_pandas(part, preserve_index=False), pb)
                info = tarfile.TarInfo(f"data/member-{m}.parquet")
                info.size = len(pb.getvalue())
                tar.addfile(info, io.BytesIO(pb.getvalue()))
        filesystem, root = fs.FileSystem.from_uri(uri)
        filesystem.create_dir(root, recursive=True)
        with filesystem.open_output_stream(f"{root}/archive-{archive:05d}.tar") as f:
            f.write(buf.getvalue())
        return pd.DataFrame({"archive": [archive], "n_rows": [len(data)]})

    written = df.select("*", key).groupBy("_archive").applyInPandas(build, out_schema)
    written.write.format("noop").mode("overwrite").save()
    return n_archives


@query("scan_tar_parquet", PART_SQL_ALL)
def q_scan_tar_parquet(spark, d):
    path = shared_dir(spark, "tar")
    part = _part(spark, d)
    write_tar_archives(part, path, rows_per_archive=500)
    return rd.scan_response(spark, "application/x-tar", path, part.schema).select(*PART_COLS)


@query("scan_vendor_json", PART_SQL_ALL)
def q_scan_vendor_json(spark, d):
    path = shared_dir(spark, "json")
    part = _part(spark, d)
    part.write.option("compression", "gzip").json(path)
    return rd.scan_vendor_json(spark, path, part.schema, multi_line=False).select(*PART_COLS)


@query("scan_vendor_csv", PART_SQL_ALL)
def q_scan_vendor_csv(spark, d):
    path = shared_dir(spark, "csv")
    part = _part(spark, d)
    part.write.option("header", True).csv(path)
    return rd.scan_vendor_csv(spark, path, part.schema).select(*PART_COLS)


@query("scan_marked_text", PART_SQL_ALL)
def q_scan_marked_text(spark, d):
    path = shared_dir(spark, "marked")
    part = _part(spark, d)
    write_marked_text(part, path, "p_type", PART_COLS)
    lines = rd.scan_marked_text(spark, path)
    from ..sources.schemas import conform
    return conform(rd.split_marked_lines(lines, PART_COLS), part.schema).select(*PART_COLS)


@query("scan_dispatch", PART_SQL_ALL)
def q_scan_dispatch(spark, d):
    root = shared_dir(spark, "responses")
    part = _part(spark, d)
    j, c = f"{root}/json", f"{root}/csv"
    m = f"{root}/marked"
    part.where(F.col("p_type").isin(*JSON_TYPES)).write.json(j)
    part.where(F.col("p_type").isin(*CSV_TYPES)).write.option("header", True).csv(c)
    write_marked_text(part.where(~F.col("p_type").isin(*(JSON_TYPES + CSV_TYPES))), m, "p_type", PART_COLS)
    manifest = spark.createDataFrame(
        [("application/json; charset=utf-8", j), ("text/csv", c), ("text/vnd.blp.dl.std", m)],
        "content_type string, output_dir string")
    # JSON lines here (one object per line), so the JSON reader runs in line mode.
    out = rd.scan_responses(spark, manifest, part.schema, marked_columns=PART_COLS, json_multi_line=False)
    return out.select(*PART_COLS)


@query("scan_positions", V.with_ctes(V.POSITIONS_SQL) + " SELECT ticker, number_of_shares FROM positions")
def q_scan_positions(spark, d):
    path = shared_dir(spark, "positions")
    V.positions(spark, d).write.json(path)
    return rd.scan_positions(spark, path, multi_line=False)


@query("table_roundtrip", V.with_ctes(V.POSITIONS_SQL) + " SELECT ticker, number_of_shares FROM positions")
def q_table_roundtrip(spark, d):
    loc = shared_dir(spark, "tables")
    name = f"tickwise_positions_{uuid.uuid4().hex[:12]}"
    tb.declare_table(spark, name, rd.POSITIONS_SCHEMA_DOC, comment="Equity positions by ticker", location=loc)
    tb.overwrite_table(V.positions(spark, d), name)
    tb.overwrite_table(V.positions(spark, d), name)      # a second overwrite must not duplicate rows
    return spark.table(name).select("ticker", "number_of_shares")


@query("land_prices", V.with_ctes(V.PRICES_SQL) + """
SELECT TICKER, DATE, PX_LAST, PX_VOLUME, DL_REQUEST_ID FROM prices""")
def q_land_prices(spark, d):
    path = shared_dir(spark, "landing")
    px = V.prices(spark, d)
    tb.land(px, path)
    landed = spark.read.parquet(path)
    return landed.where(F.col("DL_REQUEST_ID") == V.HISTORY_LOAD[0]).select(
        "TICKER", "DATE", "PX_LAST", "PX_VOLUME", "DL_REQUEST_ID")


@query("scan_manifest", f"""
SELECT {_DAY_REQ_SQL} AS DL_REQUEST_ID, {_DAY_REQ_SQL} || '.' || CAST(event_id AS VARCHAR) || '.json' AS key,
  {_CT_SQL} AS content_type, split_part({_CT_SQL}, ';', 1) AS media_type,
  'MD5' AS digest_algorithm, md5(CAST(event_id AS VARCHAR)) AS digest
FROM events WHERE event_type = 'purchase'""")
def q_scan_manifest(spark, d):
    path = shared_dir(spark, "manifest")
    rows = _manifest_rows(spark, d).withColumn("_page", F.floor(F.col("pos.event_id") / 100))
    pages = rows.groupBy("_page").agg(F.collect_list(F.struct(
        F.col("key"), F.struct(F.col("DL_REQUEST_ID")).alias("metadata"),
        F.struct(F.col("digest").alias("Digest"), F.col("content_type").alias("Content-Type")).alias("headers")
    )).alias("contains"))
    pages.select("contains").write.json(path)
    m = rd.scan_manifest(spark, path, multi_line=False)
    return m.select("DL_REQUEST_ID", "key", "content_type", media_type("content_type").alias("media_type"),
                    digest_algorithm("digest").alias("digest_algorithm"), digest_value("digest").alias("digest"))


@query("scan_catalogs", """
SELECT CAST(s_suppkey AS VARCHAR) AS identifier,
  CASE WHEN s_acctbal < 0 THEN s_name || ' (restated)' ELSE s_name END AS description
FROM supplier""")
def q_scan_catalogs(spark, d):
    path = shared_dir(spark, "catalogs")
    s = V.read(spark, d, "supplier")
    items = (s.select("s_suppkey", F.lit(0).alias("_v"), F.col("s_name").alias("description"))
             .unionByName(s.where(F.col("s_acctbal") < 0).select(
                 "s_suppkey", F.lit(1).alias("_v"), F.concat(F.col("s_name"), F.lit(" (restated)")).alias("description"))))
    pages = (items.groupBy(F.floor(F.col("s_suppkey") / 50).alias("_page"))
             .agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "_v", "description"))).alias("_items"))
             .select(F.transform("_items", lambda x: F.struct(x["s_suppkey"].cast("string").alias("identifier"),
                                                              x["description"].alias("description"))).alias("contains")))
    pages.write.json(path)
    return rd.scan_catalogs(spark, path, multi_line=False)


@query("snapshot_versions", V.with_ctes(V.PART_SQL) + """
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, 2 AS version FROM part_new""")
def q_snapshot_versions(spark, d):
    root = shared_dir(spark, "snapshots")
    v1 = snap.snapshot(V.part_old(spark, d), root)
    v2 = snap.snapshot(V.part_new(spark, d), root)
    assert (v1, v2) == (1, 2)
    latest = snap.read_snapshot(spark, root)
    return latest.select(*PART_COLS, F.lit(v2).alias("version"))


HISTORY_RESPONSE_FIELDS = ["PX_LAST", "PX_VOLUME"]


@query("scan_conform_history", V.with_ctes(V.PRICES_SQL) + """
SELECT 'C' || substr(TICKER, 2, length(TICKER) - 4) || ' US Equity' AS _c0, CAST(0 AS INTEGER) AS _c1,
  CAST(2 AS INTEGER) AS _c2, CAST(DATE AS DATE) AS _c3, PX_LAST, PX_VOLUME, CAST(0 AS INTEGER) AS n_corrupt
FROM prices""")
def q_scan_conform_history(spark, d):
    """S8 history response: headerless CSV read positionally, then typed by ``history_request``."""
    from ..sources.schemas import conform, history_request, raw_schema
    path = shared_dir(spark, "history_csv")
    px = V.prices(spark, d)
    px.select(F.concat(F.lit("C"), F.expr("substr(TICKER, 2, length(TICKER) - 4)"), F.lit(" US Equity")),
              F.lit("0"), F.lit(str(len(HISTORY_RESPONSE_FIELDS))),
              F.date_format(F.to_date("DATE"), "dd/MM/yyyy"),
              F.col("PX_LAST").cast("string"), F.col("PX_VOLUME").cast("string")).write.csv(path)
    schema = history_request(HISTORY_RESPONSE_FIELDS)
    raw = spark.read.schema(raw_schema(schema)).csv(path)
    typed = conform(raw, schema)
    return typed.select("_c0", "_c1", "_c2", "_c3", F.col("PX_LAST").cast("double").alias("PX_LAST"),
                        F.col("PX_VOLUME").cast("bigint").alias("PX_VOLUME"),
                        F.size("_corrupt_fields").alias("n_corrupt"))


ENTITY_RESPONSE_FIELDS = ["LONG_COMP_NAME", "INDUSTRY_GROUP", "BS_SH_OUT"]


@query("scan_conform_entity", V.with_ctes(V.ENTITY_SQL) + """
SELECT DL_REQUEST_ID, DL_REQUEST_NAME, CAST(DL_SNAPSHOT_START_TIME AS TIMESTAMP) AS DL_SNAPSHOT_START_TIME,
  DL_SNAPSHOT_TZ, IDENTIFIER, CAST(RC AS INTEGER) AS RC, LONG_COMP_NAME, INDUSTRY_GROUP, BS_SH_OUT,
  CAST(0 AS INTEGER) AS n_corrupt
FROM entity_raw""")
def q_scan_conform_entity(spark, d):
    """S8 data response: JSON lines with every value as text, typed by ``data_request``."""
    from ..sources.schemas import conform, data_request, raw_schema
    path = shared_dir(spark, "entity_json")
    schema = data_request(ENTITY_RESPONSE_FIELDS)
    raw = V.entity_raw(spark, d)
    raw.select(*[F.col(f.name).cast("string").alias(f.name) for f in schema.fields]).write.json(path)
    typed = conform(spark.read.schema(raw_schema(schema)).json(path), schema)
    return typed.select(
        "DL_REQUEST_ID", "DL_REQUEST_NAME",
        F.col("DL_SNAPSHOT_START_TIME").cast("timestamp_ntz").alias("DL_SNAPSHOT_START_TIME"),
        "DL_SNAPSHOT_TZ", "IDENTIFIER", "RC", "LONG_COMP_NAME", "INDUSTRY_GROUP",
        F.col("BS_SH_OUT").cast("double").alias("BS_SH_OUT"), F.size("_corrupt_fields").alias("n_corrupt"))
