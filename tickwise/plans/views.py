"""Domain views over the generated tables, in Spark and as DuckDB SQL.

The generated tables are a TPC-H-like schema plus events, documents,
embeddings, pages and conversations. These views give them the shape of the
application's data: vendor entity and price tables, positions, a filings
corpus, a message log. Each Spark view has a SQL twin (a CTE) that the oracle
queries start from; the two must stay expression-for-expression equal.

All rules pick rows by data attributes (account balance, brand, type), never by
id arithmetic, and every view grows with its input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.portfolio import load_vendor_table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

# ---------------------------------------------------------------------------
# Fixed values of the views
# ---------------------------------------------------------------------------
ENTITY_LOAD_1 = ("r1", "2024-02-01T06:00:00")
ENTITY_LOAD_2 = ("r2", "2024-02-02T06:00:00")
HISTORY_LOAD = ("h1", "2024-02-01T07:00:00")
RESTATED_BALANCE_BELOW = 0.0      # companies with a negative balance are re-loaded (second load)
REPEATED_BALANCE_ABOVE = 9000.0   # companies above this balance appear twice in the first load
ASK_OVER_LAST, BID_OVER_LAST = 1.0005, 0.9995    # quotes around the close; a bar of one event has no bid


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------- entity
def _entity_load(base: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return base.select(
        (F.col("c_acctbal") * F.lit(1000.0)).alias("BS_SH_OUT"),
        F.concat(F.col("c_mktsegment"), F.lit(" company domiciled in "), F.col("n_name")).alias("CIE_DES"),
        F.col("n_name").alias("CNTRY_OF_DOMICILE"),
        F.col("_load.req").alias("DL_REQUEST_ID"),
        F.lit("EntityRequest").alias("DL_REQUEST_NAME"),
        F.col("_load.snap").alias("DL_SNAPSHOT_START_TIME"),
        F.lit("UTC").alias("DL_SNAPSHOT_TZ"),
        key.alias("ID_BB_COMPANY"),
        F.col("c_mktsegment").alias("INDUSTRY_GROUP"),
        F.col("r_name").alias("INDUSTRY_SUBGROUP"),
        F.concat(F.lit("LEI"), F.lpad(key.cast("string"), 10, "0")).alias("LEGAL_ENTITY_IDENTIFIER"),
        F.col("c_name").alias("LONG_COMP_NAME"),
        F.lit(0).cast("bigint").alias("RC"),
        F.concat(F.lit("C"), key.cast("string"), F.lit(" US Equity")).alias("IDENTIFIER"),
    )


def entity_raw(spark: SparkSession, d: str) -> DataFrame:
    """Vendor entity response as landed (with IDENTIFIER), two loads + one exact repeat."""
    c, n, r = read(spark, d, "customer"), read(spark, d, "nation"), read(spark, d, "region")
    base = (c.join(n, c["c_nationkey"] == n["n_nationkey"])
            .join(r, n["n_regionkey"] == r["r_regionkey"]))

    def load(req, when=None):
        s = F.struct(F.lit(req[0]).alias("req"), F.lit(req[1]).alias("snap"))
        return s if when is None else F.when(when, s)

    # One scan: each company row is expanded into the loads it appears in.
    loads = F.array(load(ENTITY_LOAD_1),
                    load(ENTITY_LOAD_1, F.col("c_acctbal") > REPEATED_BALANCE_ABOVE),
                    load(ENTITY_LOAD_2, F.col("c_acctbal") < RESTATED_BALANCE_BELOW))
    expanded = base.select("*", F.explode(F.filter(loads, lambda x: x.isNotNull())).alias("_load"))
    return _entity_load(expanded)


def entity(spark: SparkSession, d: str) -> DataFrame:
    """Entity table: TICKER derived from IDENTIFIER (which is dropped)."""
    return load_vendor_table(entity_raw(spark, d))


def _entity_load_sql(req: tuple[str, str]) -> str:
    return f"""SELECT c_acctbal * CAST(1000.0 AS DOUBLE) AS BS_SH_OUT,
      c_mktsegment || ' company domiciled in ' || n_name AS CIE_DES,
      n_name AS CNTRY_OF_DOMICILE, '{req[0]}' AS DL_REQUEST_ID, 'EntityRequest' AS DL_REQUEST_NAME,
      '{req[1]}' AS DL_SNAPSHOT_START_TIME, 'UTC' AS DL_SNAPSHOT_TZ, c_custkey AS ID_BB_COMPANY,
      c_mktsegment AS INDUSTRY_GROUP, r_name AS INDUSTRY_SUBGROUP,
      'LEI' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS LEGAL_ENTITY_IDENTIFIER,
      c_name AS LONG_COMP_NAME, CAST(0 AS BIGINT) AS RC,
      'C' || CAST(c_custkey AS VARCHAR) || ' US Equity' AS IDENTIFIER
    FROM entity_base"""


ENTITY_SQL = f"""
entity_base AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey),
entity_raw AS (
  {_entity_load_sql(ENTITY_LOAD_1)}
  UNION ALL {_entity_load_sql(ENTITY_LOAD_1)} WHERE c_acctbal > {REPEATED_BALANCE_ABOVE}
  UNION ALL {_entity_load_sql(ENTITY_LOAD_2)} WHERE c_acctbal < {RESTATED_BALANCE_BELOW}),
entity AS (SELECT * EXCLUDE (IDENTIFIER), split_part(IDENTIFIER, ' ', 1) || '-US' AS TICKER FROM entity_raw),
entity_latest AS (SELECT * FROM entity
  QUALIFY row_number() OVER (PARTITION BY TICKER ORDER BY DL_SNAPSHOT_START_TIME DESC, DL_REQUEST_ID DESC) = 1)"""


# --------------------------------------------------------------------------- positions
def positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions: one per ordering customer, shares from order totals."""
    o = read(spark, d, "orders")
    return (o.groupBy("o_custkey")
            .agg(F.sum(F.floor(F.col("o_totalprice") / 1000).cast("bigint")).alias("number_of_shares"))
            .select(F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(" US Equity")).alias("ticker"),
                    "number_of_shares"))


POSITIONS_SQL = """
positions AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) || ' US Equity' AS ticker,
  CAST(sum(CAST(floor(o_totalprice / 1000) AS BIGINT)) AS BIGINT) AS number_of_shares
  FROM orders GROUP BY o_custkey),
positions_n AS (SELECT split_part(ticker, ' ', 1) || '-US' AS TICKER, number_of_shares FROM positions)"""


# --------------------------------------------------------------------------- prices
def prices(spark: SparkSession, d: str, start=None, end=None) -> DataFrame:
    """Daily bars per user (= company) from events: open/high/low/last of value, volume = count.

    ``start`` / ``end`` (dates, inclusive) restrict the events before the bars
    are built; the range is on the raw timestamp, so it is pushed to the scan.
    """
    e = read(spark, d, "events")
    if start is not None:
        e = e.where(F.col("ts") >= F.lit(start.isoformat()).cast("timestamp_ntz"))
    if end is not None:
        e = e.where(F.col("ts") < F.date_add(F.lit(end.isoformat()).cast("date"), 1).cast("timestamp_ntz"))
    day = F.to_date("ts")
    bars = e.groupBy("user_id", day.alias("_day")).agg(
        F.max("value").alias("PX_HIGH"),
        F.max_by("value", "ts").alias("PX_LAST"),
        F.min("value").alias("PX_LOW"),
        F.min_by("value", "ts").alias("PX_OPEN"),
        F.count(F.lit(1)).alias("PX_VOLUME"))
    return bars.select(
        F.date_format("_day", "yyyy-MM-dd").alias("DATE"),
        F.lit(HISTORY_LOAD[0]).alias("DL_REQUEST_ID"),
        F.lit("HistoryRequest").alias("DL_REQUEST_NAME"),
        F.lit(HISTORY_LOAD[1]).alias("DL_SNAPSHOT_START_TIME"),
        F.lit("UTC").alias("DL_SNAPSHOT_TZ"),
        (F.col("PX_LAST") * F.lit(ASK_OVER_LAST)).alias("PX_ASK"),
        F.when(F.col("PX_VOLUME") > 1, F.col("PX_LAST") * F.lit(BID_OVER_LAST)).alias("PX_BID"),
        "PX_HIGH", "PX_LAST", "PX_LOW", "PX_OPEN", "PX_VOLUME",
        F.lit(0).cast("bigint").alias("RC"),
        F.concat(F.lit("C"), F.col("user_id").cast("string"), F.lit("-US")).alias("TICKER"))


PRICES_SQL = f"""
prices AS (SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS DATE, '{HISTORY_LOAD[0]}' AS DL_REQUEST_ID,
  'HistoryRequest' AS DL_REQUEST_NAME, '{HISTORY_LOAD[1]}' AS DL_SNAPSHOT_START_TIME, 'UTC' AS DL_SNAPSHOT_TZ,
  arg_max(value, ts) * CAST({ASK_OVER_LAST} AS DOUBLE) AS PX_ASK,
  CASE WHEN count(*) > 1 THEN arg_max(value, ts) * CAST({BID_OVER_LAST} AS DOUBLE) END AS PX_BID, max(value) AS PX_HIGH,
  arg_max(value, ts) AS PX_LAST, min(value) AS PX_LOW, arg_min(value, ts) AS PX_OPEN,
  count(*) AS PX_VOLUME, CAST(0 AS BIGINT) AS RC, 'C' || CAST(user_id AS VARCHAR) || '-US' AS TICKER
  FROM events GROUP BY user_id, CAST(ts AS DATE)),
px_latest AS (SELECT TICKER, max(DATE) AS price_date, arg_max(PX_LAST, DATE) AS PX_LAST FROM prices GROUP BY TICKER)"""


# --------------------------------------------------------------------------- corporate actions
SPLIT_VALUE_ABOVE, SPLIT_RATIO = 250.0, 2.0      # events of high value stand for splits of one share into two
MERGE_VALUE_BELOW, MERGE_RATIO = 0.5, 0.25       # events of low value for four shares merged into one


def action_response(spark: SparkSession, d: str) -> DataFrame:
    """Corporate actions as landed (text): every event is an action; splits carry their ratio."""
    ratio = (F.when(F.col("value") > SPLIT_VALUE_ABOVE, F.lit(str(SPLIT_RATIO)))
             .when(F.col("value") < MERGE_VALUE_BELOW, F.lit(str(MERGE_RATIO))))
    return read(spark, d, "events").select(
        F.concat(F.lit("C"), F.col("user_id").cast("string"), F.lit(" US Equity")).alias("IDENTIFIER"),
        F.col("event_id").cast("string").alias("ACTION_ID"),
        F.when(ratio.isNotNull(), F.lit("STOCK_SPLT")).otherwise(F.upper("event_type")).alias("CP_ACTION_MNEMONIC"),
        F.date_format("ts", "dd/MM/yyyy").alias("CP_EFFECTIVE_DATE"),
        F.to_json(F.struct(ratio.alias("CP_RATIO"))).alias("ACTION_FIELDS"))


SPLITS_SQL = f"""
splits AS (SELECT 'C' || CAST(user_id AS VARCHAR) || '-US' AS TICKER, CAST(ts AS DATE) AS effective,
  CASE WHEN value > {SPLIT_VALUE_ABOVE} THEN 1.0 / {SPLIT_RATIO} ELSE 1.0 / {MERGE_RATIO} END AS factor
  FROM events WHERE value > {SPLIT_VALUE_ABOVE} OR value < {MERGE_VALUE_BELOW}),
adjusted AS (SELECT p.*, PX_LAST * coalesce(f.adjustment, 1.0) AS ADJ_PX_LAST, coalesce(f.adjustment, 1.0) AS adjustment
  FROM prices p LEFT JOIN (
    SELECT b.TICKER, b.DATE, product(s.factor) AS adjustment
    FROM prices b JOIN splits s ON s.TICKER = b.TICKER AND s.effective > CAST(b.DATE AS DATE) GROUP BY b.TICKER, b.DATE) f
  ON f.TICKER = p.TICKER AND f.DATE = p.DATE)"""


# --------------------------------------------------------------------------- holdings
HOLDINGS_SQL = """
holdings AS (SELECT h.*, px.PX_LAST AS last_price, h.number_of_shares * px.PX_LAST AS market_value
  FROM (SELECT DISTINCT p.TICKER AS ticker, e.LONG_COMP_NAME AS company_name, e.INDUSTRY_GROUP AS industry,
          e.INDUSTRY_SUBGROUP AS sector, e.CNTRY_OF_DOMICILE AS country_of_domicile,
          e.CIE_DES AS company_description, p.number_of_shares
        FROM positions_n p JOIN entity_latest e ON p.TICKER = e.TICKER) h
  LEFT JOIN px_latest px ON h.ticker = px.TICKER)"""


# --------------------------------------------------------------------------- filings
def filings(spark: SparkSession, d: str) -> DataFrame:
    """Filing chunks from documents: company = source, ticker derived from the source number."""
    doc = read(spark, d, "documents")
    return doc.select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.concat(F.lit("filings/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"),
                 F.lit(".txt")).alias("document_name"),
        F.col("lang").alias("document_type"),
        F.col("source").alias("company_name"),
        F.floor(F.col("n_chars") / 1000).cast("string").alias("section_number"),
        F.concat(F.lit("C"), F.expr("substr(source, 4)"), F.lit("-US")).alias("symbol"),
        F.col("text").alias("content"))


FILINGS_SQL = """
filings AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id,
  'filings/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS document_name,
  lang AS document_type, source AS company_name,
  CAST(CAST(floor(n_chars / 1000) AS BIGINT) AS VARCHAR) AS section_number,
  'C' || substr(source, 4) || '-US' AS symbol, text AS content FROM documents)"""


# filings snapshots for the index sync: the old one lacks one language, the new one
# lacks one source and amends the text of another language
FILINGS_OLD_WITHOUT_LANG = "es"
FILINGS_NEW_WITHOUT_SOURCE = "src3"
FILINGS_AMENDED_LANG = "de"
AMENDMENT = " [amended]"


def filings_old(spark: SparkSession, d: str) -> DataFrame:
    return filings(spark, d).where(F.col("document_type") != FILINGS_OLD_WITHOUT_LANG)


def filings_new(spark: SparkSession, d: str) -> DataFrame:
    f = filings(spark, d).where(F.col("company_name") != FILINGS_NEW_WITHOUT_SOURCE)
    return f.withColumn("content", F.when(F.col("document_type") == FILINGS_AMENDED_LANG,
                                          F.concat(F.col("content"), F.lit(AMENDMENT))).otherwise(F.col("content")))


FILINGS_SNAPSHOTS_SQL = f"""
filings_new AS (SELECT * REPLACE (CASE WHEN document_type = '{FILINGS_AMENDED_LANG}'
                                       THEN content || '{AMENDMENT}' ELSE content END AS content)
                FROM filings WHERE company_name <> '{FILINGS_NEW_WITHOUT_SOURCE}')"""


# --------------------------------------------------------------------------- message log
def message_log(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", "role", F.col("text").alias("content"))


# --------------------------------------------------------------------------- part snapshots
OLD_MAX_SIZE = 45            # the old snapshot lacks parts above this size (→ inserts)
DELETED_BRAND = "Brand#7"    # the new snapshot lacks this brand (→ deletes)
REPRICED_TYPE = "SMALL"      # the new snapshot re-prices this type (→ updates)


def part_old(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").where(F.col("p_size") <= OLD_MAX_SIZE)


def part_new(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").where(F.col("p_brand") != DELETED_BRAND)
    return p.withColumn("p_retailprice", F.when(F.col("p_type") == REPRICED_TYPE, F.col("p_retailprice") + 1.0)
                        .otherwise(F.col("p_retailprice")))


PART_SQL = f"""
part_old AS (SELECT * FROM part WHERE p_size <= {OLD_MAX_SIZE}),
part_new AS (SELECT * REPLACE (CASE WHEN p_type = '{REPRICED_TYPE}' THEN p_retailprice + 1.0
                                    ELSE p_retailprice END AS p_retailprice)
             FROM part WHERE p_brand <> '{DELETED_BRAND}')"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes)
