"""Registered queries: each one a Spark job over the generated tables, plus its SQL oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``
(DuckDB SQL over the same tables). Output columns are aliased identically on
both sides; doubles are rounded on both sides (money to 2 places, ratios to 8).
"""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import PY_WHITESPACE_CLASS
from ..operators import conversation as conv
from ..operators import exposure as ex
from ..operators import filings as fl
from ..operators import ivf
from ..operators import market as mk
from ..operators import names as nm
from ..operators import portfolio as pf
from ..operators import profile as pr
from ..operators import requests as rq
from ..operators import risk as rk
from ..operators import vectors as vx
from ..session import shared_dir
from ..sinks import snapshots as snap
from ..sources import readers as rd
from ..sources import schemas as sch
from . import catalog as cat
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def r2(c):
    return F.round(c, 2)


def r8(c):
    return F.round(c, 8)


BASE = V.with_ctes(V.ENTITY_SQL, V.POSITIONS_SQL, V.PRICES_SQL, V.HOLDINGS_SQL)

# ---------------------------------------------------------------------------
# Fixed values of the query parameters
# ---------------------------------------------------------------------------
AS_OF = _dt.date(2024, 2, 15)             # history request date: January 2024 is the previous month
ENTITY_FIELDS = ["ID_BB_COMPANY", "LEGAL_ENTITY_IDENTIFIER", "LONG_COMP_NAME", "CIE_DES",
                 "CNTRY_OF_DOMICILE", "INDUSTRY_GROUP", "INDUSTRY_SUBGROUP", "BS_SH_OUT"]
HISTORY_FIELDS = ["PX_ASK", "PX_BID", "PX_VOLUME", "PX_OPEN", "PX_HIGH", "PX_LOW", "PX_LAST"]
TOP_K = 10
ROLLING_N = 5
RESPONSE_HOST = "https://api.example.com/eap"
CATALOG_ID = "10001"
INDUSTRY_PATTERN = "machinery"
COUNTRY_PATTERN = "nation_1"     # generated nation names are NATION_<n>
# Corpus words used as aliases / signal terms (the generated prose has no real company names).
ALIASES = {"estion": "C1-US", "oution": "C2-US", "inging": "C3-US",
           "enlich": "C4-US", "queque": "C5-US", "whtion": "C6-US",
           "Of-the": "C7-US", "de la": "C8-US"}
SIGNALS = {"estion": "downgrade", "oution": "downgrade", "inging": "litigation",
           "enlich": "litigation", "queque": "revenue_shock", "whtion": "revenue_shock"}
THEME_TERMS = ["queque", "estion-of the", "In-the"]
KNN_K = 5


def _in_list(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def _holdings(spark, d):
    return ex.holdings(V.positions(spark, d), V.entity(spark, d), V.prices(spark, d))


# =========================================================================== portfolio
@query("enrich_positions", BASE + """
SELECT s.TICKER AS ticker, s.LONG_COMP_NAME AS company_name, s.INDUSTRY_GROUP AS industry,
       s.INDUSTRY_SUBGROUP AS sector, s.CNTRY_OF_DOMICILE AS country_of_domicile,
       s.CIE_DES AS company_description, s.number_of_shares
FROM (SELECT DISTINCT * FROM positions_n p JOIN entity e USING (TICKER)) s""")
def q_enrich_positions(spark, d):
    return pf.enrich_positions(V.positions(spark, d), V.entity(spark, d))


@query("unmatched_positions", BASE + """
SELECT TICKER AS ticker, number_of_shares FROM positions_n
WHERE TICKER NOT IN (SELECT TICKER FROM prices)""")
def q_unmatched_positions(spark, d):
    return pf.unmatched_positions(V.positions(spark, d), V.prices(spark, d))


@query("portfolio_json", BASE + """
SELECT ticker, CAST(to_json(struct_pack(ticker := ticker, company_name := company_name, industry := industry,
                                   sector := sector, number_of_shares := number_of_shares)) AS VARCHAR) AS position_json
FROM holdings""")
def q_portfolio_json(spark, d):
    return pf.portfolio_json(_holdings(spark, d))


@query("match_ticker", BASE + """
SELECT DISTINCT regexp_extract(p.ticker, '^([^\\s\\-]+)', 1) AS ticker_root, p.ticker AS position_ticker,
       x.TICKER AS price_ticker
FROM positions p JOIN (SELECT DISTINCT TICKER FROM prices) x
  ON regexp_extract(p.ticker, '^([^\\s\\-]+)', 1) = regexp_extract(x.TICKER, '^([^\\s\\-]+)', 1)""")
def q_match_ticker(spark, d):
    pos = V.positions(spark, d).select(F.col("ticker").alias("position_ticker"))
    px = V.prices(spark, d).select(F.col("TICKER").alias("price_ticker")).distinct()
    return pf.match_ticker(pos, "position_ticker", px, "price_ticker").distinct()


@query("holdings_in", BASE + f"""
SELECT ticker, company_name, industry, sector, country_of_domicile, number_of_shares FROM holdings
WHERE contains(lower(industry), '{INDUSTRY_PATTERN}')""")
def q_holdings_in(spark, d):
    view = "tickwise_holdings"
    _holdings(spark, d).createOrReplaceTempView(view)
    pf.register_functions(spark, view)
    return spark.sql(f"SELECT * FROM holdings_in('{INDUSTRY_PATTERN}')")


@query("portfolio_function", BASE + """
SELECT ticker, CAST(to_json(struct_pack(ticker := ticker, company_name := company_name, industry := industry,
                                   sector := sector, number_of_shares := number_of_shares)) AS VARCHAR) AS position_json
FROM holdings""")
def q_portfolio_function(spark, d):
    view = "tickwise_holdings"
    _holdings(spark, d).createOrReplaceTempView(view)
    pf.register_functions(spark, view)
    return spark.sql("SELECT * FROM get_portfolio_data()")


# =========================================================================== requests
@query("data_request_entity", BASE + f"""
SELECT TICKER, {', '.join(ENTITY_FIELDS)} FROM entity
WHERE TICKER IN (SELECT TICKER FROM positions_n)""")
def q_data_request_entity(spark, d):
    universe = V.positions(spark, d).select(X.normalise_ticker("ticker").alias("TICKER"))
    return rq.data_request(V.entity(spark, d), universe, ENTITY_FIELDS)


_H_START, _H_END = rq.last_month_bounds(AS_OF)


@query("data_request_history", BASE + f"""
SELECT TICKER, DATE, {', '.join(HISTORY_FIELDS)} FROM prices
WHERE TICKER IN (SELECT TICKER FROM positions_n)
  AND CAST(DATE AS DATE) BETWEEN DATE '{_H_START}' AND DATE '{_H_END}'""")
def q_data_request_history(spark, d):
    universe = V.positions(spark, d).select(X.normalise_ticker("ticker").alias("TICKER"))
    # The bars are built only from events inside the range (pushed to the events scan).
    return rq.data_request(V.prices(spark, d, _H_START, _H_END), universe, HISTORY_FIELDS, date_col="DATE",
                           start=_H_START, end=_H_END)


def _order_requests(spark, d):
    o = V.read(spark, d, "orders")
    ident = X.request_id("o_orderdate", "o_orderkey")
    ident = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(ident, F.lit("x"))).otherwise(ident)
    rtype = (F.when(F.col("o_orderstatus") == "F", F.lit("HistoryRequest"))
             .when(F.col("o_orderstatus") == "O", F.lit("EntityRequest")))
    return o.select("o_orderkey", ident.alias("identifier"), rtype.alias("type"))


@query("request_validation", """
WITH r AS (SELECT o_orderkey,
  'r' || strftime(o_orderdate, '%Y%m%d%H%M%S') || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 6)
    || CASE WHEN o_orderpriority = '1-URGENT' THEN 'x' ELSE '' END AS identifier,
  CASE o_orderstatus WHEN 'F' THEN 'HistoryRequest' WHEN 'O' THEN 'EntityRequest' END AS type FROM orders)
SELECT o_orderkey, identifier, type,
  concat_ws('; ', CASE WHEN identifier IS NULL THEN 'Request identifier must be specified' END,
                  CASE WHEN type IS NULL THEN 'Request type not specified' END,
                  CASE WHEN length(identifier) > 21 THEN 'Identifier must be between 1 and 21 characters long' END)
    AS errors,
  (identifier IS NOT NULL AND type IS NOT NULL AND length(identifier) <= 21) AS is_valid
FROM r""")
def q_request_validation(spark, d):
    v = rq.validate_requests(_order_requests(spark, d))
    return v.select("o_orderkey", "identifier", "type", F.concat_ws("; ", "errors").alias("errors"), "is_valid")


def _day_request_id(ts, user):
    return X.request_id(F.date_trunc("day", F.col(ts)), user)


_DAY_REQ_SQL = ("'r' || strftime(date_trunc('day', ts), '%Y%m%d%H%M%S') || "
                "substr(sha256(CAST(user_id AS VARCHAR)), 1, 6)")
_CT_SQL = """CASE WHEN value < 50 THEN 'application/json; charset=utf-8' WHEN value < 100 THEN 'text/csv'
  WHEN value < 150 THEN 'text/vnd.blp.dl.std' ELSE 'application/x-tar' END"""


def _content_type(v):
    return (F.when(F.col(v) < 50, F.lit("application/json; charset=utf-8"))
            .when(F.col(v) < 100, F.lit("text/csv"))
            .when(F.col(v) < 150, F.lit("text/vnd.blp.dl.std"))
            .otherwise(F.lit("application/x-tar")))


def _manifest_rows(spark, d):
    e = V.read(spark, d, "events").where(F.col("event_type") == "purchase")
    rid = _day_request_id("ts", "user_id")
    return e.select(
        rid.alias("DL_REQUEST_ID"),
        F.concat(rid, F.lit("."), F.col("event_id").cast("string"), F.lit(".json")).alias("key"),
        F.concat(F.lit("md5="), F.md5(F.col("event_id").cast("string")), F.lit("==")).alias("digest"),
        _content_type("value").alias("content_type"),
        F.struct("ts", "event_id").alias("pos"))


@query("response_status", f"""
WITH req AS (SELECT DISTINCT {_DAY_REQ_SQL} AS identifier FROM events WHERE event_type = 'signup'),
man AS (SELECT {_DAY_REQ_SQL} AS DL_REQUEST_ID,
  {_DAY_REQ_SQL} || '.' || CAST(event_id AS VARCHAR) || '.json' AS key,
  'md5=' || md5(CAST(event_id AS VARCHAR)) || '==' AS digest, {_CT_SQL} AS content_type, ts, event_id
  FROM events WHERE event_type = 'purchase'),
first AS (SELECT * FROM man QUALIFY row_number() OVER (PARTITION BY DL_REQUEST_ID ORDER BY ts, event_id) = 1)
SELECT req.identifier, f.key, f.content_type, split_part(f.content_type, ';', 1) AS media_type,
  upper(split_part(f.digest, '=', 1)) AS digest_algorithm, split_part(f.digest, '=', 2) AS digest,
  CASE WHEN f.key IS NOT NULL THEN '{RESPONSE_HOST}/catalogs/{CATALOG_ID}/content/responses/' || f.key END
    AS download_url,
  f.key IS NOT NULL AS is_ready
FROM req LEFT JOIN first f ON req.identifier = f.DL_REQUEST_ID""")
def q_response_status(spark, d):
    e = V.read(spark, d, "events").where(F.col("event_type") == "signup")
    reqs = e.select(_day_request_id("ts", "user_id").alias("identifier"))
    return rq.response_status(reqs, _manifest_rows(spark, d), RESPONSE_HOST, CATALOG_ID)


def _signup_requests(spark, d):
    e = V.read(spark, d, "events").where(F.col("event_type") == "signup")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("identifier"),
                    F.col("ts").alias("submitted_at"), F.col("event_id").alias("request_event_id"))


def _purchase_notifications(spark, d):
    e = V.read(spark, d, "events").where(F.col("event_type") == "purchase")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".json")).alias("generated_identifier"),
                    F.col("ts").alias("received_at"), F.col("event_id").alias("notification_id"),
                    _content_type("value").alias("content_type"))


@query("match_notifications", f"""
WITH req AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS identifier, ts AS submitted_at, event_id AS request_event_id
             FROM events WHERE event_type = 'signup'),
n AS (SELECT split_part('u' || CAST(user_id AS VARCHAR) || '.json', '.', 1) AS base, ts AS received_at,
             event_id AS notification_id, {_CT_SQL} AS content_type FROM events WHERE event_type = 'purchase'),
m AS (SELECT req.*, n.notification_id, n.content_type, n.received_at FROM req LEFT JOIN n
        ON n.base = req.identifier AND n.received_at >= req.submitted_at
       AND n.received_at <= req.submitted_at + INTERVAL 45 MINUTE
      QUALIFY row_number() OVER (PARTITION BY req.request_event_id ORDER BY n.received_at, n.notification_id) = 1)
SELECT identifier, submitted_at, request_event_id, notification_id, content_type,
  round(date_diff('microsecond', submitted_at, received_at) / 60000000.0, 8) AS minutes_waited,
  notification_id IS NULL AS timed_out
FROM m""")
def q_match_notifications(spark, d):
    m = rq.match_notifications(_signup_requests(spark, d), _purchase_notifications(spark, d))
    return m.select("identifier", "submitted_at", "request_event_id",
                    F.col("match.notification_id").alias("notification_id"),
                    F.col("match.content_type").alias("content_type"),
                    r8(F.col("minutes_waited")).alias("minutes_waited"), "timed_out")


@query("request_calendar", """
SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS order_date,
  strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y-%m-%d') AS range_start,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS range_end,
  strftime(o_orderdate, '%Y%m%d%H%M%S') AS compact_ts
FROM orders""")
def q_request_calendar(spark, d):
    o = V.read(spark, d, "orders").select("o_orderdate").distinct()
    start, end = rq.last_month(F.col("o_orderdate"))
    return o.select(X.iso_date("o_orderdate").alias("order_date"), X.iso_date(start).alias("range_start"),
                    X.iso_date(end).alias("range_end"), X.compact_ts("o_orderdate").alias("compact_ts"))


# =========================================================================== market
@query("latest_price", BASE + """
SELECT TICKER, DATE, PX_LAST, PX_VOLUME FROM prices
QUALIFY row_number() OVER (PARTITION BY TICKER ORDER BY DATE DESC) = 1""")
def q_latest_price(spark, d):
    return mk.latest_price(V.prices(spark, d)).select("TICKER", "DATE", "PX_LAST", "PX_VOLUME")


_RET_SQL = """
rets AS (SELECT TICKER, DATE, PX_LAST,
  CASE WHEN lag(PX_LAST) OVER w IS NULL OR lag(PX_LAST) OVER w = 0 THEN NULL
       ELSE PX_LAST / lag(PX_LAST) OVER w - 1.0 END AS daily_return
  FROM prices WINDOW w AS (PARTITION BY TICKER ORDER BY DATE))"""


@query("daily_returns", BASE + "," + _RET_SQL + """
SELECT TICKER, DATE, PX_LAST, round(daily_return, 8) AS daily_return FROM rets""")
def q_daily_returns(spark, d):
    r = mk.daily_returns(V.prices(spark, d))
    return r.select("TICKER", "DATE", "PX_LAST", r8(F.col("daily_return")).alias("daily_return"))


@query("rolling_volatility", BASE + "," + _RET_SQL + f"""
SELECT TICKER, DATE, round(stddev_samp(daily_return) OVER (PARTITION BY TICKER ORDER BY DATE
  ROWS BETWEEN {ROLLING_N - 1} PRECEDING AND CURRENT ROW), 8) AS rolling_vol FROM rets""")
def q_rolling_volatility(spark, d):
    r = mk.rolling_volatility(mk.daily_returns(V.prices(spark, d)), ROLLING_N)
    return r.select("TICKER", "DATE", r8(F.col("rolling_vol")).alias("rolling_vol"))


@query("volatility", BASE + "," + _RET_SQL + """
SELECT TICKER, count(daily_return) AS n_returns, round(stddev_samp(daily_return), 8) AS volatility,
  round(stddev_samp(daily_return) * sqrt(252), 8) AS annualised_volatility
FROM rets GROUP BY TICKER""")
def q_volatility(spark, d):
    v = mk.volatility(mk.daily_returns(V.prices(spark, d)))
    return v.select("TICKER", "n_returns", r8(F.col("volatility")).alias("volatility"),
                    r8(F.col("annualised_volatility")).alias("annualised_volatility"))


def _log_returns(spark, d):
    return mk.daily_returns(V.prices(spark, d), log=True)


@query("ewma_volatility", BASE.replace("WITH", "WITH RECURSIVE", 1) + f""",
bars AS (SELECT TICKER, DATE, PX_LAST, lag(PX_LAST) OVER (PARTITION BY TICKER ORDER BY DATE) AS prev,
  row_number() OVER (PARTITION BY TICKER ORDER BY DATE) AS n FROM prices),
r AS (SELECT TICKER, DATE, n, CASE WHEN prev > 0 AND PX_LAST > 0 THEN ln(PX_LAST / prev) END AS r FROM bars),
v AS (SELECT TICKER, DATE, n, r * r AS v FROM r WHERE n = 1
  UNION ALL SELECT r.TICKER, r.DATE, r.n, CASE WHEN r.r IS NULL THEN v.v WHEN v.v IS NULL THEN r.r * r.r
    ELSE {mk.DECAY} * v.v + {1.0 - mk.DECAY} * r.r * r.r END FROM v JOIN r ON r.TICKER = v.TICKER AND r.n = v.n + 1)
SELECT TICKER, DATE, round(sqrt(v), 8) AS ewma_vol FROM v""")
def q_ewma_volatility(spark, d):
    e = mk.ewma_volatility(_log_returns(spark, d).select("TICKER", "DATE", "daily_return"))
    return e.select("TICKER", "DATE", r8(F.col("ewma_vol")).alias("ewma_vol"))


def _adjusted(spark, d):
    actions = sch.conform(V.action_response(spark, d), sch.action_request())
    return mk.adjusted_prices(V.prices(spark, d), mk.split_factors(actions))


@query("adjusted_prices", V.with_ctes(V.PRICES_SQL, V.SPLITS_SQL) + """
SELECT TICKER, DATE, PX_LAST, round(adjustment, 8) AS adjustment, round(ADJ_PX_LAST, 6) AS ADJ_PX_LAST FROM adjusted""")
def q_adjusted_prices(spark, d):
    a = _adjusted(spark, d)
    return a.select("TICKER", "DATE", "PX_LAST", r8(F.col("adjustment")).alias("adjustment"),
                    F.round("ADJ_PX_LAST", 6).alias("ADJ_PX_LAST"))


@query("adjusted_returns", V.with_ctes(V.PRICES_SQL, V.SPLITS_SQL) + """
SELECT TICKER, DATE, CASE WHEN prev > 0 AND ADJ_PX_LAST > 0 THEN round(ln(ADJ_PX_LAST / prev), 8) END AS daily_return
FROM (SELECT *, lag(ADJ_PX_LAST) OVER (PARTITION BY TICKER ORDER BY DATE) AS prev FROM adjusted)""")
def q_adjusted_returns(spark, d):
    r = mk.daily_returns(_adjusted(spark, d), log=True, px="ADJ_PX_LAST")
    return r.select("TICKER", "DATE", r8(F.col("daily_return")).alias("daily_return"))


@query("adjusted_performers", V.with_ctes(V.PRICES_SQL, V.SPLITS_SQL) + f"""
SELECT TICKER, round(period_return, 6) AS period_return FROM (
  SELECT TICKER, arg_max(ADJ_PX_LAST, DATE) / arg_min(ADJ_PX_LAST, DATE) - 1.0 AS period_return
  FROM adjusted WHERE ADJ_PX_LAST IS NOT NULL GROUP BY TICKER HAVING arg_min(ADJ_PX_LAST, DATE) <> 0)
ORDER BY period_return DESC, TICKER LIMIT {TOP_K}""")
def q_adjusted_performers(spark, d):
    bars = _adjusted(spark, d).withColumn("PX_LAST", F.col("ADJ_PX_LAST"))
    t = mk.top_performers(bars, TOP_K)
    return t.select("TICKER", F.round("period_return", 6).alias("period_return"))


@query("top_performers", BASE + f"""
SELECT TICKER, first_close, last_close, round(period_return, 8) AS period_return FROM (
  SELECT TICKER, arg_min(PX_LAST, DATE) AS first_close, arg_max(PX_LAST, DATE) AS last_close,
         arg_max(PX_LAST, DATE) / arg_min(PX_LAST, DATE) - 1.0 AS period_return
  FROM prices WHERE PX_LAST IS NOT NULL GROUP BY TICKER)
WHERE first_close <> 0
ORDER BY period_return DESC, TICKER LIMIT {TOP_K}""")
def q_top_performers(spark, d):
    t = mk.top_performers(V.prices(spark, d), TOP_K)
    return t.select("TICKER", "first_close", "last_close", r8(F.col("period_return")).alias("period_return"))


@query("most_traded", f"""
SELECT t.l_partkey, p.p_name, t.total_volume, t.n_trades FROM (
  SELECT l_partkey, sum(l_quantity) AS total_volume, count(*) AS n_trades FROM lineitem GROUP BY l_partkey
  ORDER BY total_volume DESC, l_partkey LIMIT {TOP_K}) t JOIN part p ON t.l_partkey = p.p_partkey""")
def q_most_traded(spark, d):
    top = mk.most_traded(V.read(spark, d, "lineitem"), "l_partkey", "l_quantity", TOP_K)
    part = V.read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return top.join(part, "l_partkey").select("l_partkey", "p_name", "total_volume", "n_trades")


@query("industry_stats", BASE + """
SELECT e.INDUSTRY_GROUP AS industry, count(*) AS n_bars, count(DISTINCT p.TICKER) AS n_tickers,
  CAST(sum(PX_VOLUME) AS BIGINT) AS total_volume, round(avg(PX_VOLUME), 8) AS avg_volume,
  min(PX_VOLUME) AS min_volume, max(PX_VOLUME) AS max_volume, round(avg(PX_ASK - PX_BID), 8) AS avg_spread
FROM prices p JOIN entity_latest e ON p.TICKER = e.TICKER GROUP BY e.INDUSTRY_GROUP""")
def q_industry_stats(spark, d):
    from ..operators.windows import latest_per_key
    ent = latest_per_key(V.entity(spark, d), "TICKER", ["DL_SNAPSHOT_START_TIME", "DL_REQUEST_ID"])
    s = mk.industry_stats(V.prices(spark, d), ent)
    return s.select("industry", "n_bars", "n_tickers", "total_volume", r8(F.col("avg_volume")).alias("avg_volume"),
                    "min_volume", "max_volume", r8(F.col("avg_spread")).alias("avg_spread"))


# =========================================================================== exposure
@query("value_holdings", BASE + """
SELECT p.TICKER AS ticker, p.number_of_shares, x.price_date, x.PX_LAST AS last_price,
  round(p.number_of_shares * x.PX_LAST, 2) AS market_value
FROM positions_n p LEFT JOIN px_latest x ON p.TICKER = x.TICKER""")
def q_value_holdings(spark, d):
    v = ex.value_holdings(V.positions(spark, d), V.prices(spark, d))
    return v.select("ticker", "number_of_shares", "price_date", "last_price",
                    r2(F.col("market_value")).alias("market_value"))


def _exposure_sql(dim: str) -> str:
    return BASE + f"""
SELECT {dim}, n_positions, shares, round(market_value, 2) AS market_value,
  round(market_value / (SELECT sum(market_value) FROM holdings), 8) AS weight
FROM (SELECT {dim}, count(*) AS n_positions, CAST(sum(number_of_shares) AS BIGINT) AS shares,
             sum(market_value) AS market_value FROM holdings GROUP BY {dim})"""


def _exposure(spark, d, dim):
    e = ex.exposure_by(_holdings(spark, d), dim)
    return e.select(dim, "n_positions", "shares", r2(F.col("market_value")).alias("market_value"),
                    r8(F.col("weight")).alias("weight"))


@query("exposure_by_industry", _exposure_sql("industry"))
def q_exposure_by_industry(spark, d):
    return _exposure(spark, d, "industry")


@query("exposure_by_country", _exposure_sql("country_of_domicile"))
def q_exposure_by_country(spark, d):
    return _exposure(spark, d, "country_of_domicile")


@query("exposure_by_sector", _exposure_sql("sector"))
def q_exposure_by_sector(spark, d):
    return _exposure(spark, d, "sector")


def _exposure_to_sql(dim, pattern):
    return BASE + f"""
SELECT ticker, {dim}, number_of_shares, round(market_value, 2) AS market_value,
  round(market_value / (SELECT sum(market_value) FROM holdings), 8) AS weight
FROM holdings WHERE contains(lower({dim}), '{pattern}')"""


def _exposure_to(spark, d, dim, pattern):
    e = ex.exposure_to(_holdings(spark, d), dim, pattern)
    return e.select("ticker", dim, "number_of_shares", r2(F.col("market_value")).alias("market_value"),
                    r8(F.col("weight")).alias("weight"))


@query("exposure_to_industry", _exposure_to_sql("industry", INDUSTRY_PATTERN))
def q_exposure_to_industry(spark, d):
    return _exposure_to(spark, d, "industry", INDUSTRY_PATTERN)


@query("exposure_to_country", _exposure_to_sql("country_of_domicile", COUNTRY_PATTERN))
def q_exposure_to_country(spark, d):
    return _exposure_to(spark, d, "country_of_domicile", COUNTRY_PATTERN)


@query("risk_rollup", BASE + """
SELECT industry, sector, ticker, CAST(grouping(industry, sector, ticker) AS BIGINT) AS grouping_level,
  count(*) AS n_positions, CAST(sum(number_of_shares) AS BIGINT) AS shares, round(sum(market_value), 2) AS market_value
FROM holdings GROUP BY ROLLUP (industry, sector, ticker)""")
def q_risk_rollup(spark, d):
    r = ex.risk_rollup(_holdings(spark, d))
    return r.select("industry", "sector", "ticker", F.col("grouping_level").cast("bigint").alias("grouping_level"),
                    "n_positions", "shares", r2(F.col("market_value")).alias("market_value"))


@query("exposure_cube", BASE + """
SELECT industry, country_of_domicile, CAST(grouping(industry, country_of_domicile) AS BIGINT) AS grouping_level,
  count(*) AS n_positions, round(sum(market_value), 2) AS market_value
FROM holdings GROUP BY CUBE (industry, country_of_domicile)""")
def q_exposure_cube(spark, d):
    c = ex.exposure_cube(_holdings(spark, d), ["industry", "country_of_domicile"])
    return c.select("industry", "country_of_domicile",
                    F.col("grouping_level").cast("bigint").alias("grouping_level"),
                    "n_positions", r2(F.col("market_value")).alias("market_value"))


@query("concentration", BASE + """,
w AS (SELECT industry, sum(market_value) / (SELECT sum(market_value) FROM holdings) AS weight
      FROM holdings GROUP BY industry),
wv AS (SELECT * FROM w WHERE weight IS NOT NULL)
SELECT count(*) AS n_groups, round(sum(weight * weight), 8) AS hhi, round(max(weight), 8) AS max_weight,
  round((SELECT sum(weight) FROM (SELECT weight FROM wv ORDER BY weight DESC, industry LIMIT 3)), 8) AS top3_share
FROM wv""")
def q_concentration(spark, d):
    c = ex.concentration(_holdings(spark, d), "industry", 3)
    return c.select("n_groups", r8(F.col("hhi")).alias("hhi"), r8(F.col("max_weight")).alias("max_weight"),
                    r8(F.col("top3_share")).alias("top3_share"))


@query("rank_drivers", BASE + """
SELECT ticker, round(market_value, 2) AS market_value,
  CASE WHEN market_value IS NULL THEN NULL ELSE
    dense_rank() OVER (PARTITION BY market_value IS NULL ORDER BY market_value DESC) END AS risk_rank
FROM (SELECT ticker, sum(market_value) AS market_value FROM holdings GROUP BY ticker)""")
def q_rank_drivers(spark, d):
    r = ex.rank_drivers(_holdings(spark, d))
    return r.select("ticker", r2(F.col("market_value")).alias("market_value"),
                    F.col("risk_rank").cast("bigint").alias("risk_rank"))


# Log returns: a bar at or after a price of zero has none.
_LOG_RET_SQL = """
log_rets AS (SELECT TICKER, DATE, CASE WHEN prev > 0 AND PX_LAST > 0 THEN ln(PX_LAST / prev) END AS r
  FROM (SELECT TICKER, DATE, PX_LAST, lag(PX_LAST) OVER (PARTITION BY TICKER ORDER BY DATE) AS prev FROM prices)),
weights AS (SELECT ticker, sum(market_value) / (SELECT sum(market_value) FROM holdings) AS weight
  FROM holdings GROUP BY ticker HAVING sum(market_value) IS NOT NULL),
held_rets AS (SELECT l.* FROM log_rets l JOIN weights w ON l.TICKER = w.ticker WHERE l.r IS NOT NULL),
cov AS (SELECT a.TICKER AS ta, b.TICKER AS tb, count(*) AS n_dates, covar_samp(a.r, b.r) AS covariance
  FROM held_rets a JOIN held_rets b ON a.DATE = b.DATE GROUP BY ALL HAVING count(*) >= 2),
marginal AS (SELECT ta AS ticker, sum(covariance * weight) AS marginal,
    max(CASE WHEN ta = tb THEN covariance END) AS variance
  FROM cov JOIN weights ON tb = weights.ticker GROUP BY ta)"""


@query("return_covariances", BASE + "," + _LOG_RET_SQL + """
SELECT ta AS ticker_a, tb AS ticker_b, n_dates, round(covariance, 8) AS covariance FROM cov WHERE ta <= tb""")
def q_return_covariances(spark, d):
    held = _holdings(spark, d).where(F.col("market_value").isNotNull()).select(F.col("ticker").alias("TICKER"))
    c = rk.covariances(_log_returns(spark, d), held)
    return c.select("ticker_a", "ticker_b", "n_dates", r8(F.col("covariance")).alias("covariance"))


@query("risk_contributions", BASE + "," + _LOG_RET_SQL + """,
c AS (SELECT h.ticker, w.weight, sqrt(m.variance) AS volatility, m.marginal, w.weight * m.marginal AS contribution
  FROM (SELECT DISTINCT ticker FROM holdings) h LEFT JOIN weights w ON h.ticker = w.ticker
  LEFT JOIN marginal m ON h.ticker = m.ticker)
SELECT ticker, round(weight, 8) AS weight, round(volatility, 8) AS volatility, round(marginal, 8) AS marginal,
  round(contribution, 10) AS contribution, round(contribution / (SELECT sum(contribution) FROM c), 8) AS share,
  CASE WHEN contribution IS NOT NULL THEN dense_rank() OVER (
    PARTITION BY contribution IS NULL ORDER BY round(contribution, 12) DESC) END AS risk_rank
FROM c""")
def q_risk_contributions(spark, d):
    c = rk.risk_contributions(_holdings(spark, d), _log_returns(spark, d))
    return c.select("ticker", r8(F.col("weight")).alias("weight"), r8(F.col("volatility")).alias("volatility"),
                    r8(F.col("marginal")).alias("marginal"), F.round("contribution", 10).alias("contribution"),
                    r8(F.col("share")).alias("share"), F.col("risk_rank").cast("bigint").alias("risk_rank"))


@query("risk_contribution_rollup", BASE + "," + _LOG_RET_SQL + """
SELECT sector, company_name, ticker, CAST(grouping(sector, company_name, ticker) AS BIGINT) AS grouping_level,
  count(*) AS n_positions, round(sum(w), 8) AS weight, round(sum(w * marginal), 10) AS contribution
FROM (SELECT h.*, h.market_value / (SELECT sum(market_value) FROM holdings) AS w, m.marginal
      FROM holdings h LEFT JOIN marginal m ON h.ticker = m.ticker)
GROUP BY ROLLUP (sector, company_name, ticker)""")
def q_risk_contribution_rollup(spark, d):
    r = rk.risk_contribution_rollup(_holdings(spark, d), _log_returns(spark, d))
    return r.select("sector", "company_name", "ticker", F.col("grouping_level").cast("bigint").alias("grouping_level"),
                    "n_positions", r8(F.col("weight")).alias("weight"), F.round("contribution", 10).alias("contribution"))


@query("null_profile", BASE + """,
v AS (SELECT p.TICKER AS ticker, p.number_of_shares, x.price_date, x.PX_LAST AS last_price,
        p.number_of_shares * x.PX_LAST AS market_value
      FROM positions_n p LEFT JOIN px_latest x ON p.TICKER = x.TICKER)
SELECT column_name, CAST(null_count AS BIGINT) AS null_count, row_count,
  round(null_count / row_count, 8) AS null_rate FROM (
  SELECT 'ticker' AS column_name, count_if(ticker IS NULL) AS null_count, count(*) AS row_count FROM v
  UNION ALL SELECT 'number_of_shares', count_if(number_of_shares IS NULL), count(*) FROM v
  UNION ALL SELECT 'price_date', count_if(price_date IS NULL), count(*) FROM v
  UNION ALL SELECT 'last_price', count_if(last_price IS NULL), count(*) FROM v
  UNION ALL SELECT 'market_value', count_if(market_value IS NULL), count(*) FROM v)""")
def q_null_profile(spark, d):
    n = ex.null_profile(ex.value_holdings(V.positions(spark, d), V.prices(spark, d)))
    return n.select("column_name", "null_count", "row_count", r8(F.col("null_rate")).alias("null_rate"))


@query("load_profile", V.with_ctes(V.PRICES_SQL) + """,
long AS (
  SELECT 'TICKER' AS column_name, CAST(TICKER AS VARCHAR) AS v FROM prices
  UNION ALL SELECT 'PX_BID', CAST(PX_BID AS VARCHAR) FROM prices
  UNION ALL SELECT 'PX_LAST', CAST(PX_LAST AS VARCHAR) FROM prices
  UNION ALL SELECT 'PX_VOLUME', CAST(PX_VOLUME AS VARCHAR) FROM prices)
SELECT column_name, count(*) AS row_count, CAST(count_if(v IS NULL) AS BIGINT) AS null_count,
  round(count_if(v IS NULL) / count(*), 8) AS null_rate, true AS distinct_within, true AS median_within
FROM long GROUP BY column_name""")
def q_load_profile(spark, d):
    """Every day of bars is a load, profiled on its own and merged from the stored sketches. The distinct values and
    the median are held against one pass over all bars, within the sketches' errors."""
    columns = ["TICKER", "PX_BID", "PX_LAST", "PX_VOLUME"]
    bars = V.prices(spark, d).select("DATE", *columns)
    path = shared_dir(spark, "load_profile")
    pr.profile_loads(bars, "DATE", path, columns)
    merged = pr.merged_profile(spark, path)
    medians = {r["column_name"]: r["quantiles"][len(pr.QUANTILES) // 2] for r in merged.where("quantiles IS NOT NULL").collect()}
    true = bars.agg(*[F.count_distinct(c).alias(f"d_{c}") for c in columns],
                    *[F.avg((F.col(c) < v).cast("double")).alias(f"lo_{c}") for c, v in medians.items()],
                    *[F.avg((F.col(c) <= v).cast("double")).alias(f"hi_{c}") for c, v in medians.items()]).first()
    facts = spark.createDataFrame([(c, true[f"d_{c}"], c not in medians or (true[f"lo_{c}"] <= 0.52 and true[f"hi_{c}"] >= 0.48))
                                   for c in columns], "column_name string, d long, median_within boolean")
    return merged.join(facts, "column_name").select(
        "column_name", "row_count", "null_count", r8(F.col("null_rate")).alias("null_rate"),
        (F.abs(F.col("n_distinct") - F.col("d")) <= F.lit(0.05) * F.col("d")).alias("distinct_within"), "median_within")


# =========================================================================== names
NAME_SIMILARITY = 0.4


@query("similar_names", f"""
WITH t AS (SELECT DISTINCT trim(regexp_replace(lower(regexp_extract(html, '<title>(.*?)</title>', 1)), '\\s+', ' ', 'g')) AS folded,
             regexp_extract(html, '<title>(.*?)</title>', 1) AS name FROM pages),
g AS (SELECT name, list_sort(list_distinct(list_transform(range(1, length(folded) + 1), lambda i: substr(' ' || folded || ' ', i, 3)))) AS s
      FROM t WHERE length(folded) > 0),
reps AS (SELECT min(name) AS name, s FROM g GROUP BY s),
p AS (SELECT a.name AS name_a, b.name AS name_b, len(list_intersect(a.s, b.s)) AS shared, len(a.s) AS na, len(b.s) AS nb
      FROM reps a JOIN reps b ON a.name < b.name)
SELECT name_a, name_b, round(shared / (na + nb - shared), 8) AS similarity FROM p
WHERE shared / (na + nb - shared) >= {NAME_SIMILARITY} - 1e-9""")
def q_similar_names(spark, d):
    """Titles of pages as names; pairs that differ in spelling."""
    titles = V.read(spark, d, "pages").select(F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("name"))
    return nm.similar_names(titles, "name", NAME_SIMILARITY).withColumn("similarity", r8(F.col("similarity")))


# =========================================================================== filings
_TOKENS_SQL = "list_filter(regexp_split_to_array(lower(content), '[^\\p{L}]+'), lambda t: length(t) > 0)"


def _grams_sql(n: int) -> str:
    """Words and phrases of up to ``n`` words of a filing (column ``w`` holds its words)."""
    parts = ["w"] + [f"list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i+{k - 1}], ' '))"
                     for k in range(2, n + 1)]
    return f"list_concat({', '.join(parts)})" if n > 1 else "w"


def _phrase(term: str) -> str:
    return " ".join(term.lower().replace("-", " ").split())


@query("link_mentions", V.with_ctes(V.FILINGS_SQL) + f""",
a(alias, ticker) AS (VALUES {', '.join(f"('{_phrase(k)}', '{v}')" for k, v in sorted(ALIASES.items()))}),
words AS (SELECT chunk_id, {_TOKENS_SQL} AS w FROM filings),
t AS (SELECT chunk_id, unnest({_grams_sql(2)}) AS alias FROM words)
SELECT chunk_id, ticker, count(*) AS n_mentions FROM t JOIN a USING (alias) GROUP BY chunk_id, ticker""")
def q_link_mentions(spark, d):
    return fl.link_mentions(V.filings(spark, d), ALIASES)


@query("risk_signals", V.with_ctes(V.FILINGS_SQL) + f""",
s(term, signal) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in sorted(SIGNALS.items()))}),
t AS (SELECT symbol, unnest(list_filter({_TOKENS_SQL}, lambda x: x IN ({_in_list(SIGNALS)})) ) AS term FROM filings)
SELECT symbol, signal, count(*) AS n_hits FROM t JOIN s USING (term) GROUP BY symbol, signal""")
def q_risk_signals(spark, d):
    return fl.risk_signals(V.filings(spark, d), SIGNALS)


@query("theme_exposure", V.with_ctes(V.ENTITY_SQL, V.POSITIONS_SQL, V.PRICES_SQL, V.HOLDINGS_SQL,
                                      V.FILINGS_SQL) + f"""
SELECT ticker, company_name, industry, number_of_shares FROM holdings
WHERE ticker IN (SELECT symbol FROM (SELECT symbol, {_TOKENS_SQL} AS w FROM filings)
                 WHERE len(list_filter({_grams_sql(3)}, lambda x: x IN ({_in_list(map(_phrase, THEME_TERMS))}))) > 0)""")
def q_theme_exposure(spark, d):
    t = fl.theme_exposure(_holdings(spark, d), V.filings(spark, d), THEME_TERMS)
    return t.select("ticker", "company_name", "industry", "number_of_shares")


@query("embed_filings")
def q_embed_filings(spark, d):
    from pyspark.ml.functions import vector_to_array
    e = fl.embed(V.filings(spark, d).select("chunk_id", "content"), num_features=1 << 12)
    arr = vector_to_array("embedding")
    return e.select("chunk_id", F.size(F.filter(arr, lambda x: x != 0)).alias("n_terms"),
                    F.round(F.sqrt(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


# =========================================================================== vectors
_CENTROIDS_SQL = """
ex AS (SELECT label, i, CAST(embedding[i] AS DOUBLE) AS x
       FROM embeddings, range(1, len(embedding) + 1) AS r(i)),
cen AS (SELECT label, list(m ORDER BY i) AS qv FROM (SELECT label, i, avg(x) AS m FROM ex GROUP BY label, i)
        GROUP BY label)"""


@query("similarity_search", "WITH " + _CENTROIDS_SQL.strip() + f""",
s AS (SELECT cen.label AS query_id, e.vec_id,
        list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), cen.qv) AS score
      FROM embeddings e, cen)
SELECT query_id, vec_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
FROM s QUALIFY rank <= {KNN_K}""")
def q_similarity_search(spark, d):
    emb = V.read(spark, d, "embeddings")
    queries = vx.centroids(emb, "label", "embedding")
    s = vx.similarity_search(emb, queries, KNN_K, "vec_id", "embedding", "label", "embedding")
    return s.select(F.col("query_id").cast("int").alias("query_id"), "vec_id", F.round("score", 6).alias("score"),
                    F.col("rank").cast("bigint").alias("rank"))


@query("similarity_search_lsh")
def q_similarity_search_lsh(spark, d):
    emb = V.read(spark, d, "embeddings")
    queries = vx.centroids(emb, "label", "embedding")
    s = vx.similarity_search_lsh(emb, queries, KNN_K, "vec_id", "embedding", "label", "embedding")
    return s.select(F.col("query_id").cast("int").alias("query_id"), "vec_id", F.round("score", 6).alias("score"),
                    "rank")


# What an approximate search must keep: of the exact answers at least this share, and exact scores for what it returns.
MIN_RECALL = 0.9


@query("similarity_search_ivf", f"""
SELECT count(*) AS n_queries, CAST(count(*) * {KNN_K} AS BIGINT) AS n_found, true AS recall_reached, true AS scores_exact
FROM (SELECT DISTINCT label FROM embeddings)""")
def q_similarity_search_ivf(spark, d):
    """Inverted file against the exact search: the rows found, whether the recall is reached, and whether the
    rows found by both have the exact score."""
    emb = V.read(spark, d, "embeddings")
    queries = vx.centroids(emb, "label", "embedding")
    index = ivf.build(emb, "vec_id", "embedding", shared_dir(spark, "ivf"))
    near = ivf.search(emb, index, queries, KNN_K, "embedding", "label", "embedding")
    exact = (vx.similarity_search(emb, queries, KNN_K, "vec_id", "embedding", "label", "embedding")
             .select("query_id", "vec_id", F.col("score").alias("exact")))
    return near.join(exact, ["query_id", "vec_id"], "full").agg(
        F.count_distinct("query_id").alias("n_queries"), F.count("score").alias("n_found"),
        (F.count_if(F.col("score").isNotNull() & F.col("exact").isNotNull())
         >= F.lit(MIN_RECALL) * F.count("exact")).alias("recall_reached"),
        F.bool_and(F.coalesce(F.abs(F.col("score") - F.col("exact")) < 1e-9, F.lit(True))).alias("scores_exact"))


# =========================================================================== snapshots
_CHANGES_SQL = V.with_ctes(V.PART_SQL) + """,
ch AS (SELECT coalesce(n.p_partkey, o.p_partkey) AS p_partkey,
  CASE WHEN o.p_partkey IS NULL THEN 'insert' WHEN n.p_partkey IS NULL THEN 'delete'
       WHEN NOT (o.p_name IS NOT DISTINCT FROM n.p_name AND o.p_brand IS NOT DISTINCT FROM n.p_brand
                 AND o.p_type IS NOT DISTINCT FROM n.p_type AND o.p_size IS NOT DISTINCT FROM n.p_size
                 AND o.p_retailprice IS NOT DISTINCT FROM n.p_retailprice) THEN 'update_postimage' END
    AS _change_type,
  CASE WHEN n.p_partkey IS NULL THEN o.p_name ELSE n.p_name END AS p_name,
  CASE WHEN n.p_partkey IS NULL THEN o.p_retailprice ELSE n.p_retailprice END AS p_retailprice
  FROM part_old o FULL OUTER JOIN part_new n ON o.p_partkey = n.p_partkey)"""


@query("changes_between", _CHANGES_SQL + """
SELECT p_partkey, _change_type, p_name, p_retailprice FROM ch WHERE _change_type IS NOT NULL""")
def q_changes_between(spark, d):
    c = snap.changes_between(V.part_old(spark, d), V.part_new(spark, d), "p_partkey")
    return c.select("p_partkey", "_change_type", "p_name", "p_retailprice")


@query("upsert", V.with_ctes(V.PART_SQL) + """
SELECT * FROM part_new""")
def q_upsert(spark, d):
    old, new = V.part_old(spark, d), V.part_new(spark, d)
    return snap.apply_changes(old, snap.changes_between(old, new, "p_partkey"), "p_partkey")


# =========================================================================== conversation log
@query("classify_message", f"""
SELECT conv_id, turn, role,
  CASE WHEN role = 'user' THEN 'user'
       WHEN role = 'assistant' AND length(regexp_replace(replace(coalesce(text, ''), '$', '\\$'),
            '^{PY_WHITESPACE_CLASS}+|{PY_WHITESPACE_CLASS}+$', '', 'g')) > 0 THEN 'answer'
       WHEN role = 'assistant' THEN 'empty'
       WHEN role = 'tool' THEN 'tool_result' ELSE 'other' END AS message_class
FROM conversations""")
def q_classify_message(spark, d):
    return conv.classify_message(V.message_log(spark, d)).select("conv_id", "turn", "role", "message_class")


@query("classify_tool_calls", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user'
  WHEN role = 'assistant' AND contains(text, chr(10)) THEN 'tool_call'
  WHEN role = 'assistant' AND length(trim(text)) > 0 THEN 'answer' WHEN role = 'assistant' THEN 'empty'
  WHEN role = 'tool' THEN 'tool_result' ELSE 'other' END AS message_class
FROM conversations""")
def q_classify_tool_calls(spark, d):
    """P14 with calls in the log: an assistant message of several lines asks for a tool by its first line."""
    first = F.substring_index("content", "\n", 1)
    log = V.message_log(spark, d).withColumn("tool_calls", F.when(
        F.contains("content", F.lit("\n")), F.array(F.struct(first.alias("function_name")))))
    return conv.classify_message(log).select("conv_id", "turn", "message_class")


# Tool results from documents: short ones are plain text, the others lists of a heading and the document itself;
# documents of one language come without a chunk id.
PLAIN_RESULT_BELOW, WITHOUT_CHUNK_LANG = 200, "es"


@query("retrieved_documents", f"""
SELECT doc_id AS message_id, CAST(1 AS INTEGER) AS doc_pos, CAST(doc_id AS VARCHAR) AS chunk_id, source AS document_name,
  CAST(length(text) AS BIGINT) AS content_chars
FROM documents WHERE n_chars >= {PLAIN_RESULT_BELOW} AND lang <> '{WITHOUT_CHUNK_LANG}'""")
def q_retrieved_documents(spark, d):
    doc = V.read(spark, d, "documents")
    name = F.struct(F.lit("document_name").alias("k"), F.col("source").alias("v"))
    chunk = F.struct(F.lit("chunk_id").alias("k"), F.col("doc_id").cast("string").alias("v"))
    metadata = F.map_from_entries(F.when(F.col("lang") != WITHOUT_CHUNK_LANG, F.array(name, chunk)).otherwise(F.array(name)))
    listed = F.to_json(F.array(
        F.struct(F.col("source").alias("page_content"), F.map_from_entries(F.array(name)).alias("metadata")),
        F.struct(F.col("text").alias("page_content"), metadata.alias("metadata"))))
    messages = doc.select(F.col("doc_id").alias("message_id"),
                          F.when(F.col("n_chars") < PLAIN_RESULT_BELOW, F.col("text")).otherwise(listed).alias("content"))
    r = conv.retrieved_documents(messages)
    return r.select("message_id", "doc_pos", "chunk_id", X.lookup("doc.metadata", "document_name").alias("document_name"),
                    F.length("doc.page_content").cast("bigint").alias("content_chars"))


_SEG_SQL = """
seg AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS question_no FROM conversations)"""


@query("segment_questions", "WITH " + _SEG_SQL.strip() + """
SELECT conv_id, turn, role, CAST(question_no AS BIGINT) AS question_no FROM seg""")
def q_segment_questions(spark, d):
    return conv.segment_questions(V.message_log(spark, d)).select("conv_id", "turn", "role", "question_no")


_CLEAN_SQL = (f"regexp_replace(replace(text, '$', '\\$'), '^{PY_WHITESPACE_CLASS}+|{PY_WHITESPACE_CLASS}+$', "
              f"'', 'g')")


@query("final_answers", "WITH " + _SEG_SQL.strip() + f"""
SELECT conv_id, CAST(question_no AS BIGINT) AS question_no, arg_max({_CLEAN_SQL}, turn) AS answer,
  max(turn) AS answer_turn, count(*) AS n_answers
FROM seg WHERE role = 'assistant' AND length({_CLEAN_SQL}) > 0 AND question_no > 0
GROUP BY conv_id, question_no""")
def q_final_answers(spark, d):
    return conv.final_answers(V.message_log(spark, d)).select("conv_id", "question_no", "answer", "answer_turn",
                                                             "n_answers")


@query("conversation_context", """
SELECT conv_id, turn, context_messages, context_chars FROM (
  SELECT conv_id, turn, role,
    CAST(coalesce(sum(CASE WHEN role IN ('user', 'assistant') THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT)
      AS context_messages,
    CAST(coalesce(sum(CASE WHEN role IN ('user', 'assistant') THEN coalesce(length(text), 0) ELSE 0 END) OVER w, 0)
      AS BIGINT) AS context_chars
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE role = 'user'""")
def q_conversation_context(spark, d):
    return conv.conversation_context(V.message_log(spark, d))


# Tool calls from events: each event names a tool function; its provider comes
# from the tool catalog, and is carried forward per user session.
def _tool_calls(spark, d):
    e = V.read(spark, d, "events")
    return e.select("event_id", "user_id", "ts", cat.function_name_of(F.col("event_type")).alias("function_name"))


def _attributed(spark, d):
    return conv.provider_of_calls(_tool_calls(spark, d), cat.tool_catalog(spark))


_CALLS_SQL = f"""
calls AS (SELECT event_id, user_id, ts, {cat.FUNCTION_NAME_SQL} AS function_name FROM events),
tools(fn, provider, provider_pos) AS (VALUES {cat.CATALOG_VALUES_SQL}),
firsts AS (SELECT fn, arg_min(provider, provider_pos) AS provider FROM tools GROUP BY fn),
attributed AS (SELECT c.*, upper(substr(f.provider, 1, 1)) || lower(substr(f.provider, 2)) AS provider
  FROM calls c LEFT JOIN firsts f ON split_part(c.function_name, '__', -1) = f.fn)"""


@query("attribute_provider", "WITH " + _CALLS_SQL.strip() + """
SELECT event_id, function_name, provider FROM attributed""")
def q_attribute_provider(spark, d):
    return _attributed(spark, d).select("event_id", "function_name", "provider")


@query("carry_provider", "WITH " + _CALLS_SQL.strip() + """
SELECT event_id, user_id, provider,
  last_value(provider IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_provider
FROM attributed""")
def q_carry_provider(spark, d):
    a = _attributed(spark, d)
    c = conv.carry_provider(a, "user_id", ["ts", "event_id"], "provider", F.to_date("ts"))
    return c.select("event_id", "user_id", "provider", "current_provider")


@query("active_tools", "WITH " + _CALLS_SQL.strip() + f""",
cat AS (SELECT * FROM (VALUES {cat.CATALOG_FULL_VALUES_SQL}) AS t(tool_id, provider, tool_type, tool_enabled, fn)),
used AS (SELECT DISTINCT split_part(function_name, '__', -1) AS fn FROM calls)
SELECT tool_id, provider, tool_type FROM cat WHERE tool_enabled AND fn IN (SELECT fn FROM used)""")
def q_active_tools(spark, d):
    tools = cat.tool_catalog(spark)
    used = (_tool_calls(spark, d).select(X.last_part("function_name", "__").alias("_fn")).distinct())
    selection = (tools.select("tool_id", X.last_part("tool_coordinates", ".").alias("_fn"))
                 .join(used.withColumn("selected", F.lit(True)), "_fn", "left")
                 .select("tool_id", F.coalesce(F.col("selected"), F.lit(False)).alias("selected")))
    return conv.active_tools(tools, selection).select("tool_id", "provider", "tool_type")


@query("scan_tool_catalog", "WITH " + _CALLS_SQL.strip() + f""",
cat AS (SELECT * FROM (VALUES {cat.CATALOG_FULL_VALUES_SQL}) AS t(tool_id, provider, tool_type, tool_enabled, fn)),
used AS (SELECT split_part(function_name, '__', -1) AS fn, count(*) AS n FROM calls GROUP BY 1)
SELECT tool_id, provider, tool_type, tool_enabled, CAST(coalesce(n, 0) AS BIGINT) AS n_calls FROM cat LEFT JOIN used USING (fn)""")
def q_scan_tool_catalog(spark, d):
    """The catalog read from its file, with the calls of each tool."""
    path = shared_dir(spark, "tool_catalog")
    spark.createDataFrame([(json.dumps(cat.TOOL_CATALOG),)], "value string").coalesce(1).write.text(path)
    tools = rd.scan_tool_catalog(spark, path).withColumn("_fn", X.last_part("tool_coordinates", "."))
    calls = (_tool_calls(spark, d).groupBy(X.last_part("function_name", "__").alias("_fn"))
             .agg(F.count(F.lit(1)).alias("_n")))
    return tools.join(calls, "_fn", "left").select("tool_id", "provider", "tool_type", "tool_enabled",
                                                   F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_calls"))


@query("tool_summary", "WITH " + _CALLS_SQL.strip() + f""",
cat AS (SELECT * FROM (VALUES {cat.CATALOG_FULL_VALUES_SQL}) AS t(tool_id, provider, tool_type, tool_enabled, fn)),
used AS (SELECT split_part(function_name, '__', -1) AS fn, count(*) AS n FROM calls GROUP BY 1)
SELECT tool_type, count(*) AS n_tools, string_agg(tool_id, ',' ORDER BY tool_id) AS tool_ids,
  CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_calls
FROM cat LEFT JOIN used USING (fn) GROUP BY tool_type""")
def q_tool_summary(spark, d):
    tools = cat.tool_catalog(spark)
    calls = (_tool_calls(spark, d).groupBy(X.last_part("function_name", "__").alias("_fn"))
             .agg(F.count(F.lit(1)).alias("_n")))
    t = tools.withColumn("_fn", X.last_part("tool_coordinates", ".")).join(calls, "_fn", "left")
    s = conv.tool_summary(t)
    n = t.groupBy("tool_type").agg(F.sum(F.coalesce(F.col("_n"), F.lit(0))).cast("bigint").alias("n_calls"))
    return s.join(n, "tool_type")


@query("supporting_documents", """
SELECT user_id, json_extract_string(props, '$.k') AS chunk_id, count(*) AS n_references,
  arg_max(event_type, ts) AS provider, min(ts) AS first_seen,
  CAST(count(*) AS VARCHAR) || ' reference(s)' AS reference_label
FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
GROUP BY user_id, json_extract_string(props, '$.k')""")
def q_supporting_documents(spark, d):
    e = V.read(spark, d, "events")
    r = (e.select("user_id", F.get_json_object("props", "$.k").alias("chunk_id"), F.col("ts").alias("seq"),
                  F.col("event_type").alias("provider"))
         .where(F.col("chunk_id").isNotNull()))
    s = conv.supporting_documents(r, ["user_id"], "chunk_id", "seq", "provider")
    return s.select("user_id", "chunk_id", "n_references", "provider", F.col("first_seen"), "reference_label")


@query("guardrail_report", f"""
WITH b AS (SELECT {cat.GUARDRAIL_BODY_SQL} AS body FROM events WHERE event_type = 'error'),
r AS (SELECT CASE WHEN json_type(body, '$.message') = 'VARCHAR' THEN json_extract_string(body, '$.message')
                  ELSE body END AS root FROM b),
g AS (SELECT root FROM r WHERE json_valid(root) AND json_type(root) = 'OBJECT'
        AND list_contains(json_keys(root), 'output_guardrail')),
f AS (SELECT {cat.GUARDRAIL_CATEGORY_SQL} AS category FROM g)
SELECT category, count(*) AS n_errors, {cat.GUARDRAIL_MESSAGE_SQL} AS message,
  '[ERROR] Content policy violation detected.' || chr(10) || {cat.GUARDRAIL_MESSAGE_SQL} AS error_text
FROM f GROUP BY category""")
def q_guardrail_report(spark, d):
    e = V.read(spark, d, "events").where(F.col("event_type") == "error")
    return conv.guardrail_report(e.select(cat.guardrail_body(F.col("props")).alias("body")))


@query("citation_labels", """
WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '[?#].*$', '') AS path,
                  regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages),
q AS (SELECT *, split_part(path, '/', -1) AS name, split_part(path, '/', 2) AS document_type,
             regexp_extract(url, 'page=([0-9]+)', 1) AS section FROM p),
s AS (SELECT *, regexp_replace(name, '(?s)^((?:.*/)?\\.*[^./][^/]*)\\.[^./]*$', '\\1') AS stem FROM q)
SELECT page_id, name, stem,
  CASE WHEN length(document_type) > 0 AND length(section) > 0
       THEN stem || ' (' || document_type || ', section ' || section || ')' ELSE stem END AS label,
  upper(substr(split_part(path, '.', 1), 1, 1)) || lower(substr(split_part(path, '.', 1), 2)) AS site,
  regexp_replace(title, '^[^ ]* ', '') AS title_rest
FROM s""")
def q_citation_labels(spark, d):
    p = V.read(spark, d, "pages")
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-zA-Z]+://", ""), r"[?#].*$", "")
    p = p.select("page_id", "url", path.alias("path"),
                 F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("title"))
    doc_type = F.coalesce(F.get(F.split("path", "/"), 1), F.lit(""))
    section = F.regexp_extract("url", r"page=([0-9]+)", 1)
    name = X.last_part("path", "/")
    return p.select(
        "page_id", name.alias("name"), X.file_stem(name).alias("stem"),
        X.citation_label(F.col("path"), doc_type, section).alias("label"),
        X.capitalise(F.substring_index("path", ".", 1)).alias("site"),
        X.after_first_space("title").alias("title_rest"))


@query("action_fields_long", """
WITH a AS (SELECT event_id AS ACTION_ID, upper(event_type) AS CP_ACTION_MNEMONIC,
                  CAST(ts AS DATE) AS CP_ANN_DATE, props FROM events)
SELECT ACTION_ID, CP_ACTION_MNEMONIC, CP_ANN_DATE, k AS field, json_extract_string(props, '$."' || k || '"') AS value
FROM a, unnest(json_keys(props)) AS t(k)""")
def q_action_fields_long(spark, d):
    e = V.read(spark, d, "events")
    raw = e.select(
        F.concat(F.lit("C"), F.col("user_id").cast("string"), F.lit(" US Equity")).alias("IDENTIFIER"),
        F.col("event_id").cast("string").alias("ACTION_ID"),
        F.upper("event_type").alias("CP_ACTION_MNEMONIC"),
        F.date_format("ts", "dd/MM/yyyy").alias("CP_ANN_DATE"),
        F.col("props").alias("ACTION_FIELDS"))
    typed = sch.conform(raw, sch.action_request())
    return typed.select("ACTION_ID", "CP_ACTION_MNEMONIC", "CP_ANN_DATE",
                        F.explode(X.col("ACTION_FIELDS")).alias("field", "value"))


@query("scan_conform_trades", """
SELECT 'P' || CAST(l_partkey AS VARCHAR) || ' US Equity' AS SECURITY,
  l_orderkey * 8 + l_linenumber AS TICK_SEQUENCE_NUMBER, l_shipdate AS EVT_TRADE_TIME,
  round(l_extendedprice, 6) AS EVT_TRADE_PRICE, CAST(l_quantity AS BIGINT) AS EVT_TRADE_SIZE,
  l_returnflag AS EVT_TRADE_CONDITION_CODE, CAST(0 AS INTEGER) AS n_corrupt
FROM lineitem""")
def q_scan_conform_trades(spark, d):
    li = V.read(spark, d, "lineitem")
    raw = li.select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit(" US Equity")).alias("SECURITY"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string").alias("TICK_SEQUENCE_NUMBER"),
        F.lit("TRADE").alias("TICK_TYPE"),
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+0000")).alias("EVT_TRADE_TIME"),
        F.col("l_extendedprice").cast("string").alias("EVT_TRADE_PRICE"),
        F.col("l_quantity").cast("bigint").cast("string").alias("EVT_TRADE_SIZE"),
        F.col("l_returnflag").alias("EVT_TRADE_CONDITION_CODE"))
    typed = sch.conform(raw, sch.tick_trade_request())
    return typed.select(
        "SECURITY", "TICK_SEQUENCE_NUMBER", F.col("EVT_TRADE_TIME").cast("timestamp_ntz").alias("EVT_TRADE_TIME"),
        F.round(F.col("EVT_TRADE_PRICE").cast("double"), 6).alias("EVT_TRADE_PRICE"), "EVT_TRADE_SIZE",
        "EVT_TRADE_CONDITION_CODE", F.size("_corrupt_fields").alias("n_corrupt"))


@query("scan_conform_quotes", """
SELECT 'P' || CAST(l_partkey AS VARCHAR) || ' US Equity' AS SECURITY,
  l_orderkey * 8 + l_linenumber AS TICK_SEQUENCE_NUMBER,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_shipdate END AS EVT_QUOTE_BID_TIME,
  round(l_extendedprice, 6) AS EVT_QUOTE_BID_PRICE, round(l_extendedprice + 1.0, 6) AS EVT_QUOTE_ASK_PRICE,
  round(l_extendedprice + 1.0 - l_extendedprice, 6) AS spread,
  CAST(l_quantity AS BIGINT) AS EVT_QUOTE_BID_SIZE, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS n_corrupt
FROM lineitem""")
def q_scan_conform_quotes(spark, d):
    li = V.read(spark, d, "lineitem")
    ts = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+0000"))
    raw = li.select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit(" US Equity")).alias("SECURITY"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string").alias("TICK_SEQUENCE_NUMBER"),
        F.lit("QUOTE").alias("TICK_TYPE"),
        # returned lines carry an unparseable bid time: it becomes NULL and is listed as corrupt
        F.when(F.col("l_returnflag") == "R", F.lit("n/a")).otherwise(ts).alias("EVT_QUOTE_BID_TIME"),
        F.col("l_extendedprice").cast("string").alias("EVT_QUOTE_BID_PRICE"),
        F.col("l_quantity").cast("bigint").cast("string").alias("EVT_QUOTE_BID_SIZE"),
        ts.alias("EVT_QUOTE_ASK_TIME"),
        (F.col("l_extendedprice") + 1.0).cast("string").alias("EVT_QUOTE_ASK_PRICE"))
    q = sch.conform(raw, sch.tick_quote_request())
    bid, ask = F.col("EVT_QUOTE_BID_PRICE"), F.col("EVT_QUOTE_ASK_PRICE")
    return q.select(
        "SECURITY", "TICK_SEQUENCE_NUMBER",
        F.col("EVT_QUOTE_BID_TIME").cast("timestamp_ntz").alias("EVT_QUOTE_BID_TIME"),
        F.round(bid.cast("double"), 6).alias("EVT_QUOTE_BID_PRICE"),
        F.round(ask.cast("double"), 6).alias("EVT_QUOTE_ASK_PRICE"),
        F.round((ask - bid).cast("double"), 6).alias("spread"),
        "EVT_QUOTE_BID_SIZE", F.size("_corrupt_fields").alias("n_corrupt"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import roundtrips  # noqa: F401  (registers the file round-trip queries)
    from ..streaming import queries as _sq  # noqa: F401
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)


__all__ = ["QUERIES", "ORACLE", "queries", "oracle_sql", "query"]
