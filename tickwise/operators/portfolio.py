"""Portfolio build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_ticker, row_json, ticker_root

def load_vendor_table(raw: DataFrame, market: str = "US") -> DataFrame:
    """P1 + P3 – derive TICKER from IDENTIFIER, then drop IDENTIFIER."""
    return raw.withColumn("TICKER", normalise_ticker("IDENTIFIER", market)).drop("IDENTIFIER")


def enrich_positions(positions: DataFrame, entity: DataFrame, market: str = "US") -> DataFrame:
    """J1 + A1 + P8 – positions ⋈ entity on TICKER, whole-row DISTINCT, then projection.

    The DISTINCT runs over every joined column before the projection, so two
    loads of one company (different DL_REQUEST_ID) stay two rows, as in the
    source notebook; feed ``latest_per_key(entity)`` to get one row per company.
    """
    joined = (positions.withColumn("TICKER", normalise_ticker("ticker", market))
              .join(entity, on="TICKER", how="inner")
              .distinct())
    return joined.select(
        F.col("TICKER").alias("ticker"),
        F.col("LONG_COMP_NAME").alias("company_name"),
        F.col("INDUSTRY_GROUP").alias("industry"),
        F.col("INDUSTRY_SUBGROUP").alias("sector"),
        F.col("CNTRY_OF_DOMICILE").alias("country_of_domicile"),
        F.col("CIE_DES").alias("company_description"),
        F.col("number_of_shares").alias("number_of_shares"),
    )


def unmatched_positions(positions: DataFrame, reference: DataFrame, ref_key: str = "TICKER",
                        market: str = "US") -> DataFrame:
    """J8 – positions without a row in ``reference`` (data gaps); an anti-join.

    Only the distinct reference keys are joined: the partial aggregate
    collapses a hot key map-side (a skewed build side of an anti-join cannot
    be split at runtime).
    """
    keys = reference.select(F.col(ref_key).alias("TICKER")).distinct()
    return (positions.withColumn("TICKER", normalise_ticker("ticker", market))
            .join(keys, "TICKER", "left_anti")
            .select(F.col("TICKER").alias("ticker"), "number_of_shares"))


def portfolio_json(holdings: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A2/X17 – the portfolio as JSON, one object per holding.

    The source function returned the whole table as a single list value; that
    puts the table into one row, so here every holding is its own JSON object
    and the list is the (ordered) result set.
    """
    cols = cols or ["ticker", "company_name", "industry", "sector", "number_of_shares"]
    return holdings.select("ticker", row_json(*cols).alias("position_json"))


def match_ticker(left: DataFrame, left_col: str, right: DataFrame, right_col: str,
                 overrides: dict[str, str] | None = None) -> DataFrame:
    """P2 – match tickers across market suffixes by equi-join on their root."""
    lr = left.withColumn("ticker_root", ticker_root(left_col, overrides))
    rr = right.withColumn("ticker_root", ticker_root(right_col, overrides))
    return lr.join(rr, "ticker_root", "inner")


def register_functions(spark: SparkSession, holdings_view: str) -> list[str]:
    """F2/F3 – publish SQL functions over the holdings view by name, with comments.

    ``get_portfolio_data()`` returns one JSON object per holding;
    ``holdings_in(pattern)`` returns the holdings whose industry contains the
    pattern (case-insensitive). Both are table functions, so callers can filter
    and join them like tables.
    """
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION get_portfolio_data()
        RETURNS TABLE (ticker STRING, position_json STRING)
        COMMENT 'Equity holdings, one JSON object per holding: ticker, company, industry, sector, shares'
        RETURN SELECT ticker,
               to_json(named_struct('ticker', ticker, 'company_name', company_name, 'industry', industry,
                                    'sector', sector, 'number_of_shares', number_of_shares))
        FROM {holdings_view}""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION holdings_in(pattern STRING)
        RETURNS TABLE (ticker STRING, company_name STRING, industry STRING, sector STRING,
                       country_of_domicile STRING, number_of_shares BIGINT)
        COMMENT 'Holdings whose industry contains the given text'
        RETURN SELECT ticker, company_name, industry, sector, country_of_domicile, number_of_shares
        FROM {holdings_view}
        WHERE contains(lower(industry), lower(pattern))""")
    return ["get_portfolio_data", "holdings_in"]
