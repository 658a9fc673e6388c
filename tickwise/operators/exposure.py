"""Exposure, roll-ups, concentration, ranking and data gaps.

Weights divide by the portfolio total, read as a scalar subquery: the total is
computed once as a one-row aggregate and used as a literal, so no row is sent
to a single partition and no cross join is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_ticker
from .portfolio import enrich_positions
from .windows import dense_rank_desc, latest_per_key


def latest_close(prices: DataFrame) -> DataFrame:
    """W8 – last close per ticker; ordered by the bar date as a DATE so the
    aggregate buffer is fixed-width (hash aggregation, no sort)."""
    d = F.to_date("DATE")
    return (prices.groupBy("TICKER")
            .agg(F.max_by("PX_LAST", d).alias("PX_LAST"), F.max(d).alias("_d"))
            .select("TICKER", F.date_format("_d", "yyyy-MM-dd").alias("DATE"), "PX_LAST"))


def value_holdings(positions: DataFrame, prices: DataFrame, market: str = "US") -> DataFrame:
    """J7 – positions ⋈ latest close (left): market value = shares × PX_LAST."""
    px = latest_close(prices)
    pos = positions.withColumn("TICKER", normalise_ticker("ticker", market))
    return (pos.join(px, "TICKER", "left")
            .select(F.col("TICKER").alias("ticker"), "number_of_shares",
                    F.col("DATE").alias("price_date"), F.col("PX_LAST").alias("last_price"),
                    (F.col("number_of_shares") * F.col("PX_LAST")).alias("market_value")))


def holdings(positions: DataFrame, entity: DataFrame, prices: DataFrame, market: str = "US") -> DataFrame:
    """Enriched, valued holdings: newest entity load per ticker, latest close per ticker."""
    ent = latest_per_key(entity, "TICKER", ["DL_SNAPSHOT_START_TIME", "DL_REQUEST_ID"])
    h = enrich_positions(positions, ent, market)
    px = latest_close(prices)
    return (h.join(px, h["ticker"] == px["TICKER"], "left")
            .select(*[h[c] for c in h.columns], F.col("PX_LAST").alias("last_price"),
                    (F.col("number_of_shares") * F.col("PX_LAST")).alias("market_value")))


def _with_weight(grouped: DataFrame, value: str = "market_value") -> DataFrame:
    total = grouped.agg(F.sum(value)).scalar()
    return grouped.withColumn("weight", F.try_divide(F.col(value), total))


def exposure_by(h: DataFrame, dim: str) -> DataFrame:
    """A7/W9 – shares, market value and portfolio weight per value of ``dim``."""
    grouped = h.groupBy(dim).agg(
        F.count(F.lit(1)).alias("n_positions"),
        F.sum("number_of_shares").alias("shares"),
        F.sum("market_value").alias("market_value"))
    return _with_weight(grouped)


def exposure_to(h: DataFrame, dim: str, pattern: str) -> DataFrame:
    """P12 – holdings whose ``dim`` contains ``pattern`` (case-insensitive), with portfolio weight."""
    total = h.agg(F.sum("market_value")).scalar()
    return (h.where(F.lower(F.col(dim)).contains(pattern.lower()))
            .withColumn("weight", F.try_divide(F.col("market_value"), total)))


def risk_rollup(h: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """A8 – security → sector → industry roll-up (``ROLLUP``) with ``grouping_id``."""
    levels = levels or ["industry", "sector", "ticker"]
    return h.rollup(*levels).agg(
        F.grouping_id().alias("grouping_level"),
        F.count(F.lit(1)).alias("n_positions"),
        F.sum("number_of_shares").alias("shares"),
        F.sum("market_value").alias("market_value"))


def exposure_cube(h: DataFrame, dims: list[str]) -> DataFrame:
    """A8 – all combinations of ``dims`` (``CUBE``)."""
    return h.cube(*dims).agg(
        F.grouping_id().alias("grouping_level"),
        F.count(F.lit(1)).alias("n_positions"),
        F.sum("market_value").alias("market_value"))


def concentration(h: DataFrame, dim: str, top_n: int = 3) -> DataFrame:
    """A10 – Herfindahl index Σw² over the groups of ``dim``, the largest weight and
    the top-n groups' share.

    One grouped aggregate feeds everything: with s = Σv over the group values
    v, the index Σ(v/s)² is Σv²/s² and the shares are v/s, so one row of sums
    suffices; only the top-n sum is a second (take-ordered) subquery.
    """
    g = h.groupBy(dim).agg(F.sum("market_value").alias("_v")).where(F.col("_v").isNotNull())
    top = g.orderBy(F.col("_v").desc(), F.col(dim).asc()).limit(top_n).agg(F.sum("_v")).scalar()
    sums = g.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("_v").alias("_s"),
                 F.sum(F.col("_v") * F.col("_v")).alias("_s2"), F.max("_v").alias("_m"))
    return sums.select(
        "n_groups",
        F.try_divide(F.col("_s2"), F.col("_s") * F.col("_s")).alias("hhi"),
        F.try_divide(F.col("_m"), F.col("_s")).alias("max_weight"),
        F.try_divide(top, F.col("_s")).alias(f"top{top_n}_share"))


def rank_drivers(h: DataFrame, key: str = "ticker", value: str = "market_value") -> DataFrame:
    """W5 – rank holdings by market value (dense rank, 1 = largest), after aggregation.

    The ranking evaluates the sums twice, so they are taken as decimals (six places): those do not depend on
    the order in which partial sums arrive, and both evaluations agree to the last bit.
    """
    agg = h.groupBy(key).agg(F.sum(F.col(value).cast("decimal(28,6)")).cast("double").alias(value))
    return dense_rank_desc(agg, value, "risk_rank")


def null_profile(df: DataFrame) -> DataFrame:
    """A11 – NULL count and rate per column, in one aggregation pass, as rows."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    stack = ", ".join(f"'{c}', _n{i}" for i, c in enumerate(df.columns))
    rows = one.selectExpr("_rows", f"stack({len(df.columns)}, {stack}) AS (column_name, null_count)")
    return rows.select("column_name", "null_count", F.col("_rows").alias("row_count"),
                       F.try_divide(F.col("null_count").cast("double"), F.col("_rows")).alias("null_rate"))
