"""Portfolio and market operators on the vendor fixtures of FIXTURES.md §1-§3."""

import math

from pyspark.sql import functions as F

from tickwise.operators import exposure as ex
from tickwise.operators import market as mk
from tickwise.operators import portfolio as pf
from tickwise.sinks import tables as tb
from tickwise.sources import readers as rd

ENTITY_COLS = ("IDENTIFIER string, BS_SH_OUT double, CIE_DES string, CNTRY_OF_DOMICILE string, DL_REQUEST_ID string, "
               "DL_REQUEST_NAME string, DL_SNAPSHOT_START_TIME string, DL_SNAPSHOT_TZ string, ID_BB_COMPANY long, "
               "INDUSTRY_GROUP string, INDUSTRY_SUBGROUP string, LEGAL_ENTITY_IDENTIFIER string, "
               "LONG_COMP_NAME string, RC long")


def _entity(spark):
    row = lambda ident, req, snap, ind: (ident, 1.0, "desc", "US", req, "EntityRequest", snap, "UTC", 1, ind,
                                         "Food", "LEI1", ident.split(" ")[0] + " Inc", 0)
    rows = [row("BG US Equity", "r1", "2024-02-01T06:00:00", "Agriculture"),
            row("BG US Equity", "r2", "2024-02-02T06:00:00", "Agriculture"),      # second load: two rows stay
            row("HD US Equity", "r1", "2024-02-01T06:00:00", "Retail"),
            row("HD US Equity", "r1", "2024-02-01T06:00:00", "Retail"),           # exact repeat: collapses
            row("XX US Equity", "r1", "2024-02-01T06:00:00", None)]               # NULL industry
    return pf.load_vendor_table(spark.createDataFrame(rows, ENTITY_COLS))


def _positions(spark):
    return spark.createDataFrame([("BG US Equity", 4469), ("HD US Equity", 10), ("XX US Equity", 5),
                                  ("BP LN Equity", 7), (None, 3)], "ticker string, number_of_shares long")


def test_enrich_positions_distinct_before_projection(spark):
    out = pf.enrich_positions(_positions(spark), _entity(spark)).collect()
    by = {}
    for r in out:
        by.setdefault(r["ticker"], []).append(r)
    assert len(by["BG-US"]) == 2                 # two loads survive DISTINCT (it runs before the projection)
    assert len(by["HD-US"]) == 1                 # the exact repeat collapses
    assert by["XX-US"][0]["industry"] is None
    assert "BP-US" not in by                     # LN ticker is normalised to -US and finds no entity
    gaps = pf.unmatched_positions(_positions(spark), _entity(spark)).collect()
    # a position without identifier has no entity either: it is reported as a gap
    assert sorted((r["ticker"] or "") for r in gaps) == ["", "BP-US"]


def test_latest_load_per_company(spark):
    from tickwise.operators.windows import latest_per_key
    latest = latest_per_key(_entity(spark), "TICKER", ["DL_SNAPSHOT_START_TIME", "DL_REQUEST_ID"])
    got = {r["TICKER"]: r["DL_REQUEST_ID"] for r in latest.collect()}
    assert got == {"BG-US": "r2", "HD-US": "r1", "XX-US": "r1"}


def _prices(spark):
    rows = [("BG-US", "2024-01-02", 10.0, 100), ("BG-US", "2024-01-03", 11.0, 120),
            ("BG-US", "2024-01-04", 11.0, 120),          # closed day: the bar repeats (stale)
            ("BG-US", "2024-01-05", None, 90), ("BG-US", "2024-01-08", 12.1, 80),
            ("HD-US", "2024-01-02", 0.0, 5), ("HD-US", "2024-01-03", 5.0, 6),   # zero close: no return after it
            ("ZZ-US", "2024-01-02", 3.0, 1)]                                   # one-row ticker
    return spark.createDataFrame(rows, "TICKER string, DATE string, PX_LAST double, PX_VOLUME long")


def test_daily_returns_nulls_zero_and_stale(spark):
    r = {(x["TICKER"], x["DATE"]): x["daily_return"] for x in mk.daily_returns(_prices(spark)).collect()}
    assert r[("BG-US", "2024-01-02")] is None
    assert math.isclose(r[("BG-US", "2024-01-03")], 0.1)
    assert r[("BG-US", "2024-01-04")] == 0.0
    assert r[("BG-US", "2024-01-05")] is None and r[("BG-US", "2024-01-08")] is None   # NULL close, then NULL lag
    assert r[("HD-US", "2024-01-03")] is None and r[("ZZ-US", "2024-01-02")] is None
    s = {(x["TICKER"], x["DATE"]): x["daily_return"]
         for x in mk.daily_returns(_prices(spark), drop_stale=True).collect()}
    assert s[("BG-US", "2024-01-04")] is None and math.isclose(s[("BG-US", "2024-01-03")], 0.1)
    lg = {(x["TICKER"], x["DATE"]): x["daily_return"] for x in mk.daily_returns(_prices(spark), log=True).collect()}
    assert math.isclose(lg[("BG-US", "2024-01-03")], math.log(1.1))


def test_volatility_top_performers_most_traded(spark):
    rets = mk.daily_returns(_prices(spark))
    vol = {r["TICKER"]: r for r in mk.volatility(rets).collect()}
    assert vol["BG-US"]["n_returns"] == 2 and math.isclose(vol["BG-US"]["volatility"], math.sqrt(0.005))
    assert vol["ZZ-US"]["volatility"] is None
    top = mk.top_performers(_prices(spark), k=2).collect()
    assert [r["TICKER"] for r in top] == ["BG-US", "ZZ-US"]          # HD-US starts at 0: no period return
    assert math.isclose(top[0]["period_return"], 0.21)
    mt = mk.most_traded(_prices(spark), "TICKER", "PX_VOLUME", 1).collect()
    assert [(r["TICKER"], r["total_volume"]) for r in mt] == [("BG-US", 510)]
    roll = {r["DATE"]: r["rolling_vol"] for r in mk.rolling_volatility(rets, 2).where(F.col("TICKER") == "BG-US").collect()}
    assert roll["2024-01-02"] is None and math.isclose(roll["2024-01-04"], math.sqrt(0.005))


def test_exposure_weights_sum_to_one(spark):
    h = ex.holdings(_positions(spark), _entity(spark), _prices(spark))
    e = ex.exposure_by(h, "industry").collect()
    assert math.isclose(sum(r["weight"] for r in e if r["weight"] is not None), 1.0)
    c = ex.concentration(h, "industry").first()
    assert c["n_groups"] >= 1 and 0 < c["hhi"] <= 1


def test_table_comments_survive_overwrite(spark, tmp_dir):
    name = "tw_test_positions"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    tb.declare_table(spark, name, rd.POSITIONS_SCHEMA_DOC, comment="Positions", location=f"{tmp_dir}/t")
    tb.overwrite_table(_positions(spark), name)
    tb.overwrite_table(_positions(spark).where(F.col("ticker").isNotNull()), name)
    assert spark.table(name).count() == 4
    cols = {r["col_name"]: r["comment"] for r in spark.sql(f"DESCRIBE TABLE {name}").collect()}
    assert cols["number_of_shares"] == "Shares held"
    assert "Positions" in [r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
                           if r["col_name"] == "Comment"]


def test_scan_responses_many_dirs_per_type(spark, tmp_dir):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(6)], "a long, b string")
    df.where("a < 2").write.json(f"{tmp_dir}/r1")
    df.where("a >= 2 AND a < 4").write.json(f"{tmp_dir}/r2")
    df.where("a >= 4").write.option("header", True).csv(f"{tmp_dir}/r3")
    manifest = spark.createDataFrame([("application/json", f"{tmp_dir}/r1"), ("application/json", f"{tmp_dir}/r2"),
                                      ("text/csv; charset=utf-8", f"{tmp_dir}/r3")],
                                     "content_type string, output_dir string")
    out = rd.scan_responses(spark, manifest, df.schema, json_multi_line=False)
    assert sorted((r["a"], r["b"]) for r in out.collect()) == [(i, f"n{i}") for i in range(6)]
    assert out.where(F.col("source_file").contains("/r2/")).count() == 2


def test_sql_functions_published_with_descriptions(spark):
    h = ex.holdings(_positions(spark), _entity(spark), _prices(spark))
    h.createOrReplaceTempView("tw_test_holdings")
    names = pf.register_functions(spark, "tw_test_holdings")
    assert names == ["get_portfolio_data", "holdings_in"]
    rows = spark.sql("SELECT * FROM get_portfolio_data()").collect()
    assert {r["ticker"] for r in rows} == {"BG-US", "HD-US", "XX-US"}
    assert all(r["position_json"].startswith('{"ticker":') for r in rows)
    retail = spark.sql("SELECT ticker FROM holdings_in('RETAIL')").collect()
    assert [r["ticker"] for r in retail] == ["HD-US"]
    desc = " ".join(str(r[0]) for r in spark.sql("DESCRIBE FUNCTION EXTENDED holdings_in").collect())
    assert "industry contains" in desc


def test_tar_archives_written_on_executors(spark, tmp_dir):
    import glob
    from tickwise.plans.roundtrips import write_tar_archives
    df = spark.range(0, 1234).select(F.col("id"), (F.col("id") * 2).alias("v"))
    n = write_tar_archives(df, f"{tmp_dir}/tars", rows_per_archive=300)
    assert n == 5 and len(glob.glob(f"{tmp_dir}/tars/*.tar")) == 5
    back = rd.scan_response(spark, "application/x-tar", f"{tmp_dir}/tars", df.schema)
    assert back.count() == 1234 and back.select(F.sum("v")).first()[0] == 2 * sum(range(1234))
    assert back.where(~F.col("member").startswith("data/member-")).count() == 0


def test_industry_stats_with_spreads(spark):
    px = spark.createDataFrame([
        ("BG-US", "2024-01-02", 100, 10.0, 10.2), ("BG-US", "2024-01-03", 300, None, 11.0),
        ("HD-US", "2024-01-02", 50, 5.0, 5.1), ("XX-US", "2024-01-02", 7, 1.0, 1.5)],
        "TICKER string, DATE string, PX_VOLUME long, PX_BID double, PX_ASK double")
    ent = spark.createDataFrame([("BG-US", "Food"), ("HD-US", "Food"), ("XX-US", "Retail")],
                                "TICKER string, INDUSTRY_GROUP string")
    got = {r["industry"]: r for r in mk.industry_stats(px, ent).collect()}
    food = got["Food"]
    assert (food["n_bars"], food["n_tickers"], food["total_volume"], food["min_volume"], food["max_volume"]) == (
        3, 2, 450, 50, 300)
    assert math.isclose(food["avg_volume"], 150.0)
    assert math.isclose(food["avg_spread"], (0.2 + 0.1) / 2)              # the bar without a bid has no spread
    assert got["Retail"]["n_tickers"] == 1 and math.isclose(got["Retail"]["avg_spread"], 0.5)


def test_bucketed_windows_equal_plain_per_ticker_windows(spark):
    """Halo-bucketed lag / rolling windows = plain per-ticker windows, for any bucketing."""
    import datetime as dt
    import random

    from pyspark.sql import Window
    rng = random.Random(9)
    rows = []
    for t in ["HOT", "B", "C"]:
        day = dt.date(2023, 1, 2)
        for _ in range(400 if t == "HOT" else 40):
            day += dt.timedelta(days=rng.choice([1, 1, 1, 3, 17, 45]))           # gaps across months
            px = rng.choice([None, 0.0, round(rng.uniform(1, 100), 2)]) if rng.random() < 0.1 \
                else round(rng.uniform(1, 100), 2)
            rows.append((t, day.isoformat(), px, rng.randint(1, 5)))
    prices = spark.createDataFrame(rows, "TICKER string, DATE string, PX_LAST double, PX_VOLUME long")
    w = Window.partitionBy("TICKER").orderBy("DATE")
    prev = F.lag("PX_LAST").over(w)
    plain = prices.withColumn("daily_return", F.when(prev.isNull() | (prev == 0), None)
                              .otherwise(F.col("PX_LAST") / prev - 1.0))
    plain = plain.withColumn("rolling_vol", F.stddev_samp("daily_return").over(w.rowsBetween(-4, 0)))
    expected = {(r["TICKER"], r["DATE"]): (r["daily_return"], r["rolling_vol"]) for r in plain.collect()}
    for bucket in (F.to_date("DATE"), F.date_trunc("month", F.col("DATE").cast("timestamp")),
                   F.year(F.col("DATE").cast("date"))):
        rets = mk.daily_returns(prices, bucket=bucket)
        vol = mk.rolling_volatility(rets, 5, bucket=bucket)
        got = {(r["TICKER"], r["DATE"]): (r["daily_return"], r["rolling_vol"]) for r in vol.collect()}
        assert got.keys() == expected.keys()
        for k, (a, b) in expected.items():
            ga, gb = got[k]
            assert (a is None and ga is None) or math.isclose(a, ga, rel_tol=1e-12, abs_tol=1e-12), k
            assert (b is None and gb is None) or math.isclose(b, gb, rel_tol=1e-9, abs_tol=1e-12), k
