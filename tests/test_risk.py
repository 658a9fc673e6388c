"""Risk drivers, dictionary matching and approximate search against plain versions."""

import datetime as dt
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_CHECK, SF_SMALL
from tickwise.operators import filings as fl
from tickwise.operators import ivf, lexicon, risk

QUERIES = E.queries()


# ------------------------------------------------------------------ covariance and contributions
def _returns(names, dates, rng, missing=0.3):
    day = dt.date(2024, 1, 1)
    common = rng.normal(size=dates)
    return [(f"N{i}", (day + dt.timedelta(days=t)).isoformat(), float(0.5 * common[t] + rng.normal() + i))
            for i in range(names) for t in range(dates) if rng.random() > missing]


def _cov(rows):
    by = {}
    for n, t, x in rows:
        if x is not None:
            by.setdefault(n, {})[t] = x
    out = {}
    for a in by:
        for b in by:
            both = sorted(set(by[a]) & set(by[b]))
            if a <= b and len(both) >= 2:
                out[a, b] = (len(both), float(np.cov([by[a][t] for t in both], [by[b][t] for t in both])[0, 1]))
    return out


@pytest.mark.parametrize("block", [256, 4])
def test_covariances_equal_pairwise_complete_ones(spark, block):
    rows = _returns(13, 40, np.random.default_rng(1)) + [("N0", "2025-01-01", None), ("LONE", "2024-01-02", 1.0)]
    returns = spark.createDataFrame(rows, "TICKER string, DATE string, daily_return double").repartition(3)
    held = spark.createDataFrame([(f"N{i}",) for i in range(0, 13, 2)] + [("LONE",), ("ABSENT",), ("N0",)], "TICKER string")
    got = {(r.ticker_a, r.ticker_b): (r.n_dates, r.covariance)
           for r in risk.covariances(returns, held, block_names=block).collect()}
    names = {r[0] for r in held.collect()}
    want = {k: v for k, v in _cov(rows).items() if set(k) <= names}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_covariances_send_a_series_once_per_block_of_few(spark, monkeypatch):
    monkeypatch.setattr(risk, "TILE_NAMES", 3)
    monkeypatch.setattr(risk, "DATE_RUN", 7)
    sent, by_pair = [], risk._by_pair
    monkeypatch.setattr(risk, "_by_pair", lambda rows, blocks: (sent.append((rows.count(), blocks)), by_pair(rows, blocks))[1])
    rows = _returns(40, 20, np.random.default_rng(3))
    returns = spark.createDataFrame(rows, "TICKER string, DATE string, daily_return double").repartition(3)
    held = spark.createDataFrame([(f"N{i}",) for i in range(40)], "TICKER string")
    got = {(r.ticker_a, r.ticker_b): (r.n_dates, r.covariance) for r in risk.covariances(returns, held, block_names=1).collect()}
    want = _cov(rows)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    # one row a name, to as many blocks as the tasks need, not to one per name
    assert sent == [(40, risk.math.isqrt(8 * spark.sparkContext.defaultParallelism) + 1)] and sent[0][1] < 40
    monkeypatch.setattr(risk, "BLOCK_ROWS", 20)  # many returns make more blocks
    assert risk.covariances(returns, held, block_names=1).count() == len(want) and sent[1][1] == -(-len(rows) // 20)


@pytest.mark.parametrize("block", [256, 3])
def test_contributions_add_up_to_the_variance_at_every_level(spark, block):
    rng = np.random.default_rng(2)
    rows = _returns(10, 30, rng, missing=0.1)
    returns = spark.createDataFrame(rows, "TICKER string, DATE string, daily_return double")
    holdings = [(f"N{i}", f"Issuer{i // 2}", f"Sector{i // 5}", float(100 + i)) for i in range(10)]
    holdings += [("N3", "Issuer1", "Sector0", 50.0), ("NORET", "Issuer9", None, 10.0), ("NOVALUE", "Issuer9", None, None)]
    h = spark.createDataFrame(holdings, "ticker string, company_name string, sector string, market_value double")
    c = {r.ticker: r for r in risk.risk_contributions(h, returns, block_names=block).collect()}
    cov, total = _cov(rows), sum(v for *_, v in holdings if v is not None)
    w = Counter()
    for n, _, _, v in holdings:
        w[n] += (v or 0) / total
    full = lambda a, b: cov.get((min(a, b), max(a, b)), (0, 0.0))[1]
    variance = sum(w[a] * w[b] * full(a, b) for a in w for b in w)
    known = [r for r in c.values() if r.contribution is not None]
    assert abs(sum(r.contribution for r in known) - variance) < 1e-9 and abs(sum(r.share for r in known) - 1) < 1e-9
    for n in (f"N{i}" for i in range(10)):
        assert abs(c[n].marginal - sum(w[b] * full(n, b) for b in w)) < 1e-9
        assert abs(c[n].volatility - full(n, n) ** 0.5) < 1e-9
    assert c["NOVALUE"].weight is None and c["NORET"].contribution is None and c["NORET"].risk_rank is None
    assert [r.ticker for r in sorted(known, key=lambda r: r.risk_rank)] == [r.ticker for r in sorted(known, key=lambda r: -r.contribution)]
    roll = risk.risk_contribution_rollup(h, returns, block_names=block).collect()
    level = {g: sum(r.contribution or 0 for r in roll if r.grouping_level == g) for g in (0, 1, 3, 7)}
    assert all(abs(v - variance) < 1e-9 for v in level.values())


@pytest.mark.parametrize("tile, run, block", [(1024, 1024, 16384), (3, 4, 5)])
def test_names_of_the_same_dates_are_paired_once(spark, monkeypatch, tile, run, block):
    rng = np.random.default_rng(3)
    calendars = [sorted(rng.choice(15, size=k, replace=False).tolist()) for k in (15, 9, 9, 7, 4, 2, 2, 1)]
    rows = [(f"N{i}", f"2024-01-{t + 1:02d}", float(rng.normal() + i)) for i in range(48) for t in calendars[i % 8]]
    rows += [("BAD", f"2024-01-{t + 1:02d}", float("nan") if t == 3 else 1.0) for t in calendars[0]]
    returns = spark.createDataFrame(rows, "TICKER string, DATE string, daily_return double")
    weights = {n: float(rng.random()) for n in {r[0] for r in rows} if n != "N5"}
    frame = spark.createDataFrame([*weights.items(), ("ABSENT", 1.0)], "TICKER string, weight double")
    paired, inner = [], risk._calendar_sums
    monkeypatch.setattr(risk, "_calendar_sums", lambda c, blocks: paired.append((c.count(), blocks)) or inner(c, blocks))
    monkeypatch.setattr(risk, "TILE", tile)
    monkeypatch.setattr(risk, "DATE_RUN", run)
    got = {r.TICKER: r for r in risk.marginal_risk(returns, frame, block_names=block).collect()}
    different = len({tuple(c) for c in calendars if len(c) > 1})
    assert paired == [(different, -(-different // block))]  # not 42 names
    cov = _cov([r for r in rows if r[0] in weights and r[0] != "BAD"])
    full = lambda a, b: cov.get((min(a, b), max(a, b)), (0, 0.0))[1]
    assert got.keys() == weights.keys()
    for n in weights:
        if n == "BAD" or int(n[1:]) % 8 == 7:
            assert got[n].variance is None and got[n].marginal is None
        else:
            assert abs(got[n].marginal - sum(w * full(n, b) for b, w in weights.items())) < 1e-9
            assert abs(got[n].variance - full(n, n)) < 1e-9


def test_risk_without_returns_or_holdings(spark):
    none = spark.createDataFrame([], "TICKER string, DATE string, daily_return double")
    h = spark.createDataFrame([("A", "I", "S", 1.0)], "ticker string, company_name string, sector string, market_value double")
    assert [tuple(r) for r in risk.risk_contributions(h, none).select("ticker", "contribution", "risk_rank").collect()] == [("A", None, None)]
    assert risk.risk_contributions(h.where("false"), none).count() == 0
    assert risk.covariances(none, spark.createDataFrame([("A",)], "TICKER string")).count() == 0


# ------------------------------------------------------------------ dictionary matching
def _found(texts, terms):
    out = Counter()
    for key, text in texts:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        for term, value in {(lexicon.normalised(k), v) for k, v in terms}:
            t = term.split()
            if t:
                out[key, term, value] += sum(words[i:i + len(t)] == t for i in range(len(words) - len(t) + 1))
    return {k: n for k, n in out.items() if n}


@pytest.mark.parametrize("limit", [lexicon.BROADCAST_PREFIXES, 0])
def test_matches_equal_a_scan_for_every_term(spark, limit):
    rng = random.Random(8)
    words = ["a", "b", "ab", "Ünï", "c", "the"]
    texts = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "-", " 1 "]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "a"), (103, "the " * 3000 + "a b")]
    terms = [(" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))), f"v{rng.randint(0, 3)}") for _ in range(40)]
    terms += [("a-b", "v0"), ("A b", "v9"), ("", "none"), ("12", "none"), ("absent word", "v1"), ("the the the the the the the", "v2")]
    lex = lexicon.lexicon(spark, spark.createDataFrame(terms, "t string, v string"), limit)
    frame = spark.createDataFrame(texts, "k int, text string").repartition(3)
    got = Counter((r.k, r.term, r.value) for r in lexicon.matches(frame, ["k"], "text", lex).collect())
    assert dict(got) == _found(texts, terms)
    assert lexicon.matches(frame, ["k"], "text", lexicon.lexicon(spark, {})).count() == 0


@pytest.mark.parametrize("name", ["link_mentions", "risk_signals", "theme_exposure"])
def test_the_lexicon_is_built_never_the_text(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    text_side = [line for line in plan.splitlines() if "Generate posexplode" in line]
    assert text_side and "BroadcastHashJoin" in plan and "BuildLeft" not in plan.split("Generate posexplode")[0].rsplit("HashAggregate", 1)[-1]
    for part in plan.split("BroadcastExchange")[1:]:
        first_scan = re.search(r"(FileScan|LocalTableScan|Scan ExistingRDD)[^\n]*", part)
        assert not (first_scan and "text#" in first_scan[0])


def test_null_texts_and_large_alias_table(spark):
    chunks = spark.createDataFrame([(1, "C1", "acme corp and acme"), (2, "C2", None)], "chunk_id int, symbol string, content string")
    names = spark.range(3000).select(F.concat(F.lit("acme n"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("a"),
                                     F.lit("X").alias("t")).union(spark.createDataFrame([("Acme Corp", "A")], "a string, t string"))
    got = {(r.chunk_id, r.ticker): r.n_mentions for r in fl.link_mentions(chunks, names).collect()}
    assert got == {(1, "A"): 1}


# ------------------------------------------------------------------ inverted file
def test_inverted_file_reaches_the_recall_and_exact_scores(spark, tmp_dir):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 32)) * 3
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (5003, [1.0, 2.0]), (None, x[0].tolist())]
    corpus = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    ask = [(1000 + i, x[i].tolist()) for i in range(0, 200, 5)] + [(7, [0.0] * 32), (8, None)]
    queries = spark.createDataFrame(ask, "q long, v array<double>")
    index = ivf.build(corpus, "id", "v", f"{tmp_dir}/ivf", cells=40, subspaces=8, sample_rows=1000)
    assert spark.read.parquet(f"{tmp_dir}/ivf").count() == 3000  # every usable row is indexed
    got = {}
    for r in ivf.search(corpus, index, queries, 10, "v", "q", "v", probes=8).collect():
        got.setdefault(r.query_id, {})[r.id] = r.score
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, v in ask[:-2]:
        scores = u @ (np.array(v) / np.linalg.norm(v))
        best = set(np.argsort(-scores)[:10].tolist())
        hits += len(best & set(got[q]))
        assert all(abs(scores[i] - s) < 1e-9 for i, s in got[q].items())
    assert hits >= 0.9 * 10 * (len(ask) - 2) and set(got) == {q for q, _ in ask[:-2]}


def test_inverted_file_of_nothing(spark, tmp_dir):
    none = spark.createDataFrame([], "id long, v array<double>")
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "q long, v array<double>")
    index = ivf.build(none, "id", "v", f"{tmp_dir}/empty")
    assert ivf.search(none, index, queries, 3, "v", "q", "v").count() == 0


def test_registered_search_keeps_its_recall(spark):
    r = QUERIES["similarity_search_ivf"](spark, SF_CHECK).first()
    assert r.recall_reached and r.scores_exact
