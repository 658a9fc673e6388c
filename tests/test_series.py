"""Decayed volatility, split adjustment, load profiles, similar names and streams with timers against plain versions."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_CHECK
from tickwise.operators import market as mk
from tickwise.operators import names as nm
from tickwise.operators import profile as pr
from tickwise.operators.windows import linear_scan
from tickwise.streaming.deadlines import stream_await, stream_carry_expiring, timer_state
from tickwise.streaming.sources import run_available_now

QUERIES = E.queries()
DAY = dt.date(2024, 1, 1)


# ------------------------------------------------------------------ recurrences
def test_linear_scan_equals_the_plain_recurrence(spark):
    rng = random.Random(1)
    rows = [(k, t, rng.choice([0.5, 1.0, 2.0]), rng.randint(-3, 3) * 1.0, rng.choice([None, 1.0, 4.0]))
            for k in ("a", "b", None) for t in range(50)]
    df = spark.createDataFrame(rows, "k string, t int, a double, b double, s double").repartition(4)
    got = {(r.k, r.t): r.out for r in linear_scan(df, "k", "t", F.col("a"), F.col("b"), F.col("s"), F.floor(F.col("t") / 7), "out").collect()}
    state = {}
    for k, t, a, b, s in rows:
        state[k] = s if state.get(k) is None else a * state[k] + b
        assert (got[k, t] is None) == (state[k] is None)
        assert state[k] is None or abs(got[k, t] - state[k]) <= 1e-9 * max(1, abs(state[k]))


def test_linear_scan_chains_rows_without_a_bucket_last(spark):
    df = spark.createDataFrame([("a", 1, 4.0), ("a", None, 9.0), ("a", 5, 1.0)], "k string, t int, s double")
    out = linear_scan(df, "k", "t", F.lit(0.5), F.lit(1.0), F.col("s"), F.floor(F.col("t") / 4), "out")
    assert {r.t: r.out for r in out.collect()} == {1: 4.0, 5: 3.0, None: 2.5}


@pytest.mark.parametrize("bucket", ["month", "day", "year"])
def test_ewma_volatility_of_one_long_ticker(spark, bucket):
    rng = random.Random(2)
    rows = [("HOT", (DAY + dt.timedelta(days=i)).isoformat(), None if i % 11 < 2 else rng.gauss(0, 0.02)) for i in range(300)]
    df = spark.createDataFrame(rows + [("NONE", "2024-01-01", None)], "TICKER string, DATE string, daily_return double")
    out = mk.ewma_volatility(df, bucket=F.date_trunc(bucket, F.col("DATE").cast("timestamp")))
    got = {(r.TICKER, r.DATE): r.ewma_vol for r in out.collect()}
    v = None
    for t, d, r in rows:
        if r is not None:
            v = r * r if v is None else 0.94 * v + 0.06 * r * r
        assert (got[t, d] is None) if v is None else abs(got[t, d] - math.sqrt(v)) < 1e-12
    assert got["NONE", "2024-01-01"] is None and len(got) == 301


def test_linear_scan_takes_all_groups_of_a_task_in_one_call(spark):
    rows = [(f"k{k}", t, None if t < 2 else float(t)) for k in range(40) for t in range(9)] + [(None, 3, 1.0)]
    df = spark.createDataFrame(rows, "k string, t int, s double").withColumn("kept", F.struct("t", F.array("s")))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # groups go on in the next batch
    try:
        out = linear_scan(df, "k", "t", F.lit(0.5), F.lit(1.0), F.col("s"), F.floor(F.col("t") / 4), "out")
        got = {(r.k, r.t): (r.out, r.kept.t) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    state = {}
    for k, t, s in rows:
        state[k] = s if state.get(k) is None else 0.5 * state[k] + 1.0
        assert got[k, t][1] == t and (got[k, t][0] is None if state[k] is None else abs(got[k, t][0] - state[k]) < 1e-12)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsIn" not in plan and "MapInArrow" in plan


def test_adjusted_prices_take_the_product_of_later_splits(spark):
    rng = random.Random(3)
    bars = [(t, (DAY + dt.timedelta(days=i)).isoformat(), 100.0 + i, 10) for t in ("A-US", "B-US", "C-US") for i in range(0, 200, 3)]
    actions = [(f"{t} US Equity", i, "STOCK_SPLT", DAY + dt.timedelta(days=rng.randint(-5, 210)), {"CP_RATIO": rng.choice(["2", "0.5", "3"])})
               for i, t in enumerate(rng.choices("AB", k=12))]
    bad = [("A US Equity", 90, "STOCK_SPLT", None, {"CP_RATIO": "2"}), ("A US Equity", 91, "STOCK_SPLT", DAY, {"CP_RATIO": "-1"}),
           ("A US Equity", 92, "STOCK_SPLT", DAY + dt.timedelta(days=150), {}), ("A US Equity", 93, "DIVIDEND", DAY + dt.timedelta(days=150), {"CP_RATIO": "2"}),
           actions[0]]
    typed = spark.createDataFrame(actions + bad, "IDENTIFIER string, ACTION_ID long, CP_ACTION_MNEMONIC string, CP_EFFECTIVE_DATE date, ACTION_FIELDS map<string,string>")
    prices = spark.createDataFrame(bars, "TICKER string, DATE string, PX_LAST double, PX_VOLUME long")
    got = {(r.TICKER, r.DATE): r for r in mk.adjusted_prices(prices, mk.split_factors(typed)).collect()}
    assert len(got) == len(bars)
    for t, d, px, vol in bars:
        want = math.prod(1 / float(f["CP_RATIO"]) for i, _, _, on, f in actions if i.startswith(t[0]) and on > dt.date.fromisoformat(d))
        r = got[t, d]
        assert abs(r.adjustment - want) < 1e-9 * want and abs(r.ADJ_PX_LAST - px * want) < 1e-6 and abs(r.ADJ_PX_VOLUME - vol / want) < 1e-6


# ------------------------------------------------------------------ profiles over loads
def test_profiles_merge_over_loads_and_replace_a_load(spark, tmp_dir):
    rng = random.Random(4)
    rows = [(f"l{i % 3}", rng.choice([None, *"abcdef"]), rng.choice([None, rng.random()]), rng.randint(0, 5000)) for i in range(6000)]
    df = spark.createDataFrame(rows, "load string, s string, x double, n int")
    path = f"{tmp_dir}/profile"
    for load in ("l0", "l1"):
        pr.profile_loads(df.where(F.col("load") == load), "load", path)
    pr.profile_loads(df.where("load = 'l2'").withColumn("x", F.lit(None).cast("double")), "load", path)
    pr.profile_loads(df.where("load = 'l2'"), "load", path)  # the load again: replaced, not added
    got = {r.column_name: r for r in pr.merged_profile(spark, path).collect()}
    for c, at in (("s", 1), ("x", 2), ("n", 3)):
        values = sorted(r[at] for r in rows if r[at] is not None)
        assert (got[c].row_count, got[c].null_count, got[c].n_distinct) == (6000, 6000 - len(values), len(set(values)))
        if c == "s":
            assert got[c].quantiles is None
        else:
            for q, v in zip(pr.QUANTILES, got[c].quantiles):
                assert abs(sum(x <= v for x in values) / len(values) - q) < 0.02
    some = {r.column_name: r.row_count for r in pr.merged_profile(spark, path, ["l0"]).collect()}
    assert some == {"s": 2000, "x": 2000, "n": 2000}


# ------------------------------------------------------------------ similar names
def _grams(name):
    x = " " + " ".join(name.lower().split()) + " "
    return {x[i:i + 3] for i in range(len(x) - 2)}


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_similar_names_equal_all_pairs(spark, threshold):
    rng = random.Random(5)
    names = ["Acme Holdings Inc", "Acme Holding Inc", "ACME  holdings inc", "Beta", "beta", "Bet", "x", "", "  ", "Zürich AG", "Zurich AG"]
    for _ in range(60):
        base = list(rng.choice(names[:6]))
        base[rng.randrange(len(base))] = rng.choice("abcdxyz ")
        names.append("".join(base))
    frame = spark.createDataFrame([(n,) for n in names + [None]] * 2, "n string").repartition(3)
    classes = {r.name: r["class"] for r in nm.spelling_classes(frame, "n").collect()}
    sets = {}
    for n in sorted(set(names)):
        if n.strip():
            sets.setdefault(frozenset(_grams(n)), n)
    assert classes == {n: sets[frozenset(_grams(n))] for n in set(names) if n.strip()}
    want = {}
    for a in sets.values():
        for b in sets.values():
            x, y = _grams(a), _grams(b)
            if a < b and len(x & y) / len(x | y) >= threshold - 1e-12:
                want[a, b] = len(x & y) / len(x | y)
    out = nm.similar_names(frame, "n", threshold)
    got = {(r.name_a, r.name_b): r.similarity for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_similar_names_of_crowded_trigrams_in_cells(spark):
    rng = random.Random(7)
    parts = ["an", "the", "er", "on", "st", "en", "re", "ou"]
    names = list({"".join(rng.choice(parts) for _ in range(rng.randint(4, 9))) for _ in range(150)})
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    reps = {}
    for n in sorted(names):
        reps.setdefault(frozenset(_grams(n)), n)
    want = {(a, b) for x, a in reps.items() for y, b in reps.items() if a < b and len(x & y) / len(x | y) >= 0.4 - 1e-12}
    out = nm.similar_names(frame, "n", 0.4, cell_names=8)
    got = [(r.name_a, r.name_b) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    # sets too far apart by their signatures go before the candidates are shuffled
    assert "bit_count" in [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x and "lo" in x][0]


# ------------------------------------------------------------------ timers
T0 = dt.datetime(2024, 1, 1)
REQ = "identifier string, submitted_at timestamp, request_event_id long"
NOT = "generated_identifier string, received_at timestamp, notification_id long"


def _at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def _state_rows(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).count()


def test_waits_end_by_their_deadline_and_leave_no_state(spark, tmp_dir):
    for name, schema in (("req", REQ), ("not", NOT)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_dir}/{name}/0000")

    def step(n, requests, notices):
        spark.createDataFrame(requests, REQ).write.parquet(f"{tmp_dir}/req/{n:04d}")
        spark.createDataFrame(notices, NOT).write.parquet(f"{tmp_dir}/not/{n:04d}")
        r = spark.readStream.schema(REQ).parquet(f"{tmp_dir}/req/*")
        q = spark.readStream.schema(NOT).parquet(f"{tmp_dir}/not/*")
        with timer_state(spark):
            run_available_now(stream_await(r, q, 45), f"{tmp_dir}/out", f"{tmp_dir}/ckpt", state_partitions=2)
        got = spark.read.parquet(f"{tmp_dir}/out").collect()
        assert len({r.request_event_id for r in got}) == len(got)
        return {r.request_event_id: (r.notification_id, r.timed_out) for r in got}

    # b's second notice arrives before its first one; nothing is due yet
    assert step(1, [("a", _at(0), 1), ("b", _at(5), 2), ("b", _at(50), 3)], [("b.json", _at(30), 11), ("b.csv", _at(20), 10)]) == {}
    # another identifier's event moves the watermark past the first deadlines
    assert step(2, [("c", _at(65), 4)], []) == {1: (None, True), 2: (10, False)}
    got = step(3, [], [("z", _at(400), 99)])
    assert got == {1: (None, True), 2: (10, False), 3: (None, True), 4: (None, True)}
    step(4, [], [("y", _at(1000), 98)])  # clears z's notice as well
    assert _state_rows(spark, f"{tmp_dir}/ckpt", "requests") == 0
    assert _state_rows(spark, f"{tmp_dir}/ckpt", "notices") <= 1


def test_a_wait_calls_the_state_store_a_few_times_for_many_events():
    import collections

    import pandas as pd

    from tickwise.streaming.deadlines import _Wait

    calls, timers = collections.Counter(), set()

    class Value:
        value = None

        def get(self):
            calls["get"] += 1
            return self.value

        def update(self, value):
            calls["update"] += 1
            self.value = value

        def clear(self):
            calls["clear"] += 1
            self.value = None

    class Handle:
        states = {}

        def getValueState(self, name, schema):
            return self.states.setdefault(name, Value())

        def registerTimer(self, at):
            calls["timer"] += 1
            timers.add(at)

        def deleteTimer(self, at):
            timers.remove(at)

    class Times:
        def __init__(self, mark):
            self.mark = mark

        def getCurrentWatermarkInMs(self):
            return self.mark

        getExpiryTimeInMs = getCurrentWatermarkInMs

    minute = 60_000_000
    events = [(i % 2, i * minute, i) for i in range(400)]  # a request, a minute later a notice
    wait = _Wait(45 * minute)
    wait.init(Handle())
    batch = pd.DataFrame(events, columns=["kind", "at", "id"])
    assert list(wait.handleInputRows(("a",), iter([batch[:300], batch[300:]]), Times(0))) == []
    assert sum(calls.values()) <= 6 and len(timers) == 1
    (at,) = timers
    timers.clear()
    mark = 300 * 60_000
    done = pd.concat(wait.handleExpiredTimer(("a",), Times(mark), Times(at)))
    assert sorted(done["request"]) == [i for i in range(0, 400, 2) if i + 45 <= 300] and (done["notification"] == done["request"] + 1).all()
    assert sum(calls.values()) <= 12 and len(timers) == 1 and min(timers) > mark
    timers.clear()
    done = pd.concat(wait.handleExpiredTimer(("a",), Times(10**9), Times(mark)))
    assert len(done) == sum(i + 45 > 300 for i in range(0, 400, 2)) and not timers
    assert all(s.value is None for s in Handle.states.values())


def test_sessions_end_when_idle(spark, tmp_dir):
    schema = "event_id long, user_id long, ts timestamp, provider string"

    def step(n, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_dir}/calls/{n:04d}")
        s = spark.readStream.schema(schema).parquet(f"{tmp_dir}/calls/*")
        with timer_state(spark):
            run_available_now(stream_carry_expiring(s, "user_id", "ts", ["event_id"], "30 minutes", lateness="0 minutes"),
                              f"{tmp_dir}/out", f"{tmp_dir}/ckpt", state_partitions=2)
        return {r.event_id: r.current_provider for r in spark.read.parquet(f"{tmp_dir}/out").collect()}

    got = step(1, [(1, 1, _at(0), "A"), (2, 1, _at(10), None), (3, 2, _at(5), None)])
    assert got == {1: "A", 2: "A", 3: None}
    assert step(2, [(4, 1, _at(30), None), (5, 3, _at(31), "C")])[4] == "A"  # within 30 minutes of the last call
    got = step(3, [(6, 3, _at(200), None)])
    got = step(4, [(7, 1, _at(201), None), (8, 3, _at(202), None)])
    assert got[7] is None and got[8] is None  # both sessions were idle for too long
    step(5, [(9, 9, _at(900), "Z")])
    step(6, [(10, 9, _at(901), None)])
    assert _state_rows(spark, f"{tmp_dir}/ckpt", "last") == 1  # the one that is still awake


def test_answers_in_any_order_of_arrival(spark, tmp_dir):
    from tickwise.operators.conversation import final_answers
    from tickwise.streaming.questions import stream_final_answers
    schema = "conv_id long, turn long, role string, content string, at timestamp"
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["a $1", " b ", "", "  ", None, "c"]), _at(3 * c + t))
            for c in range(4) for t in range(6)]
    first = rng.sample(rows, 12)
    second = [r for r in rows if r not in first]

    def step(n, some):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_dir}/log/{n:04d}")
        s = spark.readStream.schema(schema).parquet(f"{tmp_dir}/log/*")
        with timer_state(spark):
            run_available_now(stream_final_answers(s, "at", "30 minutes", lateness="60 minutes"), f"{tmp_dir}/out", f"{tmp_dir}/ckpt",
                              state_partitions=2)
        return {tuple(r) for r in spark.read.parquet(f"{tmp_dir}/out").collect()}

    assert step(1, first) == set()
    assert step(2, second) == set()
    got = step(3, [(99, 0, "user", "later", _at(1000))])
    want = final_answers(spark.createDataFrame(rows, schema)).select("conv_id", "question_no", "answer", "answer_turn", "n_answers")
    assert got == {tuple(r) for r in want.collect()} and got
    step(4, [(99, 1, "tool", None, _at(3000))])
    assert _state_rows(spark, f"{tmp_dir}/ckpt", "waiting") <= 1 and _state_rows(spark, f"{tmp_dir}/ckpt", "question") == 0


def test_stream_await_agrees_with_the_batch_lookup(spark):
    stream = {r.request_event_id: r.timed_out for r in QUERIES["stream_await"](spark, SF_CHECK).collect()}
    batch = {r.request_event_id: r.timed_out for r in QUERIES["match_notifications"](spark, SF_CHECK).collect()}
    assert len(stream) > 0.9 * len(batch) and all(batch[k] == v for k, v in stream.items())
