"""Operators on fixtures and random data, against brute-force Python."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from tickwise.operators import conversation as conv
from tickwise.operators import requests as rq
from tickwise.operators import windows as W
from tickwise.plans import catalog as cat
from tickwise.sinks import snapshots as snap


# --------------------------------------------------------------------------- bucketed prefix helpers
def _random_log(n=600, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rng.random() < 0.5 else rng.randint(1, 6)          # one hot key with half the rows
        rows.append((key, i, rng.randint(0, 3), rng.choice([None, None, "a", "b", "c"])))
    return rows


def test_prefix_sum_matches_pandas(spark):
    rows = _random_log()
    df = spark.createDataFrame(rows, "k int, o int, v int, p string")
    for inclusive in (True, False):
        got = W.prefix_sum(df, "k", "o", "v", F.floor(F.col("o") / 37), "s", inclusive=inclusive)
        got = {(r["k"], r["o"]): r["s"] for r in got.collect()}
        pdf = pd.DataFrame(rows, columns=["k", "o", "v", "p"]).sort_values(["k", "o"])
        pdf["s"] = pdf.groupby("k")["v"].cumsum() - (0 if inclusive else pdf["v"])
        assert got == {(r.k, r.o): r.s for r in pdf.itertuples()}


def test_carry_forward_matches_fold(spark):
    rows = _random_log()
    df = spark.createDataFrame(rows, "k int, o int, v int, p string")
    got = W.carry_forward(df, "k", "o", "p", F.floor(F.col("o") / 23), "c")
    got = {(r["k"], r["o"]): r["c"] for r in got.collect()}
    expected, last = {}, {}
    for k, o, _, p in sorted(rows, key=lambda r: (r[0], r[1])):
        if p is not None:
            last[k] = p
        expected[(k, o)] = last.get(k)
    assert got == expected


def test_dense_rank_matches_sql(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1.0, 2.0, 2.0, 3.5, 7.0, float(rng.randint(0, 50))])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v double")
    got = {r["id"]: r["rk"] for r in W.dense_rank_desc(df, "v", "rk", partitions=5).collect()}
    distinct = sorted({v for _, v in rows if v is not None}, reverse=True)
    rank = {v: i + 1 for i, v in enumerate(distinct)}
    assert got == {i: (rank[v] if v is not None else None) for i, v in rows}


def test_latest_per_key_and_top_k(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("a", 2, "w")],
                               "k string, o int, v string")
    got = {r["k"]: (r["o"], r["v"]) for r in W.latest_per_key(df, "k", "o").collect()}
    assert got == {"a": (3, "y"), "b": (2, "z")}
    top = W.top_k_per_group(df, "k", [F.col("o").desc()], 2).collect()
    assert sorted((r["k"], r["o"]) for r in top) == [("a", 2), ("a", 3), ("b", 2)]


# --------------------------------------------------------------------------- notification matching
def test_match_notifications_matches_brute_force(spark):
    rng = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    reqs, notes = [], []
    for i in range(150):
        ident = f"r{rng.randint(0, 4)}"                                  # few identifiers: hot keys
        reqs.append((ident, t0 + dt.timedelta(minutes=rng.randint(0, 600)), i))
    for j in range(200):
        ident = f"r{rng.randint(0, 5)}"
        notes.append((f"{ident}.json", t0 + dt.timedelta(minutes=rng.randint(0, 700)), 1000 + j))
    # exact boundary: 45 minutes after a request still matches
    reqs.append(("edge", t0, 500))
    notes.append(("edge.json", t0 + dt.timedelta(minutes=45), 5000))
    reqs.append(("late", t0, 501))
    notes.append(("late.json", t0 + dt.timedelta(minutes=45, microseconds=1), 5001))
    r = spark.createDataFrame(reqs, "identifier string, submitted_at timestamp_ntz, rid int")
    n = spark.createDataFrame(notes, "generated_identifier string, received_at timestamp_ntz, notification_id long")
    got = {row["rid"]: (row["match"]["notification_id"] if row["match"] else None)
           for row in rq.match_notifications(r, n).collect()}
    expected = {}
    for ident, ts, rid in reqs:
        cands = [(nts, nid) for g, nts, nid in notes
                 if g.split(".")[0] == ident and ts <= nts <= ts + dt.timedelta(minutes=45)]
        expected[rid] = min(cands)[1] if cands else None
    assert got == expected
    assert got[500] == 5000 and got[501] is None


def test_validate_requests(spark):
    df = spark.createDataFrame([("r20240201120000abcdef", "DataRequest"), ("r20240201120000abcdefg", "X"),
                                (None, "X"), ("r1", None)], "identifier string, type string")
    got = [(r["is_valid"], len(r["errors"])) for r in rq.validate_requests(df).collect()]
    assert got == [(True, 0), (False, 1), (False, 1), (False, 1)]


def test_last_month(spark):
    s, e = rq.last_month(F.lit("2024-03-31"))
    r = spark.range(1).select(s.cast("string"), e.cast("string")).first()
    assert tuple(r) == ("2024-02-01", "2024-03-01")
    assert rq.last_month_bounds(dt.date(2024, 1, 15)) == (dt.date(2023, 12, 1), dt.date(2024, 1, 1))


# --------------------------------------------------------------------------- message log (FIXTURES §10)
DOCS1 = '[{"page_content":"t","metadata":{"chunk_id":"c1","document_name":"a/x.pdf"}}]'
DOCS2 = ('[{"page_content":"t","metadata":{"chunk_id":"c1"}},{"page_content":"u","metadata":{"chunk_id":"c2"}},'
         '{"page_content":"v","metadata":{"other":"no chunk"}}]')
LOG = [
    (1, 0, "system", "be careful", None),
    (1, 1, "user", "exposure to Italy?", None),
    (1, 2, "assistant", "looking up", ["catalog__schema__get_portfolio_data"]),
    (1, 3, "tool", DOCS1, None),
    (1, 4, "assistant", "searching", ["catalog__schema__filings_index"]),
    (1, 5, "tool", DOCS2, None),
    (1, 6, "tool", "not a document list", None),
    (1, 7, "assistant", "", ["catalog__schema__unknown"]),
    (1, 8, "assistant", "It costs $5 ", None),
    (1, 9, "user", "next question", None),
]


def _log(spark):
    schema = "conv_id long, turn long, role string, content string, fn array<string>"
    df = spark.createDataFrame(LOG, schema)
    return df.withColumn("tool_calls", F.transform("fn", lambda f: F.struct(f.alias("name"),
                                                                            F.lit("{}").alias("arguments"))))


def test_classify_and_answers(spark):
    log = _log(spark)
    classes = [r["message_class"] for r in conv.classify_message(log).orderBy("turn").collect()]
    assert classes == ["other", "user", "tool_call", "tool_result", "tool_call", "tool_result", "tool_result",
                       "empty", "answer", "user"]
    seg = {r["turn"]: r["question_no"] for r in conv.segment_questions(log).collect()}
    assert seg[0] == 0 and seg[8] == 1 and seg[9] == 2
    ans = conv.final_answers(log).collect()
    assert [(r["question_no"], r["answer"]) for r in ans] == [(1, "It costs \\$5")]
    ctx = {r["turn"]: (r["context_messages"], r["context_chars"]) for r in conv.conversation_context(log).collect()}
    assert ctx[1] == (0, 0)
    assert ctx[9][0] == 5                                   # 1 user + 4 assistant messages before turn 9


def test_provider_attribution_and_supporting_documents(spark):
    log = _log(spark)
    calls = log.withColumn("function_name", F.element_at(F.col("fn"), 1))
    attributed = conv.provider_of_calls(calls, cat.tool_catalog(spark))
    carried = conv.carry_provider(attributed, "conv_id", "turn", "provider", F.floor(F.col("turn") / 4),
                                  "current_provider")
    by_turn = {r["turn"]: r for r in carried.collect()}
    assert by_turn[2]["provider"] == "Portfolio"
    assert by_turn[4]["provider"] == "Filings"              # first provider in catalog order wins
    assert by_turn[7]["provider"] is None and by_turn[7]["current_provider"] == "Filings"
    seg = conv.segment_questions(carried)
    tools = seg.where(F.col("role") == "tool")
    docs = conv.retrieved_documents(tools).withColumn("seq", F.struct("turn", "doc_pos"))
    sd = conv.supporting_documents(docs, ["conv_id", "question_no"], "chunk_id", "seq", "current_provider")
    got = sorted((r["chunk_id"], r["n_references"], r["provider"], r["reference_label"]) for r in sd.collect())
    assert got == [("c1", 2, "Filings", "2 reference(s)"), ("c2", 1, "Filings", "1 reference(s)")]
    order = [r["chunk_id"] for r in sd.orderBy("first_seen").collect()]
    assert order == ["c1", "c2"]


def test_active_tools_and_summary(spark):
    tools = cat.tool_catalog(spark)
    sel = spark.createDataFrame([("filings_search", True), ("news_search", True), ("portfolio_holdings", False)],
                                "tool_id string, selected boolean")
    assert sorted(r["tool_id"] for r in conv.active_tools(tools, sel).collect()) == ["filings_search"]
    s = {r["tool_type"]: r["n_tools"] for r in conv.tool_summary(tools).collect()}
    assert s == {"vector": 3, "genie": 1, "function": 1}


# --------------------------------------------------------------------------- snapshots
def test_upsert_of_changes_is_new_and_sync_is_idempotent(spark, tmp_dir):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c"), (5, "e")], "k int, v string")
    ch = snap.changes_between(old, new, "k")
    kinds = {r["k"]: r["_change_type"] for r in ch.collect()}
    assert kinds == {2: "update_postimage", 3: "update_postimage", 4: "delete", 5: "insert"}
    up = snap.apply_changes(old, ch, "k")
    assert sorted(map(tuple, up.collect())) == sorted(map(tuple, new.collect()))
    root = f"{tmp_dir}/index"
    first = old.withColumn("_change_type", F.lit("insert"))
    assert snap.sync_index(spark, first, root, "k", batch=("feed", 0)) == 1
    assert snap.sync_index(spark, ch, root, "k", batch=("feed", 1)) == 2
    assert snap.sync_index(spark, ch, root, "k", batch=("feed", 1)) == 2        # replayed batch: no-op
    assert snap.committed_versions(spark, root) == [1, 2]
    latest = snap.read_index(spark, root)
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, new.collect()))


def test_sync_transforms_only_changed_rows(spark, tmp_dir):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "k int, v string")
    root = f"{tmp_dir}/emb_index"
    tag = {"value": "v1"}

    def transform(df):
        return df.withColumn("embedded_in", F.lit(tag["value"]))

    snap.sync_index(spark, old.withColumn("_change_type", F.lit("insert")), root, "k", transform=transform)
    tag["value"] = "v2"
    snap.sync_index(spark, snap.changes_between(old, new, "k"), root, "k", transform=transform)
    got = {r["k"]: (r["v"], r["embedded_in"]) for r in snap.read_index(spark, root).collect()}
    assert got == {1: ("a", "v1"), 2: ("B", "v2"), 4: ("d", "v2")}


def test_changes_of_one_key_in_a_batch_are_resolved_by_sequence(spark, tmp_dir):
    root = f"{tmp_dir}/seq_index"
    feed = spark.createDataFrame(
        [(1, "a", "insert", 1), (2, "b", "insert", 1), (1, "A2", "update_postimage", 2), (2, None, "delete", 2),
         (None, "n", "insert", 1), (None, "N", "update_postimage", 3)], "k int, v string, _change_type string, _sequence int")
    snap.sync_index(spark, feed, root, "k", batch=("one", 0))
    assert sorted(map(tuple, snap.read_index(spark, root).collect()), key=str) == [(1, "A2"), (None, "N")]
    # a new feed on the old index starts its own batch numbers
    more = spark.createDataFrame([(9, "z", "insert", 1), (1, None, "delete", 1)], feed.schema)
    snap.sync_index(spark, more, root, "k", batch=("two", 0))
    assert sorted(map(tuple, snap.read_index(spark, root).collect()), key=str) == [(9, "z"), (None, "N")]


def test_sync_rewrites_only_touched_buckets(spark, tmp_dir):
    import os
    root = f"{tmp_dir}/bucket_index"
    rows = spark.range(2000).select(F.col("id").alias("k"), F.lit("x").alias("v"), F.lit("insert").alias("_change_type"))
    snap.sync_index(spark, rows, root, "k")
    one = spark.createDataFrame([(7, "y", "update_postimage")], "k long, v string, _change_type string")
    snap.sync_index(spark, one, root, "k")
    assert len([x for x in os.listdir(f"{root}/version=2") if x.startswith("_bucket=")]) == 1
    got = {r.k: r.v for r in snap.read_index(spark, root).collect()}
    assert len(got) == 2000 and got[7] == "y" and got[8] == "x"


def test_phrases_and_alias_tables(spark):
    from tickwise.operators import filings as fl
    chunks = spark.createDataFrame([(1, "C1-US", "New anti-PD-1 Therapy by Acme Holdings, Inc. and acme"), (2, "C2-US", "therapy"),
                                    (3, "C3-US", None), (4, "C4-US", "")], "chunk_id int, symbol string, content string")
    h = spark.createDataFrame([("C1-US",), ("C2-US",)], "ticker string")
    assert [r.ticker for r in fl.theme_exposure(h, chunks, ["anti-PD-1 therapy"]).collect()] == ["C1-US"]
    names = spark.createDataFrame([("Acme Holdings Inc", "A"), ("Acme", "B"), ("", "C")], "name string, ticker string")
    got = {(r.chunk_id, r.ticker): r.n_mentions for r in fl.link_mentions(chunks, names).collect()}
    assert got == {(1, "A"): 1, (1, "B"): 2}


def test_null_keys_in_ordered_helpers(spark):
    from tickwise.operators.windows import carry_forward, prefix_sum
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, None), ("x", 1, None)], "k string, t int, p string")
    got = {(r.k, r.t): r.s for r in prefix_sum(df, "k", "t", F.lit(1), F.col("t"), "s").collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("x", 1): 1}
    got = {(r.k, r.t): r.c for r in carry_forward(df, "k", "t", "p", F.col("t"), "c").collect()}
    assert got == {(None, 1): "a", (None, 2): "a", ("x", 1): None}


def test_snapshot_times_follow_their_zone(spark):
    from tickwise.sources import schemas as S
    text = {"UTC": "12:00:00", "America/New_York": "17:00:00", None: "12:00:00"}
    stamp, schema = "2024-01-15T12:00:00", S.data_request([])
    raw = spark.createDataFrame([(stamp, z) for z in text], "DL_SNAPSHOT_START_TIME string, DL_SNAPSHOT_TZ string")
    got = S.conform(raw, schema).select("DL_SNAPSHOT_TZ", F.date_format("DL_SNAPSHOT_START_TIME", "HH:mm:ss")).collect()
    assert {r[0]: r[1] for r in got} == text
