"""Registered streaming queries: run to completion with ``availableNow`` and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.requests import MAX_AWAIT_MINUTES
from ..plans import views as V
from ..plans.queries import ORACLE, _CLEAN_SQL, _content_type, query
from ..session import shared_dir
from ..sinks.snapshots import changes_between, read_index
from .carry import stream_carry_provider
from .deadlines import stream_await, stream_carry_expiring, timer_state
from .index_sync import start_index_sync
from .messages import stream_classify
from .notifications import stream_match_notifications
from .questions import stream_final_answers
from .sources import run_available_now, stream_table

@query("stream_classify", ORACLE["classify_message"])
def q_stream_classify(spark, d):
    root = shared_dir(spark, "stream_classify")
    log = stream_table(spark, d, "conversations.parquet").select(
        "conv_id", "turn", "role", F.col("text").alias("content"))
    run_available_now(stream_classify(log).select("conv_id", "turn", "role", "message_class"),
                      f"{root}/out", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/out")


def _feed(old, new, key, incoming):
    """The initial load and the changes old → new as one feed; a key's changes are ordered by ``_sequence``.

    Both arrive in one trigger, so keys with an insert and a later update or
    delete are resolved within the batch.
    """
    changes = changes_between(old, new, key)
    first = old.withColumn("_change_type", F.lit("insert")).select(*changes.columns)
    first.withColumn("_sequence", F.lit(1)).write.parquet(f"{incoming}/0001")
    changes.withColumn("_sequence", F.lit(2)).write.parquet(f"{incoming}/0002")


@query("stream_sync_index", V.with_ctes(V.PART_SQL) + " SELECT * FROM part_new")
def q_stream_sync_index(spark, d):
    root = shared_dir(spark, "stream_sync")
    incoming, index, ckpt = f"{root}/changes", f"{root}/index", f"{root}/_checkpoint"
    old, new = V.part_old(spark, d), V.part_new(spark, d)
    _feed(old, new, "p_partkey", incoming)
    stream = spark.readStream.schema(spark.read.parquet(f"{incoming}/*").schema).parquet(f"{incoming}/*")
    start_index_sync(stream, index, "p_partkey", ckpt).awaitTermination()
    return read_index(spark, index).select(*new.columns)


@query("stream_match_notifications", """
WITH req AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS identifier, ts AS submitted_at, event_id AS request_event_id
             FROM events WHERE event_type = 'signup'),
n AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS base, ts AS received_at FROM events WHERE event_type = 'purchase')
SELECT identifier, request_event_id, submitted_at,
  NOT EXISTS (SELECT 1 FROM n WHERE n.base = req.identifier AND n.received_at >= req.submitted_at
              AND n.received_at <= req.submitted_at + INTERVAL 45 MINUTE) AS timed_out
FROM req""")
def q_stream_match_notifications(spark, d):
    """T1 on a stream: every request once, matched or timed out.

    The input is the events table as a stream plus two sentinel events derived
    from it (a request and a notification 30 days after the last event, on
    identifiers no real request uses). They move the watermark past every real
    deadline, so the timed-out requests are emitted too. One row per request is
    kept inside the stream (``dropDuplicatesWithinWatermark``).
    """
    root = shared_dir(spark, "stream_match")
    events = V.read(spark, d, "events")
    sentinels = (events.agg(F.max("ts").alias("ts"))
                 .select(F.inline(F.array(
                     F.struct(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"),
                              F.lit(-1).cast("long").alias("user_id"), F.lit("signup").alias("event_type")),
                     F.struct(F.lit(-2).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"),
                              F.lit(-2).cast("long").alias("user_id"), F.lit("purchase").alias("event_type"))))))
    sentinels.write.parquet(f"{root}/sentinel")
    cols = ["event_id", "ts", "user_id", "event_type"]
    ev = stream_table(spark, d, "events.parquet").select(*cols).unionByName(
        spark.readStream.schema(sentinels.schema).parquet(f"{root}/sentinel"))
    req = ev.where(F.col("event_type") == "signup").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("identifier"),
        F.col("ts").alias("submitted_at"), F.col("event_id").alias("request_event_id"))
    notif = ev.where(F.col("event_type") == "purchase").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".json")).alias("generated_identifier"),
        F.col("ts").alias("received_at"), F.col("event_id").alias("notification_id"))
    joined = stream_match_notifications(req, notif, MAX_AWAIT_MINUTES, request_key="request_event_id").select(
        "identifier", "request_event_id", "submitted_at", F.col("notification_id").isNull().alias("timed_out"))
    run_available_now(joined, f"{root}/out", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/out").where(F.col("request_event_id") >= 0)


@query("stream_carry_provider", ORACLE["carry_provider"])
def q_stream_carry_provider(spark, d):
    from ..operators.conversation import provider_of_calls
    from ..plans import catalog as cat
    root = shared_dir(spark, "stream_carry")
    ev = stream_table(spark, d, "events.parquet")
    calls = ev.select("event_id", "user_id", "ts", cat.function_name_of(F.col("event_type")).alias("function_name"))
    attributed = provider_of_calls(calls, cat.tool_catalog(spark)).select("event_id", "user_id", "ts", "provider")
    carried = stream_carry_provider(attributed, "user_id", ["ts", "event_id"])
    run_available_now(carried.select("event_id", "user_id", "provider", "current_provider"),
                      f"{root}/out", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/out")


#: How far the watermark stays behind the newest event.
LATENESS_MINUTES = 10


@query("stream_await", f"""
WITH req AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS identifier, ts AS submitted_at, event_id AS request_event_id
             FROM events WHERE event_type = 'signup'),
n AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS base, ts AS received_at, event_id AS notification_id
      FROM events WHERE event_type = 'purchase'),
m AS (SELECT req.*, n.notification_id FROM req LEFT JOIN n
        ON n.base = req.identifier AND n.received_at >= req.submitted_at
       AND n.received_at <= req.submitted_at + INTERVAL {MAX_AWAIT_MINUTES} MINUTE
      QUALIFY row_number() OVER (PARTITION BY req.request_event_id ORDER BY n.received_at, n.notification_id) = 1)
SELECT identifier, submitted_at, request_event_id, notification_id, notification_id IS NULL AS timed_out FROM m
WHERE submitted_at + INTERVAL {MAX_AWAIT_MINUTES + LATENESS_MINUTES} MINUTE <= (
  SELECT max(ts) FROM events WHERE event_type IN ('signup', 'purchase'))""")
def q_stream_await(spark, d):
    """T1 with timers: every request whose deadline the watermark has passed, matched or timed out; the
    others are still waiting in state. No event is added to the stream."""
    root = shared_dir(spark, "stream_await")
    ev = stream_table(spark, d, "events.parquet")
    req = ev.where(F.col("event_type") == "signup").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("identifier"),
        F.col("ts").alias("submitted_at"), F.col("event_id").alias("request_event_id"))
    notif = ev.where(F.col("event_type") == "purchase").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".json")).alias("generated_identifier"),
        F.col("ts").alias("received_at"), F.col("event_id").alias("notification_id"))
    out = stream_await(req, notif, MAX_AWAIT_MINUTES, lateness=f"{LATENESS_MINUTES} minutes")
    with timer_state(spark):
        run_available_now(out, f"{root}/out", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/out").select(
        "identifier", F.col("submitted_at").cast("timestamp_ntz").alias("submitted_at"), "request_event_id",
        "notification_id", "timed_out")


@query("stream_session_provider", ORACLE["carry_provider"])
def q_stream_session_provider(spark, d):
    """W3 with expiry: as ``carry_provider`` while no session rests for longer than the events last."""
    from ..operators.conversation import provider_of_calls
    from ..plans import catalog as cat
    root = shared_dir(spark, "stream_session")
    ev = stream_table(spark, d, "events.parquet")
    calls = ev.select("event_id", "user_id", "ts", cat.function_name_of(F.col("event_type")).alias("function_name"))
    attributed = provider_of_calls(calls, cat.tool_catalog(spark)).select("event_id", "user_id", "ts", "provider")
    carried = stream_carry_expiring(attributed, "user_id", "ts", ["event_id"], idle="366 days")
    with timer_state(spark):
        run_available_now(carried.select("event_id", "user_id", "provider", "current_provider"),
                          f"{root}/out", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/out")


# A conversation begins every ten minutes and has a message a minute; it ends after half an hour of rest.
_MESSAGE_TIME_SQL = "TIMESTAMP '2024-01-01' + to_minutes(CAST(10 * conv_id + turn AS BIGINT))"
IDLE_MINUTES = 30


@query("stream_final_answers", f"""
WITH m AS (SELECT *, {_MESSAGE_TIME_SQL} AS sent FROM conversations),
mark AS (SELECT max(sent) - INTERVAL {LATENESS_MINUTES} MINUTE AS mark FROM m),
seg AS (SELECT m.*, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS question_no,
          max(sent) OVER (PARTITION BY conv_id) AS last FROM m, mark WHERE sent < mark),
a AS (SELECT conv_id, question_no, {_CLEAN_SQL} AS answer, turn, last FROM seg WHERE role = 'assistant' AND length({_CLEAN_SQL}) > 0),
q AS (SELECT conv_id, max(question_no) AS newest FROM seg GROUP BY conv_id)
SELECT conv_id, CAST(question_no AS BIGINT) AS question_no, arg_max(answer, turn) AS answer, max(turn) AS answer_turn,
  count(*) AS n_answers
FROM a JOIN q USING (conv_id), mark
WHERE question_no > 0 AND (question_no < newest OR last + INTERVAL {IDLE_MINUTES} MINUTE < mark)
GROUP BY conv_id, question_no""")
def q_stream_final_answers(spark, d):
    """A12 on a stream: the answers of all questions that the watermark shows to be over."""
    root = shared_dir(spark, "stream_answers")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(10 * F.col("conv_id") + F.col("turn")).cast("int"))
    log = stream_table(spark, d, "conversations.parquet").select(
        "conv_id", "turn", "role", F.col("text").alias("content"), at.alias("at"))
    out = stream_final_answers(log, "at", f"{IDLE_MINUTES} minutes", lateness=f"{LATENESS_MINUTES} minutes")
    with timer_state(spark):
        run_available_now(out, f"{root}/out", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/out")


@query("stream_sync_filings", V.with_ctes(V.FILINGS_SQL, V.FILINGS_SNAPSHOTS_SQL) + """
SELECT chunk_id, symbol, length(content) AS content_chars, true AS has_embedding FROM filings_new""")
def q_stream_sync_filings(spark, d):
    """T3 + F4: the filings index synced by change batches; only inserted or
    changed content is embedded (stateless hashing TF, so versions agree)."""
    from ..operators.filings import embed
    root = shared_dir(spark, "stream_sync_filings")
    incoming, index, ckpt = f"{root}/changes", f"{root}/index", f"{root}/_checkpoint"
    old, new = V.filings_old(spark, d), V.filings_new(spark, d)
    _feed(old, new, "chunk_id", incoming)

    def embed_content(df):
        return embed(df, "content", num_features=1 << 12, idf=False)

    stream = spark.readStream.schema(spark.read.parquet(f"{incoming}/*").schema).parquet(f"{incoming}/*")
    start_index_sync(stream, index, "chunk_id", ckpt, transform=embed_content).awaitTermination()
    idx = read_index(spark, index)
    return idx.select("chunk_id", "symbol", F.length("content").cast("bigint").alias("content_chars"),
                      F.col("embedding").isNotNull().alias("has_embedding"))
