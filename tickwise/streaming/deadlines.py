"""T1 and W3 with event-time timers: a wait that ends by its deadline, session state that expires.

Both run on ``transformWithState`` (RocksDB state). A timer fires as soon as the watermark passes it, on whatever
events move the watermark; no event of the waiting identifier is needed. When its last timer has fired, a key
holds no state.
"""

from __future__ import annotations

import bisect
import contextlib
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.text import base_identifier
from ..operators.requests import MAX_AWAIT_MINUTES

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def timer_state(spark: SparkSession):
    """Streams started inside use the state store that timers need; the session's own setting comes back after it."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if old is None else spark.conf.set(_PROVIDER, old)


def _pairs(packed: bytes) -> list[tuple[int, int]]:
    return list(struct.iter_unpack("<2q", packed))


class _Wait(StatefulProcessor):
    """Requests and notifications of one identifier. Times are microseconds; timers are rounded up to milliseconds.

    A call to the state store costs far more than a pair held in memory, so an identifier has one value for its requests,
    one for its notices and one timer, whatever the number of its events.
    """

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle) -> None:
        self.handle = handle
        # pairs of longs as bytes: (id, at) of requests, (at, id) of notices; with each the one timer of the key
        self.requests = handle.getValueState("requests", "pairs binary, timer long")
        self.notices = handle.getValueState("notices", "pairs binary, timer long")

    def _load(self):
        requests, notices = self.requests.get(), self.notices.get()
        timer = next((s[1] for s in (requests, notices) if s is not None), None)
        return *(_pairs(s[0]) if s is not None else [] for s in (requests, notices)), timer

    def _store(self, requests, notices, had, timer, old) -> None:
        """State of a key, and its timer ``timer`` instead of ``old``; ``had``: which of the two states are there."""
        for state, pairs, there in zip((self.requests, self.notices), (requests, notices), had):
            if pairs:
                state.update((struct.pack(f"<{2 * len(pairs)}q", *(v for p in pairs for v in p)), timer))
            elif there:
                state.clear()
        if timer != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if timer is not None:
                self.handle.registerTimer(timer)

    def _next(self, requests, notices, mark):
        """The first time at which a request ends or a notice can be forgotten. One before ``mark`` waits for requests only."""
        times = [at + self.wait for _, at in requests] + [t + 1000 for t, _ in notices if t >= mark]
        return -(-min(times) // 1000) if times else None

    def handleInputRows(self, key, rows, timerValues):
        old_requests, old_notices, old = self._load()
        requests, notices = dict(old_requests), set(old_notices)
        for pdf in rows:
            for kind, at, ident in zip(pdf["kind"].tolist(), pdf["at"].tolist(), pdf["id"].tolist()):
                if kind == 0:
                    requests[ident] = at
                else:
                    notices.add((at, ident))
        requests = list(requests.items())
        times = [self._next(requests, notices, timerValues.getCurrentWatermarkInMs() * 1000), old]
        self._store(requests, list(notices), (bool(old_requests), bool(old_notices)), min((t for t in times if t is not None), default=None), old)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd
        # all that the watermark has passed ends now: a key needs no further timer for it
        mark = timerValues.getCurrentWatermarkInMs()
        now = max(mark, expiredTimerInfo.getExpiryTimeInMs()) * 1000
        requests, notices, _ = self._load()
        had = (bool(requests), bool(notices))
        notices.sort()
        times = [t for t, _ in notices]
        out = []
        for r, at in requests:
            if at + self.wait <= now:
                i = bisect.bisect_left(times, at)
                found = notices[i] if i < len(notices) and times[i] <= at + self.wait else (None, None)
                out.append((key[0], r, at, found[1], found[0]))
        requests = [(r, at) for r, at in requests if at + self.wait > now]
        # later requests are not before the watermark, so older notices serve those that wait, or nobody
        first = min([mark * 1000, *(at for _, at in requests)])
        notices = [n for n in notices if n[0] >= first]
        # (the timer that fired is gone)
        self._store(requests, notices, had, self._next(requests, notices, mark * 1000), None)
        if out:
            names = ["identifier", "request", "submitted", "notification", "received"]
            yield pd.DataFrame(out, columns=names).astype({"notification": "Int64", "received": "Int64"})

    def close(self) -> None:
        pass


def stream_await(requests: DataFrame, notifications: DataFrame, minutes: int = MAX_AWAIT_MINUTES,
                 identifier: str = "identifier", submitted: str = "submitted_at", request_key: str = "request_event_id",
                 received: str = "received_at", notif_id: str = "notification_id", lateness: str = "10 minutes") -> DataFrame:
    """T1 – each request once, when its deadline has passed: ``identifier, request_key, submitted, notif_id, received,
    timed_out`` with the first notification within ``minutes``, as the batch lookup finds it in any order of arrival.

    Request and notification keys are longs, unique per identifier; an event later than ``lateness`` is dropped.
    Start the stream inside ``timer_state``.
    """
    def side(df, kind, ident, at, key):
        at = F.col(at).cast("timestamp")
        return df.select(ident.alias("identifier"), F.lit(kind).alias("kind"), at.alias("_event_time"),
                         F.unix_micros(at).alias("at"), F.col(key).cast("long").alias("id"))

    events = side(requests, 0, F.col(identifier), submitted, request_key).unionByName(
        side(notifications, 1, base_identifier("generated_identifier"), received, notif_id))
    found = events.withWatermark("_event_time", lateness).groupBy("identifier").transformWithStateInPandas(
        _Wait(minutes * 60_000_000), "identifier string, request long, submitted long, notification long, received long",
        "Append", "EventTime")
    return found.select(
        F.col("identifier").alias(identifier), F.col("request").alias(request_key),
        F.timestamp_micros("submitted").alias(submitted), F.col("notification").alias(notif_id),
        F.timestamp_micros("received").alias(received), F.col("notification").isNull().alias("timed_out"))


class _Carry(StatefulProcessor):
    """The last value of one session in event order, until the session has been idle for too long."""

    def __init__(self, fields: list[str], order: list[str], value: str, out: str, idle: int):
        self.fields, self.order, self.value, self.out, self.idle = fields, order, value, out, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, value string")
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["at_micros", *self.order], kind="stable")
        before = self.last.get() if self.last.exists() else None
        old = until = self.until.get()[0] if self.until.exists() else None
        carried, now, since = [], None, None
        for at, value in zip(batch["at_micros"].tolist(), batch[self.value].tolist()):
            if before is not None and at >= before[0]:  # from here on the stored value is the last one
                (since, now), before = before, None
            if until is not None and at > until:  # idle for too long, whether the timer came first or not
                since = now = None
            until = at + self.idle if until is None else max(until, at + self.idle)
            if isinstance(value, str):
                since, now = at, value
            carried.append(now)
        if before is None and now is not None:
            self.last.update((since, now))
        elif before is None:
            self.last.clear()
        if old != until:
            if old is not None:
                self.handle.deleteTimer(-(-old // 1000))
            self.handle.registerTimer(-(-until // 1000))
            self.until.update((until,))
        yield batch.assign(**{self.out: carried})[[*self.fields, self.out]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        self.until.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_carry_expiring(calls: DataFrame, key: str, time: str, order: list[str], idle: str, provider: str = "provider",
                          out: str = "current_provider", lateness: str = "10 minutes") -> DataFrame:
    """W3 – the provider carried forward per session, forgotten once the watermark is ``idle`` past its last call.

    ``order`` breaks ties of ``time``. A row later than ``lateness`` is dropped; one that is late but not dropped and
    has no provider at or before it in its batch gets none if it lies before the stored one (older ones are not kept). Start
    the stream inside ``timer_state``.
    """
    spark = calls.sparkSession
    micros = spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL '{idle}')").first()[0]
    fields = calls.columns
    kinds = {f.name: f.dataType.simpleString() for f in calls.schema.fields}
    at = F.col(time).cast("timestamp")
    # (names with a leading underscore do not reach the processor)
    events = calls.withColumn("at_time", at).withColumn("at_micros", F.unix_micros(at)).withWatermark("at_time", lateness)
    return events.groupBy(key).transformWithStateInPandas(
        _Carry(fields, order, provider, out, micros), ", ".join(f"`{c}` {kinds[c]}" for c in fields) + f", `{out}` string",
        "Append", "EventTime")
