"""Data requests and their responses.

A vendor request is universe × field list × date range. Executed against
landed tables it is a left-semi join on the universe, a projection of the
fields and a range filter on the date – all pushed to the scan by Catalyst.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import (REQUEST_ID_MAX_LEN, base_identifier, digest_algorithm, digest_value,
                              media_type, minutes_between, response_url)

# ---------------------------------------------------------------------------
# The wait limit and the refusal messages of a request.
# ---------------------------------------------------------------------------
MAX_AWAIT_MINUTES = 45
ERR_NO_IDENTIFIER = "Request identifier must be specified"
ERR_NO_TYPE = "Request type not specified"
ERR_IDENTIFIER_LENGTH = "Identifier must be between 1 and 21 characters long"


def last_month(as_of) -> tuple[Column, Column]:
    """P7 – (first day of previous month, first day of this month) of ``as_of``."""
    d = F.lit(as_of) if isinstance(as_of, (str, _dt.date)) else as_of
    d = F.to_date(d)
    first = F.trunc(d, "MM")
    return F.add_months(first, -1), first


def last_month_bounds(as_of: _dt.date) -> tuple[_dt.date, _dt.date]:
    """P7 on the driver, for a literal range (so it is pushed to the scan as constants)."""
    first = as_of.replace(day=1)
    prev = (first - _dt.timedelta(days=1)).replace(day=1)
    return prev, first


def data_request(df: DataFrame, universe: DataFrame | None, fields: list[str], key: str = "TICKER",
                 date_col: str | None = None, start=None, end=None, end_inclusive: bool = True) -> DataFrame:
    """P4-P6/J2 – rows of the universe, requested fields only, within the date range."""
    out = df
    if date_col is not None:
        # ISO ``yyyy-MM-dd`` text sorts like the date, so a string column is
        # compared as text: the bounds stay literals on the bare column and
        # are pushed to the Parquet scan (a cast on the column would not be).
        is_text = isinstance(df.schema[date_col].dataType, T.StringType)
        d = F.col(date_col)

        def bound(x):
            return F.lit(x.isoformat() if is_text else x) if isinstance(x, _dt.date) else F.lit(x)
        if start is not None:
            out = out.where(d >= bound(start))
        if end is not None:
            out = out.where(d <= bound(end) if end_inclusive else d < bound(end))
    if universe is not None:
        members = universe.select(F.col(universe.columns[0]).alias(key)).distinct()
        out = out.join(members, key, "left_semi")
    keep = [key] + ([date_col] if date_col and date_col not in fields else []) + list(fields)
    return out.select(*keep)


def validate_requests(requests: DataFrame, identifier: str = "identifier", rtype: str = "type") -> DataFrame:
    """P10 – reasons a request would be refused, as ``errors`` (empty when valid)."""
    checks = F.array(
        F.when(F.col(identifier).isNull(), F.lit(ERR_NO_IDENTIFIER)),
        F.when(F.col(rtype).isNull(), F.lit(ERR_NO_TYPE)),
        F.when(F.length(F.col(identifier)) > REQUEST_ID_MAX_LEN,
               F.lit(ERR_IDENTIFIER_LENGTH)),
    )
    errors = F.filter(checks, lambda x: x.isNotNull())
    return requests.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def response_status(requests: DataFrame, manifest: DataFrame, host: str, catalog: str,
                    identifier: str = "identifier") -> DataFrame:
    """P9/T2/O5 – first listed response of every request, or NULLs while pending.

    ``manifest`` rows: key, DL_REQUEST_ID, digest, content_type and a sortable
    position column ``pos`` (listing order). Batch over all requests: one left
    join and one partial aggregate per request.
    """
    m = manifest.select(
        F.col("DL_REQUEST_ID").alias(identifier),
        F.struct(
            F.col("pos"),
            F.col("key"),
            F.col("content_type"),
            media_type("content_type").alias("media_type"),
            digest_algorithm("digest").alias("digest_algorithm"),
            digest_value("digest").alias("digest"),
            response_url(F.lit(host), F.lit(catalog), F.col("key")).alias("download_url"),
        ).alias("r"))
    firsts = m.groupBy(identifier).agg(F.min_by("r", F.col("r.pos")).alias("r"))
    reqs = requests.select(identifier).distinct()
    return (reqs.join(firsts, identifier, "left")
            .select(identifier, "r.key", "r.content_type", "r.media_type", "r.digest_algorithm", "r.digest",
                    "r.download_url", F.col("r").isNotNull().alias("is_ready")))


def match_notifications(requests: DataFrame, notifications: DataFrame, minutes: int = MAX_AWAIT_MINUTES,
                        identifier: str = "identifier", submitted: str = "submitted_at",
                        received: str = "received_at", notif_id: str = "notification_id") -> DataFrame:
    """J5 – first notification for the same base identifier within ``minutes`` of the request.

    Planned as an as-of lookup rather than a range join: time is cut into
    buckets of ``minutes``; each notification is copied into its own bucket and
    the one before, so every request finds all its candidates inside its own
    (identifier, bucket) group. Within a group, requests and notifications are
    ordered by time and each request takes the first notification at or after
    it. No request × notification pairs are formed, and a busy identifier is
    spread over its time buckets.

    ``notifications`` columns: generated_identifier, received, notif_id, plus
    any payload columns (kept in ``match``).
    """
    width = minutes * 60 * 1_000_000
    n = notifications.withColumn("_base", base_identifier("generated_identifier"))
    payload_cols = [c for c in notifications.columns if c not in ("generated_identifier",)]
    n_ts = F.unix_micros(F.col(received).cast("timestamp"))
    nb = F.floor(n_ts / F.lit(width))
    notif_rows = (n.select(F.col("_base").alias("_id"), F.col(received).alias("_ts"), F.lit(1).alias("_kind"),
                           F.col(notif_id).alias("_nid"), F.struct(*payload_cols).alias("_match"),
                           F.explode(F.array(nb, nb - 1)).alias("_bucket")))
    r_ts = F.unix_micros(F.col(submitted).cast("timestamp"))
    req_rows = requests.select(
        F.col(identifier).alias("_id"), F.col(submitted).alias("_ts"), F.lit(0).alias("_kind"),
        F.lit(None).cast("long").alias("_nid"),
        F.lit(None).cast(notif_rows.schema["_match"].dataType).alias("_match"),
        F.floor(r_ts / F.lit(width)).alias("_bucket"),
        F.struct(*[F.col(c) for c in requests.columns]).alias("_req"))
    notif_rows = notif_rows.withColumn("_req", F.lit(None).cast(req_rows.schema["_req"].dataType))
    both = req_rows.unionByName(notif_rows)
    w = (Window.partitionBy("_id", "_bucket").orderBy("_ts", "_kind", "_nid")
         .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    nxt = both.withColumn("_next", F.first("_match", ignorenulls=True).over(w)).where(F.col("_kind") == 0)
    wait = minutes_between(F.col("_req").getField(submitted), F.col("_next").getField(received))
    in_time = wait <= F.lit(float(minutes))
    return nxt.select(
        "_req.*",
        F.when(in_time, F.col("_next")).alias("match"),
        F.when(in_time, wait).alias("minutes_waited"),
        (~F.coalesce(in_time, F.lit(False))).alias("timed_out"))
