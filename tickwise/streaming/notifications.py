"""T1 – wait for the completion notification of each request, with a deadline.

Stream-stream left outer join: requests and notifications both carry a
watermark, the join is bounded to ``[submitted, submitted + minutes]`` so
state is dropped once the watermark passes the deadline, and a request whose
deadline passed unmatched is emitted with NULL notification columns (timed out).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_identifier
from ..operators.requests import MAX_AWAIT_MINUTES


def stream_match_notifications(requests: DataFrame, notifications: DataFrame, minutes: int = MAX_AWAIT_MINUTES,
                               identifier: str = "identifier", submitted: str = "submitted_at",
                               received: str = "received_at", lateness: str = "10 minutes",
                               request_key: str | None = None) -> DataFrame:
    """Requests left-outer-joined to their notifications within the deadline.

    With ``request_key``, one row per request is kept: the first one to
    arrive (``dropDuplicatesWithinWatermark``), as a waiting client would.
    """
    # Event-time columns must be TIMESTAMP (with zone) for watermarks.
    r = (requests.withColumn("_submitted", F.col(submitted).cast("timestamp"))
         .withWatermark("_submitted", lateness))
    n = (notifications.withColumn("_received", F.col(received).cast("timestamp"))
         .withColumn("_base", base_identifier("generated_identifier"))
         .withWatermark("_received", lateness))
    cond = ((n["_base"] == r[identifier]) & (n["_received"] >= r["_submitted"])
            & (n["_received"] <= r["_submitted"] + F.expr(f"INTERVAL {minutes} MINUTES")))
    joined = r.join(n, cond, "leftOuter")
    if request_key is None:
        return joined
    # keep a single event-time column (the request's) for the de-duplication state
    return joined.drop("_received").dropDuplicatesWithinWatermark([request_key])
