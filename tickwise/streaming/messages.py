"""T4 – messages classified as they arrive (stateless, valid on a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.conversation import classify_message


def stream_classify(log_stream: DataFrame, role: str = "role", content: str = "content") -> DataFrame:
    return classify_message(log_stream, role, content)
