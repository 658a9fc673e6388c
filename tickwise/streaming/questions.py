"""W4 and A12 on a stream: messages are put in order, numbered by question, and a question's final answer is emitted when
the next question comes or the conversation rests.

A conversation's messages are held until the watermark has passed them, so that late ones still find their place; then
they are taken in order of their turn. What is kept of a question is its number and its last answer, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


class _Questions(StatefulProcessor):
    """Messages of one conversation that the watermark has not passed, and the question that is open."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "turn long, at long, n long", "role string, answer string")
        self.question = handle.getValueState("question", "no long, answer string, turn long, answers long, last long")

    def handleInputRows(self, key, rows, timerValues):
        timers = set()
        for pdf in rows:
            for turn, at, role, answer in zip(*(pdf[c].tolist() for c in ("turn", "at_micros", "role", "answer"))):
                n = 0
                while self.waiting.containsKey((turn, at, n)):  # repeated messages count each
                    n += 1
                self.waiting.updateValue((turn, at, n), (role, answer))
                timers.add(at + 1000)
        for at in {-(-t // 1000) for t in timers}:
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(((k, v) for k, v in self.waiting.iterator()), key=lambda m: m[0])
        no, answer, turn, answers, last = self.question.get() if self.question.exists() else (0, None, None, 0, 0)
        out = []

        def close():
            if no > 0 and answers:
                out.append((key[0], no, answer, turn, answers))

        for k, (role, text) in held:
            if k[1] >= mark:
                continue
            if last and k[1] > last + self.idle:  # it had rested for long enough before this message
                close()
                answer, turn, answers = None, None, 0
            if role == "user":
                close()
                no, answer, turn, answers = no + 1, None, None, 0
            elif isinstance(text, str) and text:
                answer, turn, answers = text, k[0], answers + 1
            last = max(last, k[1])
            self.waiting.removeKey(tuple(k))
        if last and mark > last + self.idle:
            close()
            self.question.clear()
        elif last:
            self.question.update((no, answer, turn, answers, last))
            self.handle.registerTimer(-(-(last + self.idle + 1000) // 1000))
        if out:
            yield pd.DataFrame(out, columns=["conv", "question_no", "answer", "answer_turn", "n_answers"])

    def close(self) -> None:
        pass


def stream_final_answers(messages: DataFrame, time: str, idle: str, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         content: str = "content", lateness: str = "10 minutes") -> DataFrame:
    """A12 – ``conv, question_no, answer, answer_turn, n_answers`` as the batch form gives them, for any order of arrival.

    Conversations and turns are longs, and a later turn does not have an earlier ``time``. A conversation that rests for longer
    than ``idle`` ends and leaves no state: a message after that starts anew with question one. Messages later than
    ``lateness`` are dropped. Start the stream inside ``timer_state``.
    """
    from ..functions.text import clean_text
    from ..operators.conversation import classify_message
    spark = messages.sparkSession
    micros = spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL '{idle}')").first()[0]
    at = F.col(time).cast("timestamp")
    rows = classify_message(messages, role, content).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), at.alias("at_time"),
        F.unix_micros(at).alias("at_micros"), F.col(role).alias("role"),
        F.when(F.col("message_class") == "answer", clean_text(content)).alias("answer"))
    found = rows.withWatermark("at_time", lateness).groupBy("conv").transformWithStateInPandas(
        _Questions(micros), "conv long, question_no long, answer string, answer_turn long, n_answers long", "Append", "EventTime")
    return found.withColumnRenamed("conv", conv)
