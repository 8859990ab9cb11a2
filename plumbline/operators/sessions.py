"""Calls of recorded sessions in the order of their numbers: what is settled may be written, what is open holds back the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Events of a tape: a call, its answer, a call that its transport gave up, and the end of a session (idx: its last call).
EVENTS = "tape string, kind string, idx long, at timestamp, tool string, req string, resp string, status string, reason string"
RELEASED = "tape string, idx long, tool string, req string, resp string, status string, reason string"
CALL, ANSWER, CLOSE, END = "call", "answer", "close", "end"
INVALID, UNANSWERED, NO_RESPONSE = "invalid_id", "unanswered", "no_response"


def committed(events: DataFrame) -> DataFrame:
    """The rows (RELEASED) that a recorder may have written, of the events (EVENTS) of its tapes.

    Calls are written by number, and a call once it is settled: answered,
    closed as unanswered for a reason, or called under an id that no answer can
    name (status `invalid_id`). A call not settled, or a number without a call,
    holds back all later ones until a session ends at its number or beyond;
    then what is open is written as unanswered and numbers without calls are
    left as gaps. An answer wins over a close; of repeated calls, answers and
    closes the first by time stays. Answers without a call are ignored, and so
    are events without a tape, number or known kind.

    No tape is gathered: the first number that holds back is found by an
    anti-join of each settled number's successor with the settled ones.
    """
    known = events.where(F.col("tape").isNotNull() & F.col("idx").isNotNull())

    def first(kind: str, *columns: str) -> DataFrame:
        value = F.min(F.struct(F.col("at").isNull(), "at", *columns))
        return known.where(F.col("kind") == kind).groupBy("tape", "idx").agg(value.alias(kind))

    calls = first(CALL, "tool", "req", "status")
    met = calls.join(first(ANSWER, "resp", "status"), ["tape", "idx"], "left").join(first(CLOSE, "reason"), ["tape", "idx"], "left")
    invalid = F.coalesce(F.col("call.status") == INVALID, F.lit(False))
    answered = F.col(ANSWER).isNotNull() & ~invalid
    given_up = F.col(CLOSE).isNotNull() & ~invalid & ~answered
    settled = invalid | answered | given_up
    rows = met.select(
        "tape",
        "idx",
        F.col("call.tool").alias("tool"),
        F.col("call.req").alias("req"),
        F.when(answered, F.col("answer.resp")).alias("resp"),
        F.when(invalid, INVALID).when(answered, F.col("answer.status")).otherwise(UNANSWERED).alias("status"),
        F.when(given_up, F.col("close.reason")).when(~settled, NO_RESPONSE).alias("reason"),
        settled.alias("settled"),
    )
    ends = known.where(F.col("kind") == END).groupBy("tape").agg(F.max("idx").alias("ended"))
    placed = rows.join(ends, "tape", "left").withColumn("ended", F.coalesce("ended", F.lit(0)))
    done = placed.where("settled and idx > ended")
    starts = placed.select("tape", (F.col("ended") + 1).alias("idx")).distinct()
    following = starts.unionAll(done.select("tape", F.col("idx") + 1))
    blocked = following.join(done.select("tape", "idx"), ["tape", "idx"], "left_anti").groupBy("tape").agg(F.min("idx").alias("blocked"))
    out = placed.join(blocked, "tape").where((F.col("idx") <= F.col("ended")) | (F.col("settled") & (F.col("idx") < F.col("blocked"))))
    return out.where("idx >= 1").select("tape", "idx", "tool", "req", "resp", "status", "reason")
