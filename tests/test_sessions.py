"""Released calls: the batch answer against a plain recorder, and the stream against the batch answer."""

import random
from datetime import datetime, timedelta

import pytest

from plumbline.operators import sessions
from plumbline.streaming import sessions as streams

T0 = datetime(2026, 1, 1)


def event(tape, kind, idx, second, tool=None, req=None, resp=None, status=None, reason=None):
    return (tape, kind, idx, T0 + timedelta(seconds=second), tool, req, resp, status, reason)


def recorded(tape, n, seed, ends):
    """Events of one tape: some calls open, some closed, invalid, answered twice or missing."""
    pick, rows = random.Random(seed), []
    for i in range(1, n + 1):
        kind = pick.random()
        if kind > 0.03:
            rows.append(event(tape, "call", i, i * 10, f"tool{i % 3}", f"r{i}", status="invalid_id" if kind > 0.97 else None))
        if kind < 0.85:
            rows.append(event(tape, "answer", i, i * 10 + pick.randint(1, 90), resp=f"a{i}", status="error" if kind < 0.2 else "ok"))
        elif kind < 0.92:
            rows.append(event(tape, "close", i, i * 10 + 5, reason="gone"))
    return rows + [event(tape, "end", e, e * 10 + 100) for e in ends]


def plain(rows):
    """What one recorder writes: by number, until a call that isn't settled or isn't there, unless a session has ended beyond."""
    found = []
    for tape in {r[0] for r in rows if r[0]}:
        own = sorted((r for r in rows if r[0] == tape and r[2] is not None), key=lambda r: r[3])
        first = {}
        for r in own:
            first.setdefault((r[1], r[2]), r)
        ended = max((r[2] for r in own if r[1] == "end"), default=0)
        for i in range(1, max(r[2] for r in own) + 1):
            call, answer, close = (first.get((k, i)) for k in ("call", "answer", "close"))
            bad = call and call[7] == "invalid_id"
            if not call or not (bad or answer or close):
                if i > ended:
                    break
                if call:
                    found.append((tape, i, call[4], call[5], None, "unanswered", "no_response"))
                continue
            found.append((tape, i, call[4], call[5], None if bad or not answer else answer[6], "invalid_id" if bad else answer[7] if answer else "unanswered", None if bad or answer else close[8]))
    return sorted(found)


TAPES = [("a", 60, 1, [60]), ("b", 80, 2, [30]), ("c", 50, 3, []), ("d", 1, 4, []), ("e", 70, 5, [20, 55, 70])]


@pytest.fixture(scope="module")
def rows():
    return [r for t in TAPES for r in recorded(*t)]


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_batch(spark, rows):
    odd = [event(None, "call", 1, 1), event("f", "answer", 1, 1, resp="x"), event("c", "call", None, 2), event("c", "shout", 3, 2)]
    assert got(sessions.committed(spark.createDataFrame(rows + odd, sessions.EVENTS).repartition(5))) == plain(rows)
    again = rows + [event("a", "call", 5, 900, "other"), event("a", "answer", 7, 901, resp="late", status="ok")] * 2
    assert got(sessions.committed(spark.createDataFrame(again, sessions.EVENTS))) == plain(again)
    assert got(sessions.committed(spark.createDataFrame([], sessions.EVENTS))) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_of_shuffled_batches_equals_batch_and_restarts(spark, rows, tmp_path, seed):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_STORE)
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    last = [event("z", "call", 1, 10**6)]  # moves the watermark past every end
    parts = [shuffled[i::4] for i in range(4)] + [last, [event("z", "answer", 1, 10**6 + 1, resp="r", status="ok")]]
    out = f"{tmp_path}/out"
    for i, part in enumerate(parts):  # every part is a run of its own from the same checkpoint
        spark.createDataFrame(part, sessions.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(sessions.EVENTS).parquet(f"{tmp_path}/in")
        q = streams.release(stream, delay="3 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        held = sum(p["numRowsTotal"] for s in q.recentProgress[-1:] for p in s["stateOperators"])
        if i >= 4:
            assert held < 200  # numbers, ends, and what open calls hold back: not the 500 events
    found = got(spark.read.parquet(out))
    assert [r for r in found if r[0] != "z"] == plain(rows)
    assert [r for r in found if r[0] == "z"] == [("z", 1, None, None, "r", "ok", None)]
    assert len({(r[0], r[1]) for r in found}) == len(found)
