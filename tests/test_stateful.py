import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators.stepwise import Steps
from millrace.streaming import live
from millrace.streaming import replay as R
from millrace.streaming import stateful as T


def end(key):
    return [F.lit(-1).cast("long").alias(key), F.lit(None).cast("long").alias("r"), F.lit(10_000_000).cast("long").alias("t")]


@pytest.mark.parametrize("epochs", [1, 5])
def test_coalescer_cuts_a_log_like_the_loop(spark, epochs):
    """Full batches, batches that only a timer ends, equal times, and a batch that goes on over triggers."""
    rng = random.Random(epochs)
    log = sorted((k, r, t) for k in range(3) for r, t in enumerate(sorted(rng.randrange(1, 3000) for _ in range(60))))
    want = []
    for k in range(3):
        number, n, began = -1, 9, 0
        for _, r, t in (x for x in log if x[0] == k):
            if n >= 4 or t - began >= 100:
                number, n, began = number + 1, 0, t
            n += 1
            want.append((k, r, t, number))
    steps = Steps(spark, "coalescer-test")
    rows = spark.createDataFrame([*log, (0, None, 5)], "k long, r long, t long")
    got = R.finished(T.coalesced_batches(R.replayed(rows, "t", epochs, steps, end("k")), "k", "r", "t", 4, 100), "append", steps)
    assert sorted(map(tuple, got.collect())) == want


def test_many_batches_go_out_in_one_frame():
    class Held:
        def __init__(self):
            self.v = None

        get, put, update, exists = lambda self: self.v, lambda self, v: setattr(self, "v", v), lambda self, v: setattr(self, "v", v), lambda self: self.v is not None

    class Handle:
        getListState = getValueState = lambda self, *_: Held()
        registerTimer = deleteTimer = lambda self, _: None

    c = T.Coalescer("k", "r", "t", 4, 100)
    c.init(Handle())
    frames = list(c.handleInputRows((7,), iter([pd.DataFrame({"k": 7, "r": range(1002), "t": 5})]), None))
    assert len(frames) == 1 and frames[0]["r"].tolist() == list(range(1000)) and frames[0]["batch"].tolist() == [r // 4 for r in range(1000)]
    assert c.waiting.get() == [(1000, 5), (1001, 5)]


def test_entries_expire(spark):
    uses = [(1, k, t) for k, t in enumerate([1, 10, 20, 200, 200, 900])] + [(2, 0, 5)]
    steps = Steps(spark, "expiry-test")
    rows = spark.createDataFrame(uses, "k long, r long, t long")
    got = R.finished(T.expired_entries(R.replayed(rows, "t", 3, steps, end("k")), "k", "t", 100), "append", steps).filter("k > 0")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1, 20, 3), (1, 1, 200, 200, 2), (1, 2, 900, 900, 1), (2, 0, 5, 5, 1)]


def test_sessions_end_like_entries(spark):
    """Gaps of just the time to live and one second more, equal times, and entries that go on over triggers."""
    uses = [(1, k, t) for k, t in enumerate([1, 10, 20, 120, 221, 221, 900])] + [(2, 0, 5), (2, 1, None)]
    steps = Steps(spark, "sessions-test")
    rows = spark.createDataFrame(uses, "k long, r long, t long")
    got = T.numbered(R.finished(T.ended_entries(R.replayed(rows, "t", 3, steps, end("k")), "k", "t", 100), "append", steps).filter("k > 0"), "k")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1, 120, 4), (1, 1, 221, 221, 2), (1, 2, 900, 900, 1), (2, 0, 5, 5, 1)]


def test_switch_keeps_its_state_over_triggers(spark):
    rng = random.Random(4)
    readings = [("ab"[k % 2], rng.randrange(100), k) for k in range(400)]
    steps = Steps(spark, "switch-test")
    rows = spark.createDataFrame(readings, "k string, v long, ordinal long")
    got = R.finished(live.hysteresis(R.replayed(rows, "ordinal", 4, steps), "k", "v", 90, 10, None), "update", steps)
    on = {"a": False, "b": False}
    for k, v, _ in readings:
        on[k] = True if v >= 90 else False if v < 10 else on[k]
    assert {(r["k"], r["readings"], r["paused"]) for r in R.latest(got, "k").collect()} == {(k, 200, on[k]) for k in "ab"}
    assert got.select("epoch").distinct().count() > 2
