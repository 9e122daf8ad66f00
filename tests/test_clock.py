"""Stamps are monotone whatever the wall clock does."""

import threading

from pyspark.sql import functions as F

from quillon.functions import clock
from quillon.functions.clock import Clock, Oracle, Stamp


def test_clock_stands_jumps_back_and_sees_others():
    walls = iter([100, 100, 90, 120, 110, 120, 300, 300])
    c = Clock(lambda: next(walls))
    assert [c.now() for _ in range(4)] == [(100, 0), (100, 1), (100, 2), (120, 0)]
    assert c.now(Stamp(200, 5)) == (200, 6)  # another node is ahead
    assert c.now(Stamp(200, 9)) == (200, 10)  # the same millisecond: above both counters
    assert c.now(Stamp(50, 7)) == (300, 0)  # the wall clock is ahead of both
    assert c.now(Stamp(300, 0)) == (300, 1)


def test_packed():
    for s in (Stamp(0, 0), Stamp(1_705_000_000_123, 77), Stamp(5, clock.LOGICAL_MOST)):
        assert clock.unpacked(s.packed()) == s
    assert Stamp(5, 1 << 20).packed() == Stamp(5, clock.LOGICAL_MOST).packed() < Stamp(6, 0).packed()


def test_threads_share_a_clock_and_an_oracle():
    c, o, stamps, numbers = Clock(lambda: 7), Oracle(), [], []

    def work():
        for _ in range(500):
            stamps.append(c.now())
            numbers.extend(o.take(2))

    threads = [threading.Thread(target=work) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(set(stamps)) == 2000 and sorted(numbers) == list(range(1, 4001))
    o.advance(10)
    assert o.upcoming == 4001
    o.advance(5000)
    assert list(o.take()) == [5001]


def test_commit_wait():
    walls = [5]
    c = Clock(lambda: walls[0])
    assert not c.wait_past(Stamp(1000, 0), timeout=0.02)
    walls[0] = 1001
    assert c.wait_past(Stamp(1000, 0), timeout=1) and c.now() > Stamp(1000, 0)


def test_stamped_rows_are_those_of_a_clock(spark):
    walls = {"a": [100, 100, None, 90, 130, 130], "b": [None, 5, 5, 4, 6]}
    rows = [(n, i, w) for n, ws in walls.items() for i, w in enumerate(ws)]
    got = clock.stamped(spark.createDataFrame(rows, "node string, at long, wall long"), "node", "at", "wall").withColumn("p", clock.packed(F.col("hlc_wall"), F.col("hlc_logical"))).collect()
    by = {(r.node, r.at): (r.hlc_wall, r.hlc_logical) for r in got}
    assert [by["a", i] for i in range(6)] == [(100, 0), (100, 1), (100, 2), (100, 3), (130, 0), (130, 1)]
    assert [by["b", i] for i in range(5)] == [(0, 0), (5, 0), (5, 1), (5, 2), (6, 0)]
    assert all(r.p == Stamp(r.hlc_wall, r.hlc_logical).packed() for r in got)
