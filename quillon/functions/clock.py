"""Hybrid logical clocks and a timestamp oracle: monotone time for sessions, and for logs in a table.

A stamp is (wall, logical): milliseconds, and a counter that goes on while these stand still or jump back. Stamps order as tuples do. ``Clock`` and ``Oracle`` serve a driver's session; ``stamped`` gives the rows
of a log the stamps that a clock per node would have given them, as windows in Spark.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A packed stamp has 48 bits of milliseconds and 16 bits of counter, which stays at its greatest value.
WALL_BITS, LOGICAL_BITS = 48, 16
LOGICAL_MOST = (1 << LOGICAL_BITS) - 1


class Stamp(NamedTuple):
    wall: int
    logical: int

    def packed(self) -> int:
        return (self.wall & ((1 << WALL_BITS) - 1)) << LOGICAL_BITS | min(self.logical, LOGICAL_MOST)


def unpacked(packed: int) -> Stamp:
    return Stamp(packed >> LOGICAL_BITS, packed & LOGICAL_MOST)


def wall_ms() -> int:
    return time.time_ns() // 1_000_000


class Clock:
    """Stamps of one node: each is above all that it gave or saw before, whatever the wall clock does. Threads may share it."""

    def __init__(self, wall: Callable[[], int] = wall_ms):
        self._wall, self._lock, self.last = wall, threading.Lock(), Stamp(0, 0)

    def now(self, *seen: Stamp) -> Stamp:
        """A new stamp, above those seen from other nodes too."""
        with self._lock:
            self.last = max(Stamp(self._wall(), 0), *(Stamp(s.wall, s.logical + 1) for s in (self.last, *seen)))
            return self.last

    def wait_past(self, stamp: Stamp, timeout: float | None = None, pause: float = 0.001) -> bool:
        """Commit wait: true once the clock is past the stamp, false if ``timeout`` seconds weren't enough."""
        end = None if timeout is None else time.monotonic() + timeout
        while self.now() <= stamp:
            if end is not None and time.monotonic() >= end:
                return False
            time.sleep(pause)
        return True


class Oracle:
    """Consecutive whole numbers, each given once."""

    def __init__(self, start: int = 1):
        self._lock, self._next = threading.Lock(), start

    @property
    def upcoming(self) -> int:
        return self._next

    def take(self, n: int = 1) -> range:
        """The next n numbers, reserved at once."""
        with self._lock:
            first, self._next = self._next, self._next + n
        return range(first, first + n)

    def advance(self, seen: int) -> None:
        """Go on above a number seen elsewhere."""
        with self._lock:
            self._next = max(self._next, seen + 1)


def packed(wall: Column, logical: Column) -> Column:
    """A stamp as one long, which orders as stamps do while counters stay below their greatest value."""
    return F.shiftleft(wall.cast("long").bitwiseAND((1 << WALL_BITS) - 1), LOGICAL_BITS).bitwiseOR(F.least(logical.cast("long"), F.lit(LOGICAL_MOST).cast("long")))


def stamped(rows: DataFrame, node: str, order: str, wall: str) -> DataFrame:
    """Adds ``hlc_wall`` and ``hlc_logical``: what the node's clock says at each of its rows, taken in order. A row without a time doesn't move the clock's milliseconds."""
    log = W.partitionBy(node).orderBy(order)
    seen = rows.withColumn("hlc_wall", F.coalesce(F.max(wall).over(log.rowsBetween(W.unboundedPreceding, 0)), F.lit(0).cast("long")))
    return seen.withColumn("hlc_logical", F.row_number().over(W.partitionBy(node, "hlc_wall").orderBy(order)) - 1)
