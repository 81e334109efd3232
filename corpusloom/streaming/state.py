"""Stateful stream processors: rate limiter, circuit breaker, values with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Limits of the rate limiter and of the breaker.
RATE, RATE_SECONDS = 60, 60
FAILURES, RECOVERY_SECONDS, PROBES, SUCCESSES = 5, 30, 3, 2


class Breaker:
    """The states of a circuit breaker, fed with the times and outcomes of calls.

    Closed until ``failures`` in a row, then open; after ``recovery`` seconds half open for at
    most ``probes`` calls, of which ``successes`` in a row close it and one failure reopens it.
    """

    def __init__(self, failures: int = FAILURES, recovery: float = RECOVERY_SECONDS, probes: int = PROBES, successes: int = SUCCESSES):
        self.failures, self.recovery, self.probes, self.successes = failures, recovery, probes, successes
        self.state, self.bad, self.good, self.tried, self.since = "closed", 0, 0, 0, 0.0

    def dump(self) -> tuple:
        return self.state, self.bad, self.good, self.tried, self.since

    def load(self, dumped: tuple) -> Breaker:
        self.state, self.bad, self.good, self.tried, self.since = dumped
        return self

    def call(self, at: float, failed: bool) -> tuple[bool, str]:
        """(whether the call was let through, the state after it)."""
        if self.state == "open" and at - self.since >= self.recovery:
            self.state, self.good, self.tried = "half_open", 0, 0
        if self.state == "open" or self.state == "half_open" and self.tried >= self.probes:
            return False, self.state
        if self.state == "half_open":
            self.tried += 1
            if failed:
                self.state, self.since = "open", at
            else:
                self.good += 1
                if self.good >= self.successes:
                    self.state, self.bad = "closed", 0
        elif failed:
            self.bad += 1
            if self.bad >= self.failures:
                self.state, self.since, self.bad = "open", at, 0
        else:
            self.bad = 0
        return True, self.state


def breaker_states(events: DataFrame, key: str, **limits) -> DataFrame:
    """(key, event_id, allowed, state) of calls (key, event_id, at double, failed), by time.

    A key's calls are one sequence by nature: its batches are streamed in order, so the state
    is all that a task holds.
    """
    kind = f"{key} {events.schema[key].dataType.simpleString()}, event_id long, allowed boolean, state string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, breaker = object(), Breaker(**limits)
        for pdf in batches:
            out = []
            for k, i, at, failed in zip(pdf[key], pdf["event_id"], pdf["at"], pdf["failed"], strict=True):
                if k != now:
                    now, breaker = k, Breaker(**limits)
                out.append((k, i, *breaker.call(at, failed)))
            yield pd.DataFrame(out, columns=[key, "event_id", "allowed", "state"])

    rows = events.select(key, "event_id", "at", "failed").repartition(key).sortWithinPartitions(key, "at", "event_id")
    return rows.mapInPandas(run, kind)


def rate_limited(events: DataFrame, key: str, most: int = RATE, seconds: float = RATE_SECONDS) -> DataFrame:
    """(key, event_id, accepted) of events (key, event_id, at double), by time.

    An event is accepted if fewer than ``most`` accepted ones lie in the last ``seconds``;
    rejected ones don't count.  A key's batches are streamed in order, so a task holds at most
    ``most`` times.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = object(), []
        for pdf in batches:
            out = []
            for k, i, at in zip(pdf[key], pdf["event_id"], pdf["at"], strict=True):
                if k != now:
                    now, held = k, []
                held = [x for x in held if x > at - seconds]
                out.append((k, i, len(held) < most))
                if out[-1][2]:
                    held.append(at)
            yield pd.DataFrame(out, columns=[key, "event_id", "accepted"])

    rows = events.select(key, "event_id", "at").repartition(key).sortWithinPartitions(key, "at", "event_id")
    return rows.mapInPandas(run, f"{key} {events.schema[key].dataType.simpleString()}, event_id long, accepted boolean")


class RateLimiter(StatefulProcessor):
    """Accepts an event if its key has fewer than ``most`` accepted ones in ``seconds``."""

    def __init__(self, most: int = RATE, seconds: float = RATE_SECONDS):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = list(self.held.get()[0]) if self.held.exists() else []
        events = sorted((float(at), int(i)) for pdf in rows for at, i in zip(pdf["at"], pdf["event_id"], strict=True))
        out = []
        for at, i in events:
            held = [x for x in held if x > at - self.seconds]
            ok = len(held) < self.most
            if ok:
                held.append(at)
            out.append((key[0], i, ok))
        self.held.update((held,))
        yield pd.DataFrame(out, columns=["key", "event_id", "accepted"])

    def close(self) -> None:
        pass


class Breakers(StatefulProcessor):
    """A circuit breaker for each key of a stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "state string, bad int, good int, tried int, since double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        breaker = Breaker()
        if self.state.exists():
            breaker.load(tuple(self.state.get()))
        calls = sorted((float(at), int(i), bool(bad)) for pdf in rows for at, i, bad in zip(pdf["at"], pdf["event_id"], pdf["failed"], strict=True))
        out = [(key[0], i, *breaker.call(at, bad)) for at, i, bad in calls]
        self.state.update(breaker.dump())
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed", "state"])

    def close(self) -> None:
        pass


class LastValue(StatefulProcessor):
    """The last value of each key, forgotten ``seconds`` after it was written."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value double", ttlDurationMs=self.seconds * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.value.get()[0] if self.value.exists() else None
        for pdf in rows:
            last = pdf.sort_values(["at", "event_id"]).iloc[-1]
            self.value.update((float(last["value"]),))
        yield pd.DataFrame({"key": [key[0]], "before": [before], "value": [self.value.get()[0]]})

    def close(self) -> None:
        pass


def limited(events: DataFrame, most: int = RATE, seconds: float = RATE_SECONDS) -> DataFrame:
    """(key, event_id, accepted) of a stream (key, event_id, at)."""
    return events.groupBy("key").transformWithStateInPandas(RateLimiter(most, seconds), "key long, event_id long, accepted boolean", "append", "none")


def broken(events: DataFrame) -> DataFrame:
    """(key, event_id, allowed, state) of a stream (key, event_id, at, failed)."""
    return events.groupBy("key").transformWithStateInPandas(Breakers(), "key long, event_id long, allowed boolean, state string", "append", "none")


def remembered(events: DataFrame, seconds: int) -> DataFrame:
    """(key, before, value) of a stream (key, event_id, at, value) with a time to live."""
    return events.groupBy("key").transformWithStateInPandas(LastValue(seconds), "key long, before double, value double", "append", "processingTime")


def _millis(at: float) -> int:
    return int(at * 1000 // 1)


class InOrder(StatefulProcessor):
    """Handles each key's events in the order of their times, however they arrive.

    An event waits in the state under its millisecond, with a timer there.  Timers go off in order
    once the watermark has passed them, so they are what sorts: no batch of a key is sorted or
    held in memory, only the events of one millisecond.  Events later than the watermark are dropped
    by Spark.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint", "ids array<bigint>, times array<double>, marks array<boolean>")
        self.prepare(handle)

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        """Declare more state."""

    def event(self, at: float, event_id: int, mark: bool) -> list[tuple]:
        """The rows that an event gives."""
        raise NotImplementedError

    def due(self, now: float) -> list[tuple]:
        """The rows that the passing of time up to ``now`` gives, before the events of that time."""
        return []

    def rows(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in out], columns=["key", *self.columns])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            marks = pdf["failed"] if "failed" in pdf else [False] * len(pdf)
            for at, i, mark in zip(pdf["at"], pdf["event_id"], marks, strict=True):
                ms = _millis(at)
                ids, times, bad = self.waiting.getValue((ms,)) if self.waiting.containsKey((ms,)) else ([], [], [])
                self.waiting.updateValue((ms,), ([*ids, int(i)], [*times, float(at)], [*bad, bool(mark)]))
                self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms = expiredTimerInfo.getExpiryTimeInMs()
        out = self.due(ms / 1000)
        if self.waiting.containsKey((ms,)):
            ids, times, marks = self.waiting.getValue((ms,))
            self.waiting.removeKey((ms,))
            for at, i, mark in sorted(zip(times, ids, marks, strict=True)):
                out += self.event(at, i, mark)
        if out:
            yield self.rows(key, out)

    def close(self) -> None:
        pass


class TimedBreakers(InOrder):
    """A circuit breaker for each key; it becomes half open by a timer, without waiting for a call."""

    columns = ("event_id", "allowed", "state")

    def __init__(self, **limits):
        self.limits = limits

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "state string, bad int, good int, tried int, since double")

    def _breaker(self) -> Breaker:
        breaker = Breaker(**self.limits)
        return breaker.load(tuple(self.state.get())) if self.state.exists() else breaker

    def event(self, at: float, event_id: int, mark: bool) -> list[tuple]:
        breaker = self._breaker()
        done = breaker.call(at, mark)
        self.state.update(breaker.dump())
        if breaker.state == "open" and breaker.since == at:
            self.handle.registerTimer(_millis(at + breaker.recovery) + 1)
        return [(event_id, *done)]

    def due(self, now: float) -> list[tuple]:
        breaker = self._breaker()
        if breaker.state != "open" or now - breaker.since < breaker.recovery:
            return []
        breaker.state, breaker.good, breaker.tried = "half_open", 0, 0
        self.state.update(breaker.dump())
        return [(None, None, "half_open")]


class TimedLimiter(InOrder):
    """The rate limiter for each key; what it holds goes when nothing in it counts any more."""

    columns = ("event_id", "accepted")

    def __init__(self, most: int = RATE, seconds: float = RATE_SECONDS):
        self.most, self.seconds = most, seconds

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "times array<double>")

    def event(self, at: float, event_id: int, mark: bool) -> list[tuple]:
        held = [x for x in (self.held.get()[0] if self.held.exists() else []) if x > at - self.seconds]
        ok = len(held) < self.most
        if ok:
            held.append(at)
            self.handle.registerTimer(_millis(at + self.seconds) + 1)
        self.held.update((held,))
        return [(event_id, ok)]

    def due(self, now: float) -> list[tuple]:
        if self.held.exists() and all(x <= now - self.seconds for x in self.held.get()[0]):
            self.held.clear()
        return []


def limited_in_order(events: DataFrame, most: int = RATE, seconds: float = RATE_SECONDS) -> DataFrame:
    """(key, event_id, accepted) of a stream (key, event_id, at, ts with a watermark): as ``rate_limited``
    decides, for events that arrive in any order within the watermark.  Idle keys keep no state."""
    return events.groupBy("key").transformWithStateInPandas(TimedLimiter(most, seconds), "key long, event_id long, accepted boolean", "append", "eventTime")


def broken_in_order(events: DataFrame, **limits) -> DataFrame:
    """(key, event_id, allowed, state) of a stream (key, event_id, at, failed, ts with a watermark): as
    ``breaker_states`` decides.  A row without an event says that a breaker became half open by its timer."""
    return events.groupBy("key").transformWithStateInPandas(TimedBreakers(**limits), "key long, event_id long, allowed boolean, state string", "append", "eventTime")
