"""Keyed state with time: retries with limits and time-outs, and an exact log of requests.

Both use transformWithStateInPandas in event time, so a session needs RocksDB as its state store
(spark.sql.streaming.stateStore.providerClass).  Timers fire once the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAIR = "model_name string, scenario_id string, failures bigint, done boolean, action string, at timestamp"
LOGGED = "provider string, request_id bigint, ts timestamp, in_window bigint, waits boolean"


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class Attempts(StatefulProcessor):
    """What is known of a pair: failures, whether it is done, and since when an attempt is under way (-1: none is).

    An attempt that has no result when its time is up is a failure, and so is one whose result comes later than that.  The
    pair is done with a success or after limit failures; what comes then changes nothing.  keep after that its state goes.
    """

    def __init__(self, limit: int, timeout_ms: int, session_timeout_ms: int, keep_ms: int):
        self.limit, self.timeout_ms, self.session_timeout_ms, self.keep_ms = limit, timeout_ms, session_timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pair = handle.getValueState("pair", "failures bigint, success boolean, since bigint, due bigint, forget bigint")

    def _now(self) -> list:
        return list(self.pair.get()) if self.pair.exists() else [0, False, -1, -1, -1]

    def _row(self, key: tuple, failures: int, success: bool, at: int) -> pd.DataFrame:
        spent = failures >= self.limit
        action = "skip" if success else "zero" if spent else "retry"
        return pd.DataFrame({"model_name": [key[0]], "scenario_id": [key[1]], "failures": [failures], "done": [success or spent], "action": [action], "at": [pd.Timestamp(at, unit="ms")]})

    def _kept(self, failures: int, success: bool, since: int, due: int, forget: int, at: int) -> None:
        if (success or failures >= self.limit) and forget < 0:
            forget = at + self.keep_ms
            self.handle.registerTimer(forget)
        self.pair.update((failures, success, since, due, forget))

    def _ended(self, due: int) -> None:
        if due >= 0:
            self.handle.deleteTimer(due)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        """failures and success of the pair as an earlier run saved them."""
        row = initialState.iloc[0]
        self._kept(int(row["failures"]), bool(row["success"]), -1, -1, -1, max(0, timerValues.getCurrentWatermarkInMs()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, success, since, due, forget = self._now()
        events = pd.concat(list(rows)).sort_values(["ts", "event"], ascending=[True, False], kind="stable")  # of equal times starts come first
        at = 0
        for r in events.itertuples():
            at = _millis(r.ts)
            if success or failures >= self.limit:
                continue
            if since >= 0 and at > due:  # the time was up before this
                self._ended(due)
                failures, since, due = failures + 1, -1, -1
                if r.event == "result":
                    continue
            if failures >= self.limit:
                continue
            if r.event == "start":
                self._ended(due)
                since, due = at, at + (self.session_timeout_ms if r.task_category == "multi_session_development" else self.timeout_ms)
                self.handle.registerTimer(due)
            else:
                self._ended(due)
                since = due = -1
                success, failures = bool(r.success), failures + (not r.success)
        self._kept(failures, success, since, due, forget, at)
        yield self._row(key, failures, success, at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, success, since, due, forget = self._now()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at == forget:
            self.pair.clear()
        elif at == due:
            self._kept(failures + 1, success, -1, -1, forget, at)
            yield self._row(key, failures + 1, success, at)

    def close(self) -> None:
        pass


def retry_machine(events: DataFrame, limit: int = 10, timeout: int = 300, session_timeout: int = 600, delay: str = "1 minute", keep: int = 7 * 86_400, initial: DataFrame | None = None) -> DataFrame:
    """model_name, scenario_id, failures, done, action, at: the state of each pair whenever it changes, in mode "update".

    events(model_name, scenario_id, event, success, task_category, ts) are "start" and "result"; times are seconds, and
    session_timeout is that of multi-session scenarios.  initial(model_name, scenario_id, failures, success), one row a pair,
    is the state that an earlier run saved.  Events later than delay are left out; done pairs are forgotten after keep.
    """
    grouped = events.withWatermark("ts", delay).groupBy("model_name", "scenario_id")
    state = initial.groupBy("model_name", "scenario_id") if initial is not None else None
    return grouped.transformWithStateInPandas(Attempts(limit, 1000 * timeout, 1000 * session_timeout, 1000 * keep), PAIR, "Update", "EventTime", initialState=state)


class RequestLog(StatefulProcessor):
    """The requests of a provider: those that wait for the watermark, and the times of the last seconds."""

    def __init__(self, seconds: int, limit: int):
        self.width, self.limit = seconds * 1_000_000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, request_id bigint")
        self.log = handle.getListState("log", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = 0
        for batch in rows:
            at = batch["ts"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList(list(zip(at.tolist(), batch["request_id"].tolist(), strict=True)))
            last = max(last, int(at.max()))
        self.handle.registerTimer(last // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = 1000 * expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted(tuple(x) for x in self.waiting.get())
        due = [x for x in waiting if x[0] < until]
        log = sorted([x[0] for x in self.log.get()] + [x[0] for x in due])
        first = end = 0
        out = []
        for at, request in due:
            while log[first] < at - self.width:  # one of exactly so many seconds ago still counts
                first += 1
            while end < len(log) and log[end] <= at:
                end += 1
            out.append((key[0], request, pd.Timestamp(at, unit="us"), end - first, end - first > self.limit))
        for state, rest in ((self.waiting, [x for x in waiting if x[0] >= until]), (self.log, [(x,) for x in log[first:]])):
            state.put(rest) if rest else state.clear()
        if out:
            yield pd.DataFrame(out, columns=["provider", "request_id", "ts", "in_window", "waits"])

    def close(self) -> None:
        pass


def request_log(requests: DataFrame, seconds: int = 60, limit: int = 600, delay: str = "2 minutes") -> DataFrame:
    """provider, request_id, ts, in_window, waits of every request: the provider's requests in the seconds up to and with it.

    The same counts as results.rate_in_window gives a table.  A request comes out once the watermark has passed it, when no
    earlier one can come any more; requests later than delay are left out.  A provider's state is what came within delay
    and the last seconds, which its rate bounds.
    """
    return requests.withWatermark("ts", delay).groupBy("provider").transformWithStateInPandas(RequestLog(seconds, limit), LOGGED, "Append", "EventTime")
