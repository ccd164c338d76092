"""The rate limit over a stream whose requests come in any order, by event time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.constants import RATE_PER_MINUTE
from ..operators.service import WINDOW_S
from ..sources.session import ship


class InOrder(StatefulProcessor):
    """Holds a key's requests until the watermark has passed them, then judges them in order of time and id.

    State: requests that wait, and the times of allowed requests of the last minute, per_minute at most. A timer fires when
    the watermark reaches the first that waits; another, when a minute has passed behind the last allowed one, empties the
    state of a silent key.
    """

    def __init__(self, per_minute: int, order_type: str):
        self.per_minute, self.order_type = per_minute, order_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at double, event_id {self.order_type}")
        self.recent = handle.getListState("recent", "at double")

    def _timer(self, seconds: float) -> None:
        self.handle.registerTimer(max(1, math.ceil(seconds * 1000)))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        times = sorted(initialState["at"].tolist())[-self.per_minute :] if self.per_minute > 0 else []
        if times:
            self.recent.put([(t,) for t in times])
            self._timer(times[-1] + WINDOW_S)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [pair for frame in rows for pair in zip(frame["at"].tolist(), frame["event_id"].tolist(), strict=True)]
        if new:
            self.waiting.appendList(new)
            self._timer(min(new)[0])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(x) for x in self.waiting.get())
        due = [x for x in waiting if math.ceil(x[0] * 1000) <= until]
        recent = [x[0] for x in self.recent.get()]
        allowed = []
        for t, _ in due:
            recent = [x for x in recent if t - x < WINDOW_S]
            allowed.append(len(recent) < self.per_minute)
            if allowed[-1]:
                recent.append(t)
        waiting = waiting[len(due) :]
        if recent and (recent[-1] + WINDOW_S) * 1000 <= until and not waiting:
            recent = []
        for state, rows in ((self.waiting, waiting), (self.recent, [(t,) for t in recent])):
            if rows:
                state.put(rows)
            else:
                state.clear()
        if waiting:
            self._timer(waiting[0][0])
        elif recent:
            self._timer(recent[-1] + WINDOW_S)
        if due:
            yield pd.DataFrame({"user_id": [key[0]] * len(due), "event_id": [e for _, e in due], "at": [t for t, _ in due], "allowed": allowed})

    def close(self) -> None:
        pass


def rate_limit_by_time(requests: DataFrame, per_minute: int = RATE_PER_MINUTE, late: str = "5 minutes", since: DataFrame | None = None) -> DataFrame:
    """(user_id, event_id, at, allowed) of a stream of requests (user_id, event_id, ts), as operators.service.rate_limit has them
    for the same requests at once, in whatever order they come.

    A request is judged once the watermark, which is `late` behind the latest one seen, has passed it; requests that come
    behind the watermark are dropped. since: (user_id, at) of allowed requests before the stream, such as those that the batch
    form judged last: the stream goes on from them. The session's state store has to be RocksDB's.
    """
    ship(requests.sparkSession)
    fields = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    rows = requests.select("user_id", "event_id", "ts", (F.unix_micros("ts") / 1e6).alias("at")).withWatermark("ts", late)
    out = f"user_id {fields['user_id']}, event_id {fields['event_id']}, at double, allowed boolean"
    first = None if since is None else since.select("user_id", "at").groupBy("user_id")
    return rows.groupBy("user_id").transformWithStateInPandas(InOrder(per_minute, fields["event_id"]), out, "append", "eventTime", first)
