"""A keyed job queue: one running job a key, requests refused while it runs, jobs without an end given up.

What happens to each event is one small state machine (`step`), the same in both forms. As a stream it lives in
transformWithState with one value a key and a timer for jobs that never end; as a batch, events are dealt by key, sorted
by key and time, and read in order with the state of one key at a time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, at timestamp, kind string, outcome string"
_EPOCH = dt.datetime(1970, 1, 1)


def step(running: dt.datetime | None, at: dt.datetime, kind: str, stuck: dt.timedelta) -> tuple[dt.datetime | None, list[tuple]]:
    """The start of the job that runs after an event (or None), and what happened: (at, kind, outcome).

    request: started, or refused while a job runs. done, error: finished or failed, ignored where nothing runs. A job
    that has run for `stuck` is reset first, at that time.
    """
    said = []
    if running is not None and at >= running + stuck:
        said.append((running + stuck, "timer", "reset"))
        running = None
    if kind == "request":
        said.append((at, kind, "started" if running is None else "refused"))
        return (at if running is None else running), said
    ends = {"done": "finished", "error": "failed"}
    said.append((at, kind, ends[kind] if running is not None and kind in ends else "ignored"))
    return (None if kind in ends else running), said


def outcomes(events: DataFrame, key: str = "key", at: str = "at", kind: str = "kind", stuck: dt.timedelta = dt.timedelta(hours=1), last: str | None = None) -> DataFrame:
    """key, at, kind and outcome of each event, and of each job that was reset; events of equal time by `last`, then kind.

    Rows with a null key or time are left out. Jobs that run at the end stay as they are: no time has passed yet.
    """
    order = [at, *([last] if last else []), kind]
    rows = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    dealt = rows.select(F.col(key).cast("string").alias("key"), *order).repartition("key").sortWithinPartitions("key", *order)

    def read(frames):
        import pandas as pd

        now, running = None, None
        for frame in frames:
            out = []
            for k, when, what in zip(frame["key"], frame[at], frame[kind]):
                if k != now:
                    now, running = k, None
                running, said = step(running, when.to_pydatetime(), what, stuck)
                out += [(k, *s) for s in said]
            yield pd.DataFrame(out, columns=["key", "at", "kind", "outcome"])

    return dealt.mapInPandas(read, OUT)


class _Jobs(StatefulProcessor):
    def __init__(self, stuck: dt.timedelta):
        self.stuck = stuck

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "since timestamp")

    def _timer(self, since: dt.datetime) -> int:
        return int((since + self.stuck - _EPOCH) / dt.timedelta(milliseconds=1)) + 1

    def _keep(self, before: dt.datetime | None, after: dt.datetime | None) -> None:
        if before == after:
            return
        if before is not None:
            self.handle.deleteTimer(self._timer(before))
        if after is None:
            self.running.clear()
        else:
            self.running.update((after,))
            self.handle.registerTimer(self._timer(after))

    def _since(self) -> dt.datetime | None:
        return self.running.get()[0] if self.running.exists() else None

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        frame = pd.concat(list(rows)).sort_values(["at", "kind"], kind="stable")
        before = running = self._since()
        out = []
        for when, what in zip(frame["at"], frame["kind"]):
            running, said = step(running, when.to_pydatetime(), what, self.stuck)
            out += [(key[0], *s) for s in said]
        self._keep(before, running)
        yield pd.DataFrame(out, columns=["key", "at", "kind", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        since = self._since()
        if since is not None and self._timer(since) <= expiredTimerInfo.getExpiryTimeInMs():
            self.running.clear()
            yield pd.DataFrame([(key[0], since + self.stuck, "timer", "reset")], columns=["key", "at", "kind", "outcome"])

    def close(self) -> None:
        pass


#: transformWithState keeps its values there.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_outcomes(events: DataFrame, stuck: dt.timedelta = dt.timedelta(hours=1), late: str = "10 minutes") -> DataFrame:
    """The same over a stream of key, at and kind. Events later than `late` are dropped; a job without an end is reset once
    the watermark has passed it."""
    events.sparkSession.conf.set(*STATE_STORE)
    marked = events.select(F.col("key").cast("string").alias("key"), "at", "kind").withWatermark("at", late)
    return marked.groupBy("key").transformWithStateInPandas(_Jobs(stuck), OUT, "Append", "eventTime", eventTimeColumnName="")
