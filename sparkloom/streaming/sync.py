"""Debounced synchronisation as a stream: a user's changes are gathered until nothing has come for a while, then merged into what was
written before, last writer first, and written only if something differs.

The state of a user is what was written, an entry a key, and the rounds that are still open, each with the last change of
each key: its size goes with keys and open rounds, not with events. A timer in event time closes a round; a change that comes before moves it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a change has: whose it is, when (milliseconds) and its number, which breaks ties; and what was set to what.
CHANGE = "user_id long, ms long, id long, key string, value string, at timestamp"
ROUND = "user_id long, round long, start_ms long, n_changes long, n_keys long, n_written long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rounds(StatefulProcessor):
    """Opens, joins and closes rounds of changes; gives a row for each round that was written."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, finish long, n long, latest string")
        self.written = handle.getMapState("written", "key string", "ms long, id long, value string")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        rounds = self._held()
        for frame in rows:
            f = frame[["ms", "id", "key", "value"]].sort_values(["ms", "id"])
            rounds = self._joined(rounds + [[m, m, 1, {k: [m, i, v]}] for m, i, k, v in zip(f["ms"].tolist(), f["id"].tolist(), f["key"].tolist(), f["value"].tolist(), strict=True)])
        self._hold(rounds)
        yield pd.DataFrame(columns=[c.split()[0] for c in ROUND.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        rounds, out = self._held(), []
        n = self.count.get()[0] if self.count.exists() else 0
        for start, finish, size, latest in rounds:
            if finish + self.quiet > now:
                continue
            n += 1
            changed = self._merged(latest)
            if changed:
                out.append((key[0], n, start, size, len(latest), changed))
        self.count.update((n,))
        self._hold([r for r in rounds if r[1] + self.quiet > now])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ROUND.split(", ")])

    def _merged(self, latest: dict) -> int:
        """Takes a round's changes into what was written, where they are later; how many keys have another value now."""
        changed = 0
        for k, (ms, i, value) in latest.items():
            old = self.written.getValue((k,)) if self.written.containsKey((k,)) else None
            if old is None or (ms, i) > (old[0], old[1]):
                self.written.updateValue((k,), (ms, i, value))
                changed += old is None or old[2] != value
        return changed

    def _joined(self, rounds: list) -> list:
        """Rounds no farther apart than the quiet time are one, with the last change of each key."""
        out: list = []
        for r in sorted(rounds, key=lambda r: (r[0], r[1])):
            if out and r[0] - out[-1][1] <= self.quiet:
                last = out[-1]
                last[1], last[2] = max(last[1], r[1]), last[2] + r[2]
                for k, x in r[3].items():
                    if k not in last[3] or x[:2] > last[3][k][:2]:
                        last[3][k] = x
            else:
                out.append(r)
        return out

    def _held(self) -> list:
        return [[s, f, n, json.loads(x)] for s, f, n, x in self.open.get()] if self.open.exists() else []

    def _hold(self, rounds: list) -> None:
        """Keeps the open rounds, and one timer: when the first of them has been quiet for long enough."""
        self.open.clear()
        if rounds:
            self.open.put([(s, f, n, json.dumps(x)) for s, f, n, x in rounds])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rounds:
            self.handle.registerTimer(min(r[1] for r in rounds) + self.quiet)

    def close(self) -> None:
        pass


def rounds(changes: DataFrame, quiet_ms: int, late: str = "1 hour") -> DataFrame:
    """A stream of changes (CHANGE) to the rounds that were written (ROUND), in output mode append: which round of the user it was,
    when it began, its changes, their keys, and how many of these have another value than was written before. Needs the RocksDB state store."""
    grouped = changes.withWatermark("at", late).groupBy("user_id")
    return grouped.transformWithStateInPandas(statefulProcessor=Rounds(quiet_ms), outputStructType=ROUND, outputMode="Append", timeMode="EventTime")


class with_rocks:
    """Within it, streams that start keep their state in RocksDB."""

    def __init__(self, spark: SparkSession):
        self.conf, self.name = spark.conf, "spark.sql.streaming.stateStore.providerClass"

    def __enter__(self) -> None:
        self.before = self.conf.get(self.name, None)
        self.conf.set(self.name, ROCKS)

    def __exit__(self, *_) -> None:
        self.conf.unset(self.name) if self.before is None else self.conf.set(self.name, self.before)


def of_events(events: DataFrame) -> DataFrame:
    """The events' stream as changes: a type is set to the whole hundreds of its value."""
    return events.select("user_id", F.unix_millis("at").alias("ms"), F.col("event_id").alias("id"), F.col("event_type").alias("key"), F.floor(F.col("value") / 100).cast("string").alias("value"), "at")
