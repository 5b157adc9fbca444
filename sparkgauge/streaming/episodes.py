"""Episodes of several turns as a keyed state machine over a stream, and the same outcome from a table.

An episode reads its turns in order. It stops at a transport failure, a success, its last allowed turn, or a turn that leaves
nothing to show (in this order of rank), and then gives one row. Turns that come early wait in its state; an episode that
has heard nothing for ``patience`` of event time is given up by a timer. State is one small row and at most ``limit``
waiting turns an episode, and goes when the episode ends, but for a mark that keeps late turns from starting it anew.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Turns of an episode at most.
LIMIT = 6
TURNS = "episode bigint, turn int, ts timestamp, error boolean, success boolean, shown boolean, progress bigint"
ENDED = "episode bigint, turns bigint, solved boolean, first_success bigint, progress string, stop_reason string"
#: waiting: turns that came early as JSON, [turn, error, success, shown, progress] each, at most LIMIT of them.
STATE = "next int, turns int, progress string, due bigint, over boolean, waiting string"


def reason(turn: int, error: bool, success: bool, shown: bool, limit: int) -> str | None:
    """Why an episode stops at this turn; None if it goes on."""
    return "transport" if error else "success" if success else "exhausted" if turn == limit - 1 else None if shown else "no_overlay"


class Episodes(StatefulProcessor):
    """The state machine of one episode; see the module's text.

    Every call of a state or timer is a trip to the JVM and back, so a batch of an episode makes four at most: its state is one
    value, read once and written once, and its timer is known from it and set only where it changes.
    """

    def __init__(self, limit: int, patience_ms: int):
        self.limit, self.patience = limit, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("episode", STATE)

    def _ended(self, key: int, turns: int, progress: str, turn: int | None, why: str) -> pd.DataFrame:
        solved = why == "success"
        return pd.DataFrame({"episode": [key], "turns": [turns], "solved": [solved], "first_success": pd.array([turn if solved else None], "Int64"), "progress": [progress], "stop_reason": [why]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, turns, progress, timer, over, early = self.state.get() or (0, 0, "", 0, False, "[]")
        if over:
            return
        due, waiting = timer, {t: rest for t, *rest in json.loads(early)}
        for frame in rows:
            due = max(due, int(frame["ts"].max().timestamp() * 1000) + self.patience)
            named = zip(*(frame[c].tolist() for c in ("turn", "ts", "error", "success", "shown", "progress")), strict=True)
            for turn, _, error, success, shown, far in sorted(named, key=lambda r: r[:2]):
                if at <= turn < self.limit:
                    waiting.setdefault(int(turn), [bool(error), bool(success), bool(shown), int(far)])
        while at in waiting:
            error, success, shown, far = waiting.pop(at)
            if not error:
                turns, progress = turns + 1, f"{progress},{far}" if turns else str(far)
            if why := reason(at, error, success, shown, self.limit):
                if timer:
                    self.handle.deleteTimer(timer)
                self.state.update((at, turns, progress, 0, True, "[]"))
                yield self._ended(key[0], turns, progress, at, why)
                return
            at += 1
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.state.update((at, turns, progress, due, False, json.dumps([[t, *rest] for t, rest in waiting.items()])))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, turns, progress, _, over, _ = self.state.get()
        if not over:
            self.state.update((at, turns, progress, 0, True, "[]"))
            yield self._ended(key[0], turns, progress, None, "abandoned")

    def close(self) -> None:
        pass


def episodes(stream: DataFrame, late: str, patience_s: int, limit: int = LIMIT) -> DataFrame:
    """Ended episodes (ENDED) of a stream of turns (TURNS), in append mode. Needs the RocksDB state store.

    Of several rows of a turn the first by ts of a batch counts, and those of earlier batches before. Rows without an episode or turn, and
    turns from limit on, are passed over. Rows later than the watermark allows are dropped by Spark.
    """
    rows = stream.where(F.col("episode").isNotNull() & F.col("turn").isNotNull() & (F.col("turn") < limit)).withWatermark("ts", late)
    return rows.groupBy("episode").transformWithStateInPandas(Episodes(limit, 1000 * patience_s), ENDED, "Append", "EventTime")


def ended(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """What episodes() gives for all of a table's rows, if none is late: of each episode at most limit turns meet, reduced before the shuffle."""
    own: Column = F.struct("ts", "error", "success", "shown", "progress")
    first = rows.where(F.col("episode").isNotNull() & F.col("turn").between(0, limit - 1)).groupBy("episode", "turn").agg(F.min_by(own, "ts").alias("r"))
    turns = first.select("episode", "turn", "r.*")
    stop = F.when(F.col("error"), "transport").when(F.col("success"), "success").when(F.col("turn") == limit - 1, "exhausted").when(~F.col("shown"), "no_overlay")
    listed = turns.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("turn", stop.alias("stop"), "error", "progress"))).alias("all"))
    unbroken = F.filter("all", lambda x, i: x["turn"] == i)
    held = listed.withColumn("all", unbroken).withColumn("end", F.array_min(F.transform(F.filter("all", lambda x: x["stop"].isNotNull()), lambda x: x["turn"])))
    held = held.withColumn("all", F.filter("all", lambda x: F.col("end").isNull() | (x["turn"] <= F.col("end")))).withColumn("why", F.coalesce(F.get("all", F.col("end"))["stop"], F.lit("abandoned")))
    told = F.filter("all", lambda x: ~x["error"])
    solved = F.col("why") == "success"
    return held.select("episode", F.size(told).cast("long").alias("turns"), solved.alias("solved"), F.when(solved, F.col("end")).cast("long").alias("first_success"), F.array_join(F.transform(told, lambda x: x["progress"].cast("string")), ",").alias("progress"), F.col("why").alias("stop_reason"))
