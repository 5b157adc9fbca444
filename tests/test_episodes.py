"""Episodes of a stream against the table at rest and a plain loop, with a restart in the middle."""

from __future__ import annotations

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkgauge.streaming import episodes as E
from sparkgauge.streaming import streams

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def turn(e, t, minute, error=False, success=False, shown=True, progress=0):
    return (e, t, START + datetime.timedelta(minutes=minute), error, success, shown, progress)


def plain(rows):
    """Turns in order until one stops the episode."""
    out = {}
    for e in {r[0] for r in rows}:
        mine: dict = {}
        for r in sorted((r for r in rows if r[0] == e), key=lambda r: r[2]):
            mine.setdefault(r[1], r)
        told, why, t = [], None, 0
        while t in mine and why is None and t < E.LIMIT:
            _, _, _, error, success, shown, progress = mine[t]
            told += [] if error else [str(progress)]
            why = E.reason(t, error, success, shown, E.LIMIT)
            t += 1
        out[e] = (len(told), why == "success", t - 1 if why == "success" else None, ",".join(told), why or "abandoned")
    return out


def as_dict(df):
    rows = df.collect()
    assert len({r.episode for r in rows}) == len(rows)
    return {r.episode: (r.turns, r.solved, r.first_success, r.progress, r.stop_reason) for r in rows}


@pytest.fixture(scope="module")
def turns():
    r = random.Random(6)
    rows = [turn(e, t, 10 * e + t, r.random() < 0.05, r.random() < 0.1, r.random() < 0.95, r.randrange(99)) for e in range(60) for t in range(r.randrange(1, 9))]
    return [x for x in rows if not (x[0] % 9 == 8 and x[1] == 1)] + [turn(3, 0, 32, progress=1)]  # gaps, and a turn again


def test_table_at_rest(spark, turns):
    got = as_dict(E.ended(spark.createDataFrame(turns, E.TURNS).repartition(3)))
    assert got == plain(turns) and {v[-1] for v in got.values()} == {"transport", "success", "exhausted", "no_overlay", "abandoned"}


def test_restart_in_the_middle_gives_what_the_table_gives(spark, turns, tmp_path):
    """Turns of every episode lie on both sides of the restart, some out of order; what has ended isn't told again."""
    source, sink = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    parts = [[x for x in turns if x[1] % 2 == 1 and x[0] % 3 == 0], [x for x in turns if x[1] < 2 and not (x[1] % 2 == 1 and x[0] % 3 == 0)]]
    parts.append([x for x in turns if x not in parts[0] and x not in parts[1]])

    def run():
        with streams.rocks(spark):
            rows = spark.readStream.schema(E.TURNS).option("maxFilesPerTrigger", 1).parquet(source)
            streams.append_all(E.episodes(rows, "30 days", 3600), sink)
        return spark.read.schema(E.ENDED).parquet(sink)

    write = lambda rows: spark.createDataFrame(rows, E.TURNS).coalesce(1).write.mode("append").parquet(source)
    write(parts[0])
    write(parts[1])
    first = as_dict(run())
    assert first and all(v[-1] != "abandoned" for v in first.values())
    write(parts[2])
    second = as_dict(run())
    want = plain(turns)
    assert second.items() >= first.items() and second == {e: v for e, v in want.items() if v[-1] != "abandoned"}
    write([turn(-1, 3, 60 * 24 * 90)])
    assert as_dict(run()) == want
    write([turn(0, 5, 60 * 24 * 80, success=True)])
    assert as_dict(run()) == want


def test_no_rows(spark):
    assert E.ended(spark.createDataFrame([], E.TURNS)).collect() == []
    assert E.ended(spark.createDataFrame([(None, 0, START, False, True, True, 1)], E.TURNS)).where(F.col("turns") > 0).collect() == []


class Calls:
    """Stands for a handle, its states and timers, and counts the calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "get":
                return self.value
            if name == "update":
                self.value = args[0]
            elif name == "registerTimer":
                self.timers.add(args[0])
            elif name == "deleteTimer":
                self.timers.remove(args[0])
            else:
                raise AssertionError(name)

        return call


def test_few_calls_of_state_per_batch(turns):
    """However many turns a batch has and however many wait, an episode makes four calls at most, and one timer is left where it goes on."""
    columns = ["episode", "turn", "ts", "error", "success", "shown", "progress"]
    want = plain(turns)
    for e in range(60):
        mine, handle, told = [r for r in turns if r[0] == e], Calls(), []
        machine = E.Episodes(E.LIMIT, 1000)
        machine.handle = machine.state = handle
        for batch in (mine[1::2], mine[::2]):
            handle.calls = 0
            frame = pd.DataFrame(batch, columns=columns)
            told += [f.iloc[0] for f in machine.handleInputRows((e,), iter([frame] if batch else []), None)] if batch else []
            assert handle.calls <= 4
        if want[e][-1] == "abandoned":
            assert not told and len(handle.timers) == 1
            told = [f.iloc[0] for f in machine.handleExpiredTimer((e,), None, None)]
        else:
            assert not handle.timers
        assert [(r.turns, r.progress, r.stop_reason) for r in told] == [(want[e][0], want[e][3], want[e][4])]
