"""Prefix scans and order statistics against plain loops, with keys that span many blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import merge, scan
from sparkgauge.operators.scan import Fold, nearest_ranks, segmented_scan


@pytest.fixture
def many_blocks(spark, monkeypatch):
    """Keys of more than a ninth of the rows are large, and small tables stay in several blocks."""
    monkeypatch.setattr(scan, "LARGE", 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(seed, n=900):
    """Half of the rows belong to one key, a tenth to the null key; orders tie, values are null now and then."""
    r = random.Random(seed)
    return [(i, r.choice([1, 1, 1, 1, 1, None, *range(2, 6)]), r.choice([None, *range(40)]), r.choice([None, *range(-50, 50)])) for i in range(n)]


def folds():
    one, v = F.lit(1).cast("long"), F.col("v")
    best = Fold(F.struct(F.coalesce("v", F.lit(-99)).alias("v"), "id"), "max", "before")
    return {"place": Fold(one), "upto": Fold(v), "total": Fold(v, rows="all"), "best": best, "least": Fold(v, "min", "before"), "n": Fold(one, rows="all")}


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_is_a_loop_over_sorted_rows(spark, many_blocks, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "id long, key long, o long, v long").repartition(5)
    got = segmented_scan(df, ["key"], ["o", F.col("id").desc()], folds()).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    for key in {k for _, k, _, _ in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or 0, -r[0]))
        seen, total = [], [v for *_, v in mine if v is not None]
        for place, (i, _, _, v) in enumerate(mine, 1):
            known = [x for _, x in seen if x is not None]
            r = by[i]
            assert (r.place, r.n, r.total) == (place, len(mine), sum(total) if total else None)
            assert r.least == (min(known) if known else None)
            assert (tuple(r.best) if r.best else None) == max(((x if x is not None else -99, j) for j, x in seen), default=None)
            seen.append((i, v))
            assert r.upto == (sum(x for _, x in seen if x is not None) if any(x is not None for _, x in seen) else None)


def test_hot_key_with_equal_rows_is_dealt_over_blocks(spark, many_blocks):
    df = spark.range(3000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("key"), F.lit(1).alias("o"))
    got = segmented_scan(df, ["key"], ["o"], {"place": Fold(F.lit(1).cast("long"))})
    hot = got.where("key = -1")
    assert sorted(r.place for r in hot.collect()) == list(range(1, 1501))
    assert {r.place for r in got.where("key <> -1").collect()} == {1}
    folders = {f.rpartition("/")[0] for f in got.inputFiles()}
    sizes = spark.read.parquet(*folders).where("key = -1").groupBy("__block").count().collect()
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 600


def test_empty_tables_and_two_keys(spark, many_blocks):
    empty = spark.createDataFrame([], "a string, b int, v int")
    assert segmented_scan(empty, ["a", "b"], ["v"], {"n": Fold(F.col("v"))}).collect() == []
    df = spark.createDataFrame([("x", 1, 5), ("x", 2, 7), ("x", 1, 6), (None, 1, 1), (None, 1, 2)], "a string, b int, v int")
    assert sorted(r.n for r in segmented_scan(df, ["a", "b"], ["v"], {"n": Fold(F.col("v"))}).collect()) == [1, 3, 5, 7, 11]


def test_conflicts_of_a_key_with_half_of_the_rows(spark, many_blocks):
    r = random.Random(8)
    rows = [(r.choice([0, i]), i, r.random() < 0.5, r.random() < 0.5, f"{r.randrange(50):02}", r.randrange(3)) for i in range(800)]
    df = spark.createDataFrame(rows, "key long, at long, evaluated boolean, success boolean, ts string, shard long").repartition(4)
    want = []
    for key in {x[0] for x in rows}:
        best = None
        for place, (_, at, e, s, ts, shard) in enumerate(sorted(x for x in rows if x[0] == key), 1):
            if best and best[0] and e and best[3] != s:
                want.append((key, place, "cross_shard" if best[4] != shard else "re_execution"))
            best = max(best, (e, ts, -at, s, shard)) if best else (e, ts, -at, s, shard)
    got = merge.conflicts(df, ["key"], "evaluated", "success", "ts", "shard", [F.col("at")]).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50


def test_nearest_ranks_of_one_hot_key(spark, many_blocks):
    r = random.Random(4)
    rows = [("hot", r.random() * 100) for _ in range(2000)] + [(k, float(r.randrange(9))) for k in "abc" for _ in range(50)] + [("one", 3.5), ("none", None), ("hot", None)]
    got = {(x.key, x.percent): x.value for x in nearest_ranks(spark.createDataFrame(rows, "key string, v double"), ["key"], "v", (0, 40, 50, 99, 100)).collect()}
    for key in ("hot", "a", "b", "c", "one"):
        mine = sorted(v for k, v in rows if k == key and v is not None)
        for p in (0, 40, 50, 99, 100):
            assert got.pop((key, p)) == mine[min(len(mine) - 1, round(p / 100 * (len(mine) - 1)))]
    assert not got
