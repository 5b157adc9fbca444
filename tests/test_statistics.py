"""Estimators and resampling kernels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge.functions import estimators as E
from sparkgauge.operators import resample as R
from sparkgauge.operators import select as S
from sparkgauge.plans import QUERIES
from sparkgauge.plans import kernels, statistics

import plain


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_pass_at_k_edges(spark):
    k = lambda n, c, k: E.pass_at_k(F.lit(n), F.lit(c), k)
    assert one(spark, k(8, 0, 8), k(8, 8, 1), k(8, 1, 8)) == (0, 1, 1)
    rising = one(spark, *[k(8, 2, i) for i in range(1, 9)])
    assert list(rising) == sorted(rising) and 0 < one(spark, k(8, 1, 2))[0] < 1
    with pytest.raises(Exception, match="exceeds"):
        one(spark, k(4, 1, 8))


def test_mcnemar_tail(spark):
    p = lambda a, b: E.binomial_two_sided(F.lit(a), F.lit(b))
    got = one(spark, p(0, 0), p(2, 1), p(12, 0), p(5000, 5200))
    assert got[0] == 1 and got[1] == pytest.approx(1) and got[2] == pytest.approx(2 / 2**12) and 0.04 < got[3] < 0.06


def test_nearest_rank_rounds_half_to_even(spark):
    v = F.array(*map(F.lit, (4.0, 1.0, 3.0, 2.0)))
    assert one(spark, E.nearest_rank(v, 50), E.nearest_rank(v, 90)) == (3.0, 4.0)
    assert np.isnan(one(spark, E.nearest_rank(F.array().cast("array<double>"), 50))[0])


def test_bootstrap_interval(spark):
    lo, hi = plain.interval(np.array([0, 0.25, 0.5, 0.75, 1] * 8))
    assert lo < 0.5 < hi and plain.interval(np.ones(20)) == (1, 1) and np.isnan(plain.interval(np.array([]))[0]) and plain.interval(np.array([0.3])) == (0.3, 0.3)
    rows = spark.createDataFrame([(g, t, (t * 7 % 5) / 4.0) for g in range(3) for t in range(40)], "g long, t long, v double")
    a, b = (sorted(map(tuple, R.bootstrap_ci(x, "g", "t", "v", 500).collect())) for x in (rows, rows.repartition(7, F.rand(1))))
    assert a == b and all(lo <= m <= hi for _, m, lo, hi in a)


def test_paired_bootstrap_is_fine_grained(spark):
    rare = np.linspace(0.1, 1, 10)  # all of one sign: the exact p is 2 of 2^10
    mixed = rare * np.where(np.arange(10) % 3 == 0, -1, 1)
    flips = np.where((np.arange(1024)[:, None] >> np.arange(10)) & 1, 1, -1)
    exact = lambda v: (np.abs((flips * v).mean(axis=1)).round(9) >= round(abs(v.mean()), 9)).mean()
    rows = spark.createDataFrame([(g, t, float(x)) for g, v in enumerate((rare, mixed)) for t, x in enumerate(v)], "g long, t long, v double")
    a, b = (sorted(map(tuple, R.paired_bootstrap(x, "g", "t", "v").collect())) for x in (rows, rows.repartition(5, F.rand(1))))
    assert a == b
    for (_, tasks, diff, lo, hi, p), v in zip(a, (rare, mixed), strict=True):
        assert tasks == 10 and diff == pytest.approx(v.mean()) and lo < diff < hi and p == pytest.approx(round(p * 10_000) / 10_000)
        assert abs(p - exact(v)) < 5 * (exact(v) / 10_000) ** 0.5
        draws = np.random.default_rng(0).integers(0, 10, size=(10_000, 10))
        assert (lo, hi) == pytest.approx(tuple(np.percentile(v[draws].mean(axis=1), [2.5, 97.5])))


def test_replicates_over_blocks_draw_as_many_clusters_as_there_are(spark):
    rows = spark.createDataFrame([("a", t, (t * 7 % 11) / 4.0) for t in range(150)] + [(None, t, 1.0) for t in range(3)], "g string, t long, v double")
    blocks = R.in_blocks(rows, F.col("g"), "t", F.array("v", F.lit(1.0)), size=20)
    assert blocks.where("grp is null").count() <= 3 and blocks.where("grp = 'a'").count() > 5
    got = R.replicates(blocks, 2, 400, seed=3).collect()
    assert {(r.grp, r.s1) for r in got} == {("a", 150.0), (None, 3.0)} and len(got) == 802
    values = np.array([(t * 7 % 11) / 4.0 for t in range(150)])
    means = np.array([r.s0 / 150 for r in got if r.grp == "a" and r.replicate >= 0])
    assert next(r.s0 for r in got if r.grp == "a" and r.replicate < 0) == pytest.approx(values.sum())
    assert abs(means.mean() - values.mean()) < 5 * values.std() / 150**0.5 / 20 and 0.85 < means.std() / (values.std() / 150**0.5) < 1.15


def test_one_group_of_a_million_clusters(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("g"), F.col("id").alias("t"), (F.col("id") % 101).cast("double").alias("v"))
    blocks = R.in_blocks(rows, F.col("g"), "t", F.array("v", F.lit(1.0)))
    assert blocks.count() == 31 and blocks.select(F.max(F.size("stats"))).first()[0] < 40_000
    (row,) = R.bootstrap_ci(rows, "g", "t", "v", 60).collect()
    assert row.mean == pytest.approx(50, abs=0.01) and 0.02 < row.hi - row.lo < 0.25 and row.lo < row.mean < row.hi


def weighted_fit(x, n, c, w):
    """One replicate in one array: standardise the draw, then Newton."""
    picked = np.repeat(x, w.astype(int), axis=0)
    sd = picked.std(axis=0)
    z = np.column_stack([np.ones(len(x)), (x - picked.mean(axis=0)) / np.where(sd > 0, sd, 1)])
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-8) * n * w
        step = np.linalg.solve((z * v[:, None]).T @ z + 1e-6 * np.eye(len(beta)), z.T @ (w * (c - n * p)) - 1e-6 * beta)
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    return beta


def test_logistic_intervals_are_those_of_single_fits(spark):
    rows = [(t, float(t % 7), float(t * 5 % 13), 20 + t % 4, 4 + t % 7 + t % 3) for t in range(60)]
    counts = spark.createDataFrame(rows, "t long, x double, z double, n long, c long")
    got = {r.term: r for r in R.logistic_ci(spark, counts.repartition(5), "t", ["x", "z"]).collect()}
    x, n, c = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    weights = np.concatenate(list(R.draws(0, [60], 400, 0, np.random.default_rng([0, 0]))))
    assert weights.shape == (400, 60) and (weights.sum(1) == 60).all()
    fits = np.array([weighted_fit(x, n, c, w) for w in weights])
    low, high = np.quantile(fits, [0.025, 0.975], axis=0)
    for k, (term, beta) in enumerate(zip(("intercept", "x", "z"), weighted_fit(x, n, c, np.ones(60)), strict=True)):
        assert np.abs(np.array([got[term].beta, got[term].lo, got[term].hi]) - [beta, low[k], high[k]]).max() < 1e-8
    many = {r.term: r for r in R.logistic_ci(spark, counts, "t", ["x", "z"], 50, size=9).collect()}
    assert all(abs(many[t].beta - got[t].beta) < 1e-8 and many[t].lo < many[t].beta < many[t].hi for t in got)


def test_registered_resampling_is_that_of_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    groups: dict = {}
    for r in statistics.cells(spark, sf).collect():
        groups.setdefault(r.provider, []).append((r.task_id, r.rate))
    got = {r.provider: r for r in QUERIES["bootstrap_ci"](spark, sf).collect()}
    assert got.keys() == groups.keys()
    for g, rows in groups.items():
        v = np.array([x for _, x in sorted(rows)])
        assert (got[g]["mean"], got[g].lo, got[g].hi) == pytest.approx((v.mean(), *plain.interval(v)), abs=1e-9)
    cells = statistics.style_grid(spark, sf).collect()
    grid = np.full((20, max(r.style for r in cells) + 1), np.nan)
    for r in cells:
        grid[r.topology, r.style] = r.rate
    grid = grid[~np.isnan(grid).all(axis=1)][:, ~np.isnan(grid).all(axis=0)]
    rng = np.random.default_rng(0)
    drawn = np.array([plain.components(grid[rng.integers(0, len(grid), len(grid))]) for _ in range(2000)])
    parts = {r.part: r for r in QUERIES["variance_ci"](spark, sf).collect()}
    for k, part in enumerate(("topology", "style", "interaction")):
        want = (plain.components(grid)[k], *np.quantile(drawn[:, k], [0.025, 0.975]))
        assert (parts[part].share, parts[part].lo, parts[part].hi) == pytest.approx(want, abs=1e-9)
    counts = sorted(tuple(r) for r in kernels._design(spark, sf).select("task_id", "size", "length_px", "n", "c").collect())
    x, n, c = np.array([r[1:3] for r in counts], float), np.array([r[3] for r in counts]), np.array([r[4] for r in counts])
    beta = weighted_fit(x, n, c, np.ones(len(counts)))
    fit = {r.term: r.beta for r in QUERIES["logistic_ci"](spark, sf).collect()}
    assert [fit[t] for t in ("intercept", "size", "length_px")] == pytest.approx(list(beta), abs=1e-8)


def test_logistic_recovers_known_effects(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=2000)
    y = rng.random(2000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))
    assert np.abs(plain.logistic(np.column_stack([np.ones(2000), x]), y.astype(float)) - [0.5, 1.5]).max() < 0.25
    rows = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, y, strict=True)], "x double, y boolean")
    fit = {r.term: r.beta for r in R.logistic_fit(spark, rows, ["x"], "y").collect()}
    assert abs(fit["intercept"] - 0.5) < 0.25 and abs(fit["x"] - 1.5) < 0.25


def test_variance_shares():
    rng = np.random.default_rng(1)
    rows, cols = np.repeat(rng.random((10, 1)), 4, 1), np.repeat(rng.random((1, 4)), 10, 0)
    board = np.indices((10, 4)).sum(axis=0) % 2
    assert plain.components(rows)[0] > 0.95 and plain.components(cols)[1] > 0.95 and plain.components(board.astype(float))[2] > 0.9


def test_selection_meets_its_constraints():
    rows = [(f"t{i}", ("easy", "medium", "hard")[i % 3], f"f{i % 8}", f"a{i % 20}") for i in range(400)]
    spec = S.SelectionSpec(archetype_floor=3)
    ids = S.select_ids(rows, spec, 5)
    by = {r[0]: r for r in rows}
    count = lambda at: {v: sum(by[i][at] == v for i in ids) for v in {r[at] for r in rows}}
    assert len(ids) == 100 and count(1) == spec.tiers and set(count(2).values()) <= {12, 13} and min(count(3).values()) >= 3
    assert ids == S.select_ids(rows[::-1], spec, 5) != S.select_ids(rows, spec, 6)
    with pytest.raises(ValueError):
        S.select_ids(rows[:60], spec)
