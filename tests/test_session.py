"""Registered SQL functions."""

from __future__ import annotations

import pytest

from sparkgauge.functions import session


def test_functions_from_sql(spark):
    session.register(spark)
    session.register(spark)
    row = spark.sql("SELECT pass_at_k(8, 0, 8) AS a, pass_at_k(8, 1, 8) AS b, pass_at_k(10, 3, 2) AS c, composite_key(NULL, 'm', 3) AS k, json_tool_call(NULL, 'x <call>{\"k\":1}</call>', NULL) AS t, json_tool_call(NULL, NULL, NULL) AS n").first()
    assert (row.a, row.b, row.k, row.t, row.n) == (0, 1, "/m/3", '{"k":1}', None) and row.c == pytest.approx(1 - 7 / 10 * 6 / 9)
    with pytest.raises(Exception, match="exceeds"):
        spark.sql("SELECT pass_at_k(4, 1, 8)").collect()


def test_points_as_a_table(spark):
    session.register(spark)
    rows = [(1, '{"points": [{"x": 0, "y": 1.5}, {"x": true, "y": 0}, [1], {"x": 2}, {"x": 3, "y": 4}]}'), (2, "nonsense"), (3, None), (4, '{"points": 7}')]
    df = spark.createDataFrame(rows, "id long, submission string")
    got = spark.sql("SELECT id, p.* FROM {df}, LATERAL tool_points(submission) p", df=df).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0.0, 1.5), (1, 4, 3.0, 4.0)]
