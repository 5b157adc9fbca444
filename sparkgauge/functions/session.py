"""The library's functions under SQL names of a session: register(spark) once, and spark.sql() knows them.

Scalar ones are SQL expressions that Spark puts in place of their calls, so they run in generated code like any other; the
table function reads one JSON text a call.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Name, parameters, result and expression of each scalar function.
SCALARS = (
    ("pass_at_k", "n BIGINT, c BIGINT, k INT", "DOUBLE", "CASE WHEN n < k THEN raise_error('k exceeds the attempts') WHEN n - c < k THEN 1D ELSE 1D - aggregate(sequence(0, k - 1), 1D, (a, i) -> a * CAST(n - c - i AS DOUBLE) / CAST(n - i AS DOUBLE)) END"),
    ("json_tool_call", "arguments STRING, said STRING, blocks STRING", "STRING", "coalesce(get_json_object(arguments, '$.arguments'), nullif(regexp_extract(said, '<call>(.*?)</call>', 1), ''), to_json(get(filter(from_json(blocks, 'array<struct<type:string,input:map<string,string>>>'), b -> b.type = 'tool_use' AND b.input IS NOT NULL), 0).input))"),
    ("composite_key", "provider STRING, task STRING, trial BIGINT", "STRING", "concat_ws('/', coalesce(provider, ''), coalesce(task, ''), coalesce(trial, 0))"),
)


@F.udtf(returnType="i int, x double, y double")
class ToolPoints:
    """The usable points of a submission's JSON, in order: those whose x and y are numbers. Anything else gives no row."""

    def eval(self, submission: str) -> Iterator[tuple[int, float, float]]:
        try:
            points = json.loads(submission or "null")["points"]
        except (ValueError, TypeError, KeyError):
            return
        for i, p in enumerate(points if isinstance(points, list) else []):
            if isinstance(p, dict) and all(isinstance(p.get(k), (int, float)) and not isinstance(p.get(k), bool) for k in "xy"):
                yield i, float(p["x"]), float(p["y"])


def register(spark: SparkSession) -> None:
    """Make pass_at_k, json_tool_call, composite_key and the table function tool_points known to the session; again is fine."""
    for name, parameters, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("tool_points", ToolPoints)
