"""Streaming queries over what is available, each equal to its batch counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path
from ..streaming import episodes, streams
from .registry import query


def events(spark: SparkSession, sf: str) -> DataFrame:
    return streams.read_log(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> 'error'")
def stream_append_sink(spark: SparkSession, sf: str) -> DataFrame:
    return streams.drain(events(spark, sf).where(F.col("event_type") != "error").select("event_id", "user_id", "event_type", "value"), "append")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The log resumed: a key that was written is dropped. State holds the keys, in the session's state store."""
    return streams.drain(events(spark, sf).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "dedup")


@query("SELECT user_id, event_id, value, event_type = 'purchase' AS evaluated FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, ts DESC, event_id) AS rn FROM events) WHERE rn = 1")
def stream_keep_best(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("user_id", "event_id", "value", (F.col("event_type") == "purchase").alias("evaluated"), F.unix_micros("ts").alias("ts"))
    best = streams.keep_best(rows, ["user_id"], F.col("evaluated"), F.col("ts"), -F.col("event_id"))
    return streams.drain_last(best, "keep-best", ["user_id"], "ts").select("user_id", "event_id", "value", "evaluated")


@query("SELECT 'row' AS sink, event_type, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'summary', event_type, count(*) FROM events WHERE value > 10 GROUP BY ALL")
def stream_two_sinks(spark: SparkSession, sf: str) -> DataFrame:
    rows, summaries = streams.two_sinks(events(spark, sf), lambda b: b.select("event_id", "event_type"), lambda b: b.where(F.col("value") > 10).groupBy("event_type").agg(F.count("*").alias("n")), "episodes")
    a = rows.groupBy("event_type").agg(F.count("*").alias("n")).select(F.lit("row").alias("sink"), "event_type", "n")
    return a.unionByName(summaries.groupBy("event_type").agg(F.sum("n").alias("n")).select(F.lit("summary").alias("sink"), "event_type", "n"))


# engine extras, no reference counterpart


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    counts = streams.tumbling(events(spark, sf), "ts", "1 hour", "10 minutes").select(F.col("window.start").alias("start"), "event_type", "n", "total")
    return streams.drain_last(counts, "tumbling", ["start", "event_type"], "n").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions are final when the watermark has passed them; a far later event closes the last ones."""
    end = streams.read_log(spark, _closing(spark))
    end = end.withColumn("ts", F.col("ts").cast("timestamp"))
    both = events(spark, sf).select("event_id", "ts", "user_id").unionByName(end)
    found = streams.sessions(both, "ts", "2 hours", "0 seconds").select("user_id", F.col("session_window.start").alias("start"), "n")
    return streams.drain(found, "sessions").where(F.col("user_id") >= 0).withColumn("start", F.col("start").cast("timestamp_ntz"))


def _closing(spark: SparkSession) -> str:
    path = fresh_path(spark, "closing")
    spark.sql("SELECT -1L AS event_id, timestamp'2100-01-01 00:00:00' AS ts, -1L AS user_id").write.parquet(path)
    return path


SQL_EPISODES = """WITH t AS (SELECT conv_id, turn, length(text) AS far, role = 'assistant' AND length(text) % 7 = 0 AS success, length(text) % 31 = 0 AS error, length(text) % 37 > 0 AS shown FROM conversations WHERE turn < 6),
    r AS (SELECT *, CASE WHEN error THEN 'transport' WHEN success THEN 'success' WHEN turn = 5 THEN 'exhausted' WHEN NOT shown THEN 'no_overlay' END AS stop, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM t),
    f AS (SELECT *, min(CASE WHEN stop IS NOT NULL THEN turn END) OVER (PARTITION BY conv_id) AS stop_turn FROM r WHERE place = turn)
    SELECT conv_id AS episode, count(*) FILTER (NOT error) AS turns, coalesce(bool_or(stop = 'success'), false) AS solved, max(CASE WHEN stop = 'success' THEN turn END) AS first_success,
           coalesce(string_agg(far::VARCHAR, ',' ORDER BY turn) FILTER (NOT error), '') AS progress, coalesce(max(stop), 'abandoned') AS stop_reason FROM f WHERE stop_turn IS NULL OR turn <= stop_turn GROUP BY conv_id"""


def turns(rows: DataFrame) -> DataFrame:
    """Conversations as turns of episodes, a minute each."""
    size = F.length("text")
    return rows.select(F.col("conv_id").alias("episode"), F.col("turn").cast("int").alias("turn"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60).alias("ts"), (size % 31 == 0).alias("error"), ((F.col("role") == "assistant") & (size % 7 == 0)).alias("success"), (size % 37 > 0).alias("shown"), size.cast("long").alias("progress"))


@query(SQL_EPISODES)
def stream_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation as an episode of a stream; a far later turn lets the watermark pass those that never stopped."""
    path = fresh_path(spark, "closing")
    spark.sql("SELECT -1L AS episode, 1 AS turn, timestamp'2100-01-01 00:00:00' AS ts, false AS error, false AS success, false AS shown, 0L AS progress").write.parquet(path)
    both = turns(streams.read_log(spark, f"{sf}/conversations.parquet")).unionByName(streams.read_log(spark, path))
    with streams.rocks(spark):
        return streams.drain(episodes.episodes(both, "0 seconds", 3600), "episodes").where(F.col("episode") >= 0)


@query(SQL_EPISODES)
def episodes_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same episodes from the table at rest."""
    return episodes.ended(turns(spark.read.parquet(f"{sf}/conversations.parquet")))
