"""Event windows. The same functions take a stream (with a watermark) or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.tables import table

LATE = "2 hours"


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE) if events.isStreaming else events


def _flat(g: DataFrame, *rest: str) -> DataFrame:
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *rest)


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    return _flat(_timed(events).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")), "event_type", "n", "value")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return _flat(_timed(events).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")), "n")


def sessions(events: DataFrame, gap: str = "60 minutes") -> DataFrame:
    """Runs of a user's events without a pause of `gap` or more."""
    g = _timed(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_deliveries(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each key once; in a stream, repeats within the watermark are dropped."""
    return _timed(events).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there (availableNow) into a table in memory."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def tumbling_windows(spark, root):
    return tumbling(table(spark, root, "events"))


def sliding_windows(spark, root):
    return sliding(table(spark, root, "events"))


def session_windows(spark, root):
    return sessions(table(spark, root, "events"))


QUERIES = {"tumbling_windows": tumbling_windows, "sliding_windows": sliding_windows, "session_windows": session_windows}
ORACLE = {
    "tumbling_windows": "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS \"end\", event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2, 3",
    "sliding_windows": """WITH b AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS h FROM events), w AS (SELECT h AS start FROM b UNION ALL SELECT h - INTERVAL 1 hour FROM b)
      SELECT start, start + INTERVAL 2 hours AS "end", count(*) AS n FROM w GROUP BY 1""",
    "session_windows": """WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 60 minutes THEN 0 ELSE 1 END AS new FROM events),
      g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
      SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 60 minutes AS "end", count(*) AS n FROM g GROUP BY user_id, k""",
}
