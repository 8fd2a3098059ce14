"""Structured Streaming queries, run to the end of what there is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partwise.plans.lineage import Scratch
from partwise.queries.common import rounded, table
from partwise.streaming import status


def _drain(spark: SparkSession, sf: str, make, tag: str) -> DataFrame:
    """Stream the events table through ``make`` in complete mode; what the last batch wrote is the result."""
    s = Scratch(spark, tag)
    source = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out: list[DataFrame] = []

    def keep(batch: DataFrame, _: int) -> None:
        out[:] = [s.write(batch)]

    q = make(source).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{s.base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return out[0] if out else spark.createDataFrame([], make(table(spark, sf, "events")).schema)


def stream_latest_states(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each user."""
    return _drain(spark, sf, lambda e: status.latest_states(e.select(F.col("user_id").alias("identity"), F.col("event_id").alias("event_index"), "event_type", F.col("ts").alias("at"))), "latest")


def stream_windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events and summed values per day and type."""
    return rounded(_drain(spark, sf, lambda e: status.windowed_counts(e.select(F.col("ts").cast("timestamp").alias("at"), "event_type", "value")), "windows"), 2)


def _arriving(spark: SparkSession, parts: list[DataFrame], make, tag: str) -> DataFrame:
    """Parts that arrive one after the other, streamed in append mode by one query that is stopped and started again between them; all that it ever gave."""
    s = Scratch(spark, tag)
    out: list[DataFrame] = []
    for part in parts:
        part.write.mode("append").parquet(f"{s.base}/in")
        source = spark.readStream.schema(part.schema).parquet(f"{s.base}/in")
        q = make(source).writeStream.outputMode("append").foreachBatch(lambda batch, _: out.append(s.write(batch))).option("checkpointLocation", f"{s.base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return reduce(DataFrame.unionByName, out)


def stream_closed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Days that the watermark has closed: a tenth of the events arrives after the others, and what is too late by then doesn't count."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    parts = [e.filter("event_id % 10 <> 0"), e.filter("event_id % 10 = 0")]
    return rounded(_arriving(spark, parts, lambda x: status.windowed_counts(x.drop("event_id")), "closed"), 2)


def stream_chain_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps in users' chains of events, from which every 97th event is missing; later events of a chain arrive in a second part."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("identity"), F.row_number().over(w).cast("long").alias("event_index"), "event_id").filter("event_id % 97 <> 0").drop("event_id")
    return _arriving(spark, [e.filter("event_index <= 20"), e.filter("event_index > 20")], status.chain_gaps, "gaps")


def stream_free_latest_states(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a table query, by a window."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts", F.row_number().over(w).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n_events"))
    return e.filter("k = 1").select(F.col("user_id").alias("identity"), F.col("event_id").alias("event_index"), "event_type", F.col("ts").alias("at"), "n_events")


QUERIES = {f.__name__: f for f in (stream_latest_states, stream_windowed_counts, stream_free_latest_states, stream_closed_windows, stream_chain_gaps)}
_LATEST = 'SELECT user_id AS identity, max(event_id) AS event_index, arg_max(event_type, event_id) AS event_type, arg_max(ts, event_id) AS "at", count(*) AS n_events FROM events GROUP BY user_id'
SQL = {
    "stream_latest_states": _LATEST,
    "stream_free_latest_states": _LATEST,
    "stream_closed_windows": """WITH e AS (SELECT * FROM events WHERE event_id % 10 <> 0), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM e)
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n_events, round(sum(value), 2) AS value FROM e, m WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= mark GROUP BY ALL""",
    "stream_chain_gaps": """WITH n AS (SELECT user_id::VARCHAR AS identity, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_index FROM events),
l AS (SELECT identity, event_index, coalesce(lag(event_index) OVER (PARTITION BY identity ORDER BY event_index), 0) + 1 AS expected FROM n WHERE event_id % 97 <> 0) SELECT * FROM l WHERE event_index <> expected""",
    "stream_windowed_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n_events, round(sum(value), 2) AS value FROM events GROUP BY ALL",
}
