"""Structured Streaming over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, with `at`, a timestamp that takes watermarks."""
    # a file source wants a folder or a pattern, not the name of one file
    return spark.readStream.schema(SCHEMA).parquet(f"{sf_dir}/events.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Daily counts by type."""
    g = events.withWatermark("at", late).groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("day"), "event_type", "n")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "6 hours") -> DataFrame:
    """Sessions of each user: events no farther apart than the gap."""
    g = events.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it comes within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type")


def latest(events: DataFrame) -> DataFrame:
    """Last writer wins for each user and type."""
    return events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


def run(stream: DataFrame, spark: SparkSession, name: str, mode: str) -> DataFrame:
    """All that is available now, written batch by batch to the shared folder; complete
    results replace one another, appended ones add up."""
    out = new_path(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{0 if mode == 'complete' else number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, f"{name}-log")).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/*")


def sm2_states(events: DataFrame) -> DataFrame:
    """Spaced-repetition states kept from batch to batch: (user_id, n, ease, days,
    repetitions) after each batch's events of a user; n counts events so far.

    The state is four numbers a user; a batch's rows of a user are streamed by Spark in
    frames and put in order before they are folded.
    """
    import pandas as pd

    from ..operators.state import sm2

    def run(key, frames, state):
        n, *s = state.get if state.exists else (0, 2.5, 0.0, 0)
        s = tuple(s)
        rows = pd.concat([f[["ts", "event_id", "event_type"]] for f in frames]).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            s = sm2(s, kind != "error")
            n += 1
        state.update((n, float(s[0]), float(s[1]), int(s[2])))
        yield pd.DataFrame([(key[0], n, float(s[0]), float(s[1]), int(s[2]))], columns=["user_id", "n", "ease", "days", "repetitions"])

    out, held = "user_id long, n long, ease double, days double, repetitions long", "n long, ease double, days double, repetitions long"
    return events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(run, out, held, "update", "NoTimeout")
