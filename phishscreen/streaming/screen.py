"""Screening mail as it arrives (T1-T4). State is bounded by watermarks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.screen import screen
from ..sources.sinks import logged, write_batch


def once(messages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drops messages whose id came before within the delay; messages without an id are told apart by their content."""
    content = F.concat(F.lit("#"), F.sha2(F.to_json(F.struct(F.map_entries("headers").alias("h"), "bodies")), 256))
    key = F.when(F.coalesce("header_message_id", F.lit("")) != "", F.col("header_message_id")).otherwise(content)
    return messages.withColumn("__id", key).withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["__id"]).drop("__id")


def batch_record(spark: SparkSession, checkpoint: str, batch: int) -> tuple[str, int]:
    """The id of a checkpoint's stream and the time of a batch in milliseconds. Both are on record before the batch runs, and
    are the same when it runs again, on whatever day."""
    found = {}
    for row in spark.read.text([f"{checkpoint}/metadata", f"{checkpoint}/offsets/{batch}"]).collect():  # a few lines
        if row.value.startswith("{"):
            found = json.loads(row.value) | found
    return found["id"], found["batchTimestampMs"]


def screen_stream(messages: DataFrame, log_path: str, checkpoint: str, delay: str = "1 day", **options):
    """A writer that screens each micro-batch and puts its verdicts into the log; start it with its start(). A batch that
    runs again after a failure replaces what it had written: its folder is named by stream and batch, and its rows bear the
    time of the batch rather than that of the run, so each message is logged once."""

    def each(batch: DataFrame, number: int) -> None:
        stream, at = batch_record(batch.sparkSession, checkpoint, number)
        write_batch(logged(screen(batch, **options), at=F.timestamp_millis(F.lit(at))), log_path, stream, number)

    return once(messages, delay).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def daily_counts(verdicts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counters of each day; rows later than the delay are dropped."""
    part = lambda c: F.count(F.when(c, 1))
    v = F.col("verdict")
    out = verdicts.withWatermark("logged_at", delay).groupBy(F.window("logged_at", "1 day").alias("w"))
    return out.agg(F.count("*").alias("total"), part(v == "spam").alias("spam"), part(v == "suspect").alias("suspect"), part(F.col("path").isin("rules+model", "failed")).alias("model_calls")).select(F.to_date("w.start").alias("day"), "total", "spam", "suspect", "model_calls")


def repeat_senders(verdicts: DataFrame, delay: str = "1 day", window: str = "7 days") -> DataFrame:
    """T4: sender domains of spam in each window with their counts; readers keep those of two or more."""
    spam = verdicts.where((F.col("verdict") == "spam") & (F.col("from_domain") != "")).withWatermark("logged_at", delay)
    return spam.groupBy(F.window("logged_at", window).alias("w"), "from_domain").agg(F.count("*").alias("n")).select(F.col("w.start").alias("since"), "from_domain", "n")
