"""Evaluation runs stored for joining.

A run's last record of each message is settled when the run is stored, in a table bucketed and sorted by message. Two stored runs
with the same number of buckets are joined bucket by bucket: comparing a new run with any earlier one shuffles and ranks nothing.
"""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import PAIR_FIELDS, last_by_message

#: A bucket is read by one task, so its share of a run has to fit there: 200 buckets serve some 10^9 records.
BUCKETS = 200


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, under spark.checkpoint.dir; in a temporary one where that is unset and the master is
    local. Nothing deletes it before the folder above is deleted."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{top or tempfile.mkdtemp(prefix='spark-scratch-')}{os.sep}{uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, written once to a new folder and read from there, for several passes. Cached ones would be made anew by each
    executor that is asked for them before it knows where they are."""
    folder = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def store_run(run: DataFrame, table: str, buckets: int = BUCKETS, path: str | None = None) -> None:
    """K3: replaces the table by the last record of each message of the run that has a model's score. Empty runs make empty
    tables. path: where the table's files lie, if not in the warehouse."""
    rows = last_by_message(run).select("message", *PAIR_FIELDS).repartition(buckets, "message").sortWithinPartitions("message")
    writer = rows.write.mode("overwrite").bucketBy(buckets, "message").sortBy("message")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def compare_stored(spark: SparkSession, old: str, new: str) -> DataFrame:
    """E16 over stored runs: the rows of evaluate.compare_runs. Runs with other numbers of buckets are joined with a shuffle. The
    join is by sorting, as a hash join would send or build a whole side."""
    side = lambda name, p: spark.table(name).select("message", *[F.col(c).alias(f"{p}_{c}") for c in PAIR_FIELDS])
    return side(new, "new").hint("merge").join(side(old, "old"), "message")
