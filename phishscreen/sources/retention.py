"""Keeping the log small (A14, K1): whole days are dropped as folders, and no more than one day is rewritten.

A day is rewritten beside the log, in a folder that readers skip, and then takes its place. A run that is lost in between is
finished by the next one. Run these jobs when no stream writes into the days they touch: compaction is meant for days that are over.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import LOG_FOLDERS

_BESIDE = "_rewritten"


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def day_counts(spark: SparkSession, path: str) -> list[tuple[datetime.date, int]]:
    """(day, rows), the newest day first. Row counts come from the files' footers."""
    counts = spark.read.parquet(path).groupBy("logged_date").count()
    return sorted(((r["logged_date"], r["count"]) for r in counts.collect()), reverse=True)  # one row a day


def drop_days(spark: SparkSession, path: str, days) -> None:
    fs, at = _files(spark, path)
    for day in days:
        fs.delete(at(f"{path}/logged_date={day}"), True)


def _replace_day(spark: SparkSession, path: str, day: datetime.date, rows: DataFrame | None = None) -> None:
    """Puts rows in the place of a day, or finishes what an earlier run began."""
    fs, at = _files(spark, path)
    new, old = f"{path}/{_BESIDE}/{day}", f"{path}/logged_date={day}"
    if rows is not None:
        rows.drop("logged_date").write.mode("overwrite").partitionBy(*LOG_FOLDERS[1:]).parquet(new)
    fs.delete(at(old), True)
    if not fs.rename(at(new), at(old)):
        raise OSError(f"{new} could not take the place of {old}")
    fs.delete(at(f"{old}/_SUCCESS"), False)


def finish(spark: SparkSession, path: str) -> None:
    """Finishes rewrites whose new files were all written; others are done away with."""
    fs, at = _files(spark, path)
    beside = at(f"{path}/{_BESIDE}")
    for found in fs.listStatus(beside) if fs.exists(beside) else ():
        day = found.getPath().getName()
        if fs.exists(at(f"{path}/{_BESIDE}/{day}/_SUCCESS")):
            _replace_day(spark, path, day)
        else:
            fs.delete(found.getPath(), True)


def keep_newest(spark: SparkSession, path: str, n: int) -> dict[str, list]:
    """A14 for the whole log: its newest n rows stay. Days beyond them go as folders, the day at the border is rewritten, all
    others keep their files. Says which days were dropped and rewritten."""
    finish(spark, path)
    dropped, rewritten, left = [], [], n
    for day, rows in day_counts(spark, path):
        if left <= 0:
            dropped.append(day)
        elif rows > left:
            newest = spark.read.parquet(path).where(F.col("logged_date") == F.lit(day)).orderBy(F.desc("logged_at"), "msg_key").limit(left)
            _replace_day(spark, path, day, newest)
            rewritten.append(day)
        left -= rows
    drop_days(spark, path, dropped)
    return {"dropped": dropped, "rewritten": rewritten}


def compact(spark: SparkSession, path: str, day: datetime.date, files: int = 1) -> None:
    """K1: the batches of a day that is over as so many files."""
    finish(spark, path)
    rows = spark.read.parquet(path).where(F.col("logged_date") == F.lit(day))
    _replace_day(spark, path, day, rows.withColumns({"stream": F.lit("compacted"), "batch": F.lit(0)}).repartition(files))
