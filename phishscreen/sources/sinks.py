"""Writing results (K1-K3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSV_COLUMNS = ("loggedAt", "date", "verdict", "score", "localScore", "modelScore", "path", "author", "fromDomain", "subject", "brands", "ruleHits", "applied", "source", "error")


def logged(verdicts: DataFrame, source: str = "auto", at: Column | None = None) -> DataFrame:
    out = verdicts if "source" in verdicts.columns else verdicts.withColumn("source", F.lit(source))
    return out.withColumn("logged_at", at if at is not None else F.current_timestamp()).withColumn("logged_date", F.to_date("logged_at"))


#: Folders of the log: the day, then who wrote it (the id of a stream, or a name), then the number of its batch.
LOG_FOLDERS = ("logged_date", "stream", "batch")


def _placed(verdicts: DataFrame, stream: str, batch: int) -> DataFrame:
    rows = verdicts.drop("stream", "batch").withColumns({"stream": F.lit(stream), "batch": F.lit(batch)})
    return rows.repartition("logged_date", F.pmod(F.xxhash64("msg_key"), F.lit(8)))


def append_log(verdicts: DataFrame, path: str, stream: str = "by hand") -> None:
    """K1: appends to the log, one folder a day; rows of a day meet in few files. A second call appends a second time."""
    _placed(verdicts, stream, 0).write.mode("append").partitionBy(*LOG_FOLDERS).parquet(path)


def write_batch(verdicts: DataFrame, path: str, stream: str, batch: int) -> None:
    """K1 for streams: the same batch written again replaces what it wrote before and nothing else. All its rows have to have the
    logged_date that they had then."""
    writer = _placed(verdicts, stream, batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*LOG_FOLDERS).parquet(path)


def csv_rows(log: DataFrame) -> DataFrame:
    """K2: the columns of the export as text; lists joined by '/', line breaks as blanks."""
    clean = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\r?\n", " ")
    values = (F.col("logged_at"), F.col("date"), F.col("verdict"), F.col("score"), F.col("local_score"), F.col("model_score"), F.col("path"), F.col("author"), F.col("from_domain"), F.col("subject"), F.array_join("brands", "/"), F.array_join(F.transform("rule_hits", lambda h: h["id"]), "/"), F.array_join("planned_actions", "/"), F.col("source"), F.col("error"))
    return log.select(*[clean(v).alias(n) for n, v in zip(CSV_COLUMNS, values, strict=True)])


def csv_lines(log: DataFrame) -> DataFrame:
    """Each row as one line of CSV, all values quoted."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    return csv_rows(log).select(F.concat_ws(",", *[quoted(c) for c in CSV_COLUMNS]).alias("value"))


def write_csv(log: DataFrame, path: str, spreadsheet: bool = False) -> None:
    """spreadsheet: a byte order mark, an unquoted header and one file, for exports small enough to open by hand."""
    if spreadsheet:
        head = log.sparkSession.createDataFrame([("﻿" + ",".join(CSV_COLUMNS),)], "value string")
        lines = head.withColumn("k", F.lit(0)).unionByName(csv_lines(log).withColumn("k", F.lit(1)))
        lines.coalesce(1).sortWithinPartitions("k").select("value").write.option("lineSep", "\r\n").text(path)
    else:
        csv_rows(log).write.option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def write_evaluation(run: DataFrame, path: str) -> None:
    """K3."""
    run.write.mode("append").partitionBy("run_id").parquet(path)
