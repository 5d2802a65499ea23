"""Live alerts on sender domains that send spam again (T4): the streamed form of loganalytics.repeat_alerts, with the same rows
whatever the order and the batches in which verdicts come within the watermark's delay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR_MS = 3_600_000


class RepeatSender(StatefulProcessor):
    """The state of a domain is a count and the newest subject for each hour that has spam, hours + 1 of them at most beside those
    that the watermark has not passed. A timer at the end of each hour judges it; one more, when a week later no hour of the
    domain is left to count, drops it."""

    def __init__(self, least: int, hours: int):
        self.least, self.hours = least, hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        hour = T.StructType([T.StructField("hour", T.LongType())])
        value = T.StructType([T.StructField("n", T.LongType()), T.StructField("at", T.LongType()), T.StructField("subject", T.StringType())])
        self.seen = handle.getMapState("seen", hour, value)
        self.judged = handle.getValueState("judged", T.StructType([T.StructField("hour", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            newest = chunk.sort_values(["at", "subject"]).groupby("hour").agg(n=("n", "sum"), at=("at", "last"), subject=("subject", "last"))
            for hour, n, at, subject in newest.itertuples():
                place = (int(hour),)
                if self.seen.containsKey(place):
                    n0, at0, subject0 = self.seen.getValue(place)
                    n, (at, subject) = n + n0, max((at, subject), (at0, subject0))
                self.seen.updateValue(place, (int(n), int(at), subject))
                self.handle.registerTimer((int(hour) + 1) * HOUR_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() // HOUR_MS
        hours = {k[0]: v for k, v in self.seen.iterator()}
        judged = self.judged.get()[0] if self.judged.exists() else -(1 << 62)
        out = []
        for hour in sorted(h for h in hours if judged < h < passed):
            before = sum(v[0] for h, v in hours.items() if hour - self.hours < h < hour)
            n, _, subject = hours[hour]
            if before < self.least <= before + n:
                out.append((key[0], pd.Timestamp(hour * HOUR_MS, unit="ms"), before + n, subject))
            judged = hour
            self.handle.registerTimer((hour + self.hours) * HOUR_MS)
        for hour in [h for h in hours if h + self.hours <= passed and h <= judged]:
            self.seen.removeKey((hour,))
            del hours[hour]
        if hours:
            self.judged.update((judged,))
        else:
            self.judged.clear()
        if out:
            yield pd.DataFrame(out, columns=["from_domain", "hour", "n", "subject"])

    def close(self) -> None:
        pass


def repeat_alerts(verdicts: DataFrame, least: int = 2, hours: int = 168, delay: str = "1 day") -> DataFrame:
    """T4: (from_domain, hour, n, subject), one row for each hour in which the spam of a domain in the hours that end with it comes
    to least or more while the hour before it had less; n is the count of these hours, subject the newest of the hour. A row
    comes out once the watermark has passed its hour. Needs the RocksDB state store."""
    spam = verdicts.withColumn("logged_at", F.col("logged_at").cast("timestamp")).where((F.col("verdict") == "spam") & (F.col("from_domain") != "") & F.col("logged_at").isNotNull()).withWatermark("logged_at", delay)
    rows = spam.select("from_domain", "logged_at", F.floor(F.unix_millis("logged_at") / HOUR_MS).cast("bigint").alias("hour"), F.unix_micros("logged_at").alias("at"), F.coalesce("subject", F.lit("")).alias("subject"), F.lit(1).cast("bigint").alias("n"))
    return rows.groupBy("from_domain").transformWithStateInPandas(RepeatSender(least, hours), "from_domain string, hour timestamp, n bigint, subject string", "Append", "EventTime")
