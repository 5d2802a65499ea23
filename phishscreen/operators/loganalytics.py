"""Analytics of the verdict log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.dictionaries import FREEMAIL


def author_address(author):
    inner = F.regexp_extract(t.text(author), "<([^>]+)>", 1)
    return F.lower(t.trim(F.when(inner != "", inner).otherwise(t.text(author))))


def block_candidates(verdicts: DataFrame, least: int = 2, excluded: DataFrame | None = None, freemail=FREEMAIL) -> DataFrame:
    """A10: (kind, value, n, subject) of senders of at least max(2, least) spam messages, with their newest subject that is
    not empty. excluded: (value) domains and addresses already listed or one's own; providers open to anybody are left out."""
    spam = verdicts.where("verdict = 'spam'").select(F.lower(t.text(F.col("from_domain"))).alias("domain"), author_address(F.col("author")).alias("address"), "subject", "logged_at", "msg_key")
    spam = spam.where((F.col("domain") != "") & ~F.col("domain").isin(*freemail))
    if excluded is not None:
        known = excluded.select(F.lower("value").alias("value")).distinct()
        spam = spam.join(known.withColumnRenamed("value", "domain"), "domain", "left_anti").join(known.withColumnRenamed("value", "address"), "address", "left_anti")
    newest = F.max_by(F.when(F.col("subject") != "", F.col("subject")), F.when(F.col("subject") != "", F.struct("logged_at", "msg_key")))

    def by(kind: str) -> DataFrame:
        return spam.where(F.col(kind) != "").groupBy(F.lit(kind).alias("kind"), F.col(kind).alias("value")).agg(F.count("*").alias("n"), F.coalesce(newest, F.lit("")).alias("subject"))

    return by("domain").unionByName(by("address")).where(F.col("n") >= max(2, least)).orderBy(F.desc("n"), "kind", "value")


def summary(verdicts: DataFrame) -> DataFrame:
    """A11."""
    part = lambda c: F.count(F.when(c, 1))
    v = F.col("verdict")
    return verdicts.agg(F.count("*").alias("total"), part(v == "spam").alias("spam"), part(v == "suspect").alias("suspect"), part(v == "ham").alias("ham"), part(F.col("path").isin("rules+model", "failed")).alias("model_calls"))


def daily(verdicts: DataFrame) -> DataFrame:
    """A12."""
    return verdicts.groupBy(F.to_date("logged_at").alias("day")).agg(F.count("*").alias("total"), F.count(F.when(F.col("verdict") == "spam", 1)).alias("spam"))


def recent(verdicts: DataFrame, n: int = 20) -> DataFrame:
    """A13."""
    return verdicts.orderBy(F.desc("logged_at"), "msg_key").limit(n)


def repeat_alerts(verdicts: DataFrame, least: int = 2, hours: int = 168) -> DataFrame:
    """T4 over a log: (from_domain, hour, n, subject), one row for each hour in which the spam of a domain in the hours that end
    with it comes to least or more while those before it had less; n is their count, subject the newest of the hour. The log is
    counted by hours first, so that a domain has one row an hour however much it sends. streaming.alerts has it live."""
    spam = verdicts.where((F.col("verdict") == "spam") & (F.col("from_domain") != "") & F.col("logged_at").isNotNull()).withColumn("logged_at", F.col("logged_at").cast("timestamp"))
    hour = F.floor(F.unix_millis("logged_at") / 3_600_000).cast("bigint")
    counted = spam.groupBy("from_domain", hour.alias("nth")).agg(F.count("*").alias("n"), F.max(F.struct("logged_at", t.text(F.col("subject")).alias("subject")))["subject"].alias("subject"))
    earlier = Window.partitionBy("from_domain").orderBy("nth").rangeBetween(1 - hours, -1)
    out = counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    out = out.where((F.col("before") < least) & (F.col("before") + F.col("n") >= least))
    return out.select("from_domain", F.timestamp_seconds(F.col("nth") * 3600).alias("hour"), (F.col("before") + F.col("n")).alias("n"), "subject")


def retained(verdicts: DataFrame, n: int, mailbox: str = "source_path") -> DataFrame:
    """The newest n rows of each mailbox. The rank limit is pushed below the shuffle, so a large mailbox sends n rows a task."""
    newest = Window.partitionBy(mailbox).orderBy(F.desc("logged_at"), "msg_key")
    return verdicts.withColumn("__rank", F.row_number().over(newest)).where(F.col("__rank") <= n).drop("__rank")
