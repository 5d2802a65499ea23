"""Calibration on labelled, scored messages (A1-A9). All sweeps start from one small table of (label, score, rule bits)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dictionaries import FREEMAIL
from ..plans.settings import Settings
from .features import host_suffixes
from .rules import IDS, RULES, WEIGHTS, bitmask, hit_ids

LABELS = ("ham", "spam")


def cube(scored: DataFrame) -> DataFrame:
    """(label, score, bits, n): what A1, A2, A3, A7 and A8 need of all messages, after one pass with partial sums."""
    return scored.where(F.col("label").isin(*LABELS)).groupBy("label", "score", bitmask(F.col("rule_hits")).alias("bits")).agg(F.count("*").alias("n"))


def _labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in LABELS], "label string")


def histogram(cube: DataFrame) -> DataFrame:
    """A1: 11 buckets for each label, empty ones too."""
    spark = cube.sparkSession
    grid = _labels(spark).crossJoin(F.broadcast(spark.range(11).select(F.col("id").cast("int").alias("bucket"))))
    counts = cube.groupBy("label", F.least(F.lit(10), F.floor(F.col("score") / 10)).cast("int").alias("bucket")).agg(F.sum("n").alias("n"))
    return grid.join(counts, ["label", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def outcomes(cube: DataFrame, settings: Settings | None = None) -> DataFrame:
    """A2: messages, caught, gray and below of each label; for ham, caught is false positives."""
    s = settings or Settings()
    part = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = cube.groupBy("label").agg(F.sum("n").alias("total"), part(F.col("score") >= s.spam_threshold).alias("caught"), part((F.col("score") >= s.gray_low) & (F.col("score") < s.gray_high)).alias("gray"), part(F.col("score") < s.gray_low).alias("missed"))
    share = lambda c: F.round(100 * F.col(c) / F.col("total"), 1).alias(f"{c}_pct")
    return out.select("*", share("caught"), share("gray"), share("missed"))


def rule_rates(cube: DataFrame) -> DataFrame:
    """A3: how often each rule fires, by label; all rules are listed."""
    bit = F.call_function("getbit", F.col("bits"), F.col("position")).cast("bigint")
    rules = cube.sparkSession.createDataFrame([(i, r.id, r.weight) for i, r in enumerate(RULES)], "position int, id string, weight int")
    fired = lambda label: F.sum(F.when(F.col("label") == label, bit * F.col("n")).otherwise(0)).alias(f"{label}_hits")
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0)).alias(f"{label}_total")
    out = cube.crossJoin(F.broadcast(rules)).groupBy("position", "id", "weight").agg(fired("spam"), fired("ham"), of("spam"), of("ham"))
    out = rules.join(out.drop("id", "weight"), "position", "left").fillna(0)
    pct = lambda x: F.when(F.col(f"{x}_total") > 0, F.round(100 * F.col(f"{x}_hits") / F.col(f"{x}_total"), 1)).alias(f"{x}_pct")
    return out.select("id", "weight", "spam_hits", "ham_hits", pct("spam"), pct("ham"))


def missed_sample(scored: DataFrame, n: int = 30, settings: Settings | None = None) -> DataFrame:
    """A4: the first n spam messages below the gray zone, by key."""
    s = settings or Settings()
    return scored.where((F.col("label") == "spam") & (F.col("score") < s.gray_low)).orderBy("msg_key").limit(n).select("msg_key", "score", "from_domain", "subject")


def missed_domains(scored: DataFrame, n: int = 30, settings: Settings | None = None) -> DataFrame:
    """A5: the most frequent sender domains among missed spam."""
    s = settings or Settings()
    missed = scored.where((F.col("label") == "spam") & (F.col("score") < s.gray_low))
    return missed.groupBy("from_domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from_domain").limit(n)


def false_positives(scored: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Ham over the threshold, with the rules that spoke against it."""
    s = settings or Settings()
    return scored.where((F.col("label") == "ham") & (F.col("score") >= s.spam_threshold)).select("msg_key", "score", "from_domain", hit_ids(F.col("rule_hits"), ",", positive=True).alias("against"))


def threshold_sweep(cube: DataFrame) -> DataFrame:
    """At each threshold 0-100, the messages of each label at or over it. The window runs over 101 rows a label."""
    spark = cube.sparkSession
    grid = _labels(spark).crossJoin(F.broadcast(spark.range(101).select(F.col("id").cast("int").alias("threshold"))))
    counts = cube.groupBy("label", F.col("score").alias("threshold")).agg(F.sum("n").alias("n"))
    upward = Window.partitionBy("label").orderBy(F.desc("threshold"))
    filled = grid.join(counts, ["label", "threshold"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.select("label", "threshold", F.sum("n").over(upward).alias("reached"))


def gray_sweep(cube: DataFrame, settings: Settings | None = None) -> DataFrame:
    """At each lower end of the gray zone, the messages of each label that would be asked about, and their share."""
    s = settings or Settings()
    reached = threshold_sweep(cube.where(F.col("score") < s.gray_high)).where(F.col("threshold") < s.gray_high)
    total = cube.groupBy("label").agg(F.sum("n").alias("total"))
    out = reached.join(F.broadcast(total), "label", "left")
    return out.select("label", F.col("threshold").alias("gray_low"), F.col("reached").alias("asked"), (F.col("reached") / F.coalesce("total", F.lit(1))).alias("share"))


def sender_estimate(verdicts: DataFrame, key: str) -> DataFrame:
    """A9 without a shuffle of senders: messages of spam and about how many senders they have."""
    return verdicts.where((F.col("verdict") == "spam") & (F.col(key) != "")).agg(F.count("*").alias("messages"), F.approx_count_distinct(key, 0.02).alias("senders"))


def weight_sweep(cube: DataFrame, grid: list[tuple[str, dict[str, int]]], settings: Settings | None = None) -> DataFrame:
    """Caught spam and false positives under other weights. Scores are summed from bits over distinct rule sets, not messages."""
    s = settings or Settings()
    rows = [(name, [int((WEIGHTS | changed)[k]) for k in IDS]) for name, changed in grid]
    table = cube.sparkSession.createDataFrame(rows, "setting string, weights array<int>")
    sets = cube.groupBy("label", "bits").agg(F.sum("n").alias("n"))
    points = F.aggregate(F.sequence(F.lit(0), F.lit(len(IDS) - 1)), F.lit(0), lambda a, i: a + F.call_function("getbit", F.col("bits"), i).cast("int") * F.get("weights", i))
    scored = sets.crossJoin(F.broadcast(table)).withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), points)))
    part = lambda label: F.sum(F.when((F.col("label") == label) & (F.col("score") >= s.spam_threshold), F.col("n")).otherwise(0))
    return scored.groupBy("setting").agg(part("spam").alias("caught"), part("ham").alias("false_positives"))


def drop_one_grid() -> list[tuple[str, dict[str, int]]]:
    return [("all", {}), *[(f"without {k}", {k: 0}) for k in IDS]]


def sender_repetition(verdicts: DataFrame, key: str, exclude: list[str] | None = None) -> DataFrame:
    """Senders of spam, those seen once, and the share of spam that a list of seen senders would have stopped."""
    out = verdicts.where((F.col("verdict") == "spam") & (F.col(key) != "") & ~F.col(key).isin(*(exclude or [""])))
    counts = out.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("messages"), F.count("*").alias("senders"), F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("stopped"))


def freemail_and(domains) -> list[str]:
    return [*FREEMAIL, *domains]


def exclude_under(frame: DataFrame, host: str, domains: DataFrame) -> DataFrame:
    """Rows whose host is under none of the domains; for tables of domains too large for a literal list."""
    hosts = frame.select(F.col(host).alias("listed_host")).distinct().select("listed_host", F.explode(host_suffixes(F.col("listed_host"))).alias("domain"))
    hit = hosts.join(domains.select(F.lower("domain").alias("domain")), "domain", "left_semi").select("listed_host").distinct()
    return frame.join(hit, F.col(host) == F.col("listed_host"), "left_anti")
