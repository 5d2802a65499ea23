"""Mixing sources to target weights by entropy balancing.

Every source is to give a target number of tokens. Of all document rates w between 0 and max_rate that meet it, those
nearest to 1 in relative entropy are w = min(max_rate, exp(lambda * size)), with one dual variable lambda for each source.
Newton's method finds all lambdas at once: Spark sums gradient and curvature of each source over a table of
(source, size, count), the driver holds only the vector of lambdas. Rates become whole copies by systematic rounding in
the order of sizes, so that a source's tokens miss the target by about one document.

Null text has size 0; null is a source of its own, last in order. Repeated rows count and are taken one by one. Extra
columns are ignored by rates() and kept by apply_mix(), whatever their names. An empty table gives an empty result. A text
may be as long as a row allows; only its size is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_RATE = 2.0
#: The vector of lambdas lives on the driver and is broadcast; more sources than this are refused, none is dropped.
MAX_SOURCES = 200_000
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of equal source and size that one task ranks, about; sizes whose running sum one task takes.
CELL_ROWS, BLOCK_SIZES = 20_000, 1024
#: Pairs of source and size with more rows than that are broadcast up to so many; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
MAX_STEPS = 60
#: Starts of the systematic rounding that are tried.
STARTS = 16


def water_fill(sizes: list[int], weights: list[float], total: float, max_rate: float) -> list[float]:
    """Shares total by weight; a share above max_rate times its size stops there and the rest is shared again."""
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[i] for i in sorted(free))
        full = [i for i in free if left * weights[i] / weight > max_rate * sizes[i]]
        if not full:
            for i in free:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = max_rate * sizes[i]
            free.discard(i)
        left = total - sum(targets[i] for i in range(len(sizes)) if i not in free)
    return targets


def _rate(lam, max_rate: float):
    """lam is in units of 1 / mean size of the source; x is the size in that unit."""
    return F.least(F.lit(max_rate), F.exp(F.least(F.lit(50.0), lam * F.col("x"))))


def rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, draw), a row for each document; draw is a hash of the row."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw"))
    rows = cut(rows)
    found = rows.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.s) for r in found]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(found))], total_share * sum(sizes), max_rate)
    spec = "sid int, source string, source_size long, target double, mean double"
    table = spark.createDataFrame([(i, r.source, sizes[i], targets[i], sizes[i] / r.n if sizes[i] else 1.0) for i, r in enumerate(found)], spec)
    rows = rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["source"])).drop(table["source"])
    by_size = cut(rows.groupBy("sid", "size", "mean").agg(F.count("*").alias("n")).withColumn("x", F.col("size") / F.col("mean")))
    lams = _newton(by_size, sizes, targets, max_rate)
    dual = spark.createDataFrame([(i, x) for i, x in enumerate(lams)], "sid int, lam double")
    full = F.when(F.col("lam") == math.inf, F.lit(max_rate)).when(F.col("lam") == -math.inf, F.lit(0.0)).otherwise(_rate(F.col("lam"), max_rate))
    unit = 1_000_000_000
    # the fractions of all rows before a size, of which only what is beyond whole units counts: inside a block of sizes, then over the blocks
    wide = lambda c: c.cast("decimal(38,0)")
    before = lambda c, w: F.coalesce(F.sum(wide(c)).over(w.rowsBetween(Window.unboundedPreceding, -1)), wide(F.lit(0))) % unit
    at = by_size.join(F.broadcast(dual), "sid").withColumn("rate", F.round(full, 9)).withColumn("base", F.floor("rate").cast("long"))
    at = at.withColumn("part", F.round((F.col("rate") - F.col("base")) * unit).cast("long")).withColumn("block", F.floor(F.col("size") / BLOCK_SIZES))
    at = at.withColumn("salts", 1 + F.floor(F.col("n") / CELL_ROWS))
    at = cut(at.select("sid", "size", "rate", "base", "part", "salts", "block", "n", before(wide(F.col("part")) * F.col("n"), Window.partitionBy("sid", "block").orderBy("size")).alias("inside")))
    blocks = at.groupBy("sid", "block").agg(F.sum(wide(F.col("part")) * F.col("n")).alias("whole"))
    blocks = blocks.select("sid", "block", before(F.col("whole"), Window.partitionBy("sid").orderBy("block")).alias("ahead"))
    at = cut(at.join(blocks, ["sid", "block"]).withColumn("before", F.col("inside") + F.col("ahead")).drop("inside", "ahead", "block"))
    # rows of a frequent size are dealt out by salts, whose running sums go on from those of the size
    frequent = cut(at.where("salts > 1").select("sid", "size", "salts"))
    frequent = F.broadcast(frequent) if frequent.count() <= BROADCAST_ROWS else frequent
    rows = rows.join(frequent, ["sid", "size"], "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod("draw", "salts")))
    held = rows.where("salts is not null").groupBy("sid", "size", "salt").agg(F.count("*").alias("held"))
    held = held.withColumn("over", F.coalesce(F.sum("held").over(Window.partitionBy("sid", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = at.join(held, ["sid", "size"], "left").withColumn("salt", F.coalesce("salt", F.lit(0))).withColumn("n", F.coalesce("held", "n"))
    cells = cells.withColumn("before", ((F.col("before") + wide(F.col("part")) * F.coalesce("over", F.lit(0))) % unit).cast("long"))
    cells = cut(cells.select("sid", "size", "salt", "rate", "base", "n", "before", (F.col("before") + F.col("part") * F.col("n")).alias("after")))
    more = F.floor((F.col("after") + F.col("shift")) / F.lit(unit)).cast("long") - F.floor((F.col("before") + F.col("shift")) / F.lit(unit)).cast("long")
    # Where systematic rounding starts is free: the start that comes nearest to the target.
    starts = F.array(*[F.lit(unit * (2 * i + 1) // (2 * STARTS)) for i in range(STARTS)])
    tried = cells.withColumn("shift", F.explode(starts)).groupBy("sid", "shift").agg(F.sum((F.col("base") * F.col("n") + more) * F.col("size")).alias("took"))
    nearest = tried.join(F.broadcast(table.select("sid", "target")), "sid").groupBy("sid").agg(F.min_by("shift", F.struct(F.abs(F.col("took") - F.col("target")), "shift")).alias("shift"))
    cells = cells.join(F.broadcast(nearest), "sid").withColumn("more", more).select("sid", "size", "salt", "rate", "base", "more")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("sid", "size", "salt").orderBy("draw", "doc_id")))
    rows = rows.join(cells, ["sid", "size", "salt"]).withColumn("copies", F.col("base") + (F.col("nth") <= F.col("more")).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "draw")


def _newton(by_size: DataFrame, sizes: list[int], targets: list[float], max_rate: float) -> list[float]:
    """Newton's method on the dual of all sources at once, kept inside a bracket where a step would leave it."""
    spark = by_size.sparkSession
    lam = [math.inf if s and t >= max_rate * s * (1 - 1e-12) else -math.inf if s and t <= 0 else 0.0 for s, t in zip(sizes, targets, strict=True)]
    todo = {i for i, x in enumerate(lam) if x == 0.0 and sizes[i]}
    low, high = dict.fromkeys(todo, -math.inf), dict.fromkeys(todo, math.inf)
    for _ in range(MAX_STEPS):
        if not todo:
            break
        now = spark.createDataFrame([(i, lam[i]) for i in sorted(todo)], "sid int, lam double")
        at = by_size.join(F.broadcast(now), "sid").withColumn("w", _rate(F.col("lam"), max_rate))
        mass = F.col("n") * F.col("size")
        sums = at.groupBy("sid").agg(F.sum(mass * F.col("w")).alias("g"), F.sum(F.when(F.col("w") < max_rate, mass * F.col("w") * F.col("x")).otherwise(0.0)).alias("h")).collect()
        for r in sums:
            i, gap = r.sid, r.g - targets[r.sid]
            if abs(gap) <= 1e-9 * targets[i]:
                todo.discard(i)
                continue
            (high if gap > 0 else low)[i] = lam[i]
            step = lam[i] - gap / r.h if r.h > 0 else math.nan
            if not low[i] < step < high[i]:
                step = (low[i] + high[i]) / 2 if math.isfinite(low[i] + high[i]) else lam[i] - math.copysign(1 + abs(lam[i]), gap)
            if abs(step - lam[i]) <= 1e-12 * (1 + abs(step)):
                todo.discard(i)
            lam[i] = step
    return [round(x, 6) if math.isfinite(x) else x for x in lam]


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mixed corpus: every row of docs as often as its copies say, columns unchanged. Text is shuffled once."""
    again = Window.partitionBy("draw")
    picks = rates(docs, id_col, text_col, **options).where("copies > 0").select("draw", F.col("copies").cast("int").alias("copies"))
    picks = picks.withColumn("nth", F.row_number().over(again.orderBy(F.desc("copies"))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw"))
    rows = rows.withColumn("nth", F.row_number().over(again.orderBy("draw")))
    return rows.join(picks, ["draw", "nth"]).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
