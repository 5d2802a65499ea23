"""Benchmark decontamination with a broadcast set of hashed test n-grams, in DataFrame functions only.

Texts become words: A-Z in lower case, runs of letters, digits and characters beyond ASCII. The windows of a test item are
its runs of ``width`` words, or all its words if it has fewer. Their distinct 64-bit hashes and words are broadcast; each
document hashes its own windows of all lengths that occur, and these meet the set in a hash join whose condition compares the
words themselves, so that no hit rests on a hash. Words are taken out of the document's array by place inside generated code,
so a window costs no array of its own. Only hits and one row a document go on to a shuffle: they are grouped by the document's key, overlapping hits merge to spans by two sorted arrays, and the
few documents with hits look up the items of their windows. A set beyond ``BROADCAST_BYTES`` is joined by a shuffle instead.

Null texts have no words: such documents have no hit, such items no window. Items without an id hit but are not counted or
named. Repeated rows of documents give a row each, repeated items and ids count once. Empty tables of documents give an
empty result, of items no hit. Extra columns are ignored by annotate() and kept by remove(), whatever their names. A
document must fit in a task's memory about 30 times over; there is no other limit to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 10
#: Bytes of windows that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: ASCII characters that stand between words; all others, and those beyond ASCII, are in words.
GAPS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-case words; none of a null text."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), GAPS + UPPER, " " * len(GAPS) + LOWER)
    return F.array_remove(F.split(plain, " "), "")


def _hash(array: str, start, width: int) -> Column:
    """Of width words from a place on (the first is 0); places beyond the array don't count."""
    return F.xxhash64(*[F.get(array, start + i) for i in range(width)])


def item_windows(items: DataFrame, width: int = WIDTH, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, h, check, win): each window of each item once. h and check are two hashes of its words."""
    said = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - width + 1, F.lit(1)))
    rows = said.select("item", F.explode(F.transform(starts, lambda i: F.slice("ws", i, width))).alias("win"))
    return rows.select("item", _hash("win", F.lit(0), width).alias("h"), F.xxhash64(F.lit(width), "win").alias("check"), "win").distinct()


def _document_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """The same for rows of equal id and text, which have equal results."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))))


def hits(docs: DataFrame, windows: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, copies, n_words, found): found is the set of the document's hits, each with start, end, h and check."""
    held = windows.select("h", "check", "win").distinct()
    sizes = held.groupBy(F.size("win").alias("n")).agg(F.sum(F.octet_length(F.array_join("win", " ")) + 64).alias("bytes")).collect()  # one row a length
    small = sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES
    lengths = sorted(r["n"] for r in sizes)
    rows = docs.select(_document_key(docs, id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("ws"))
    rows = rows.select("key", "doc_id", "ws", F.size("ws").alias("n_words"))
    # a row of the document's own (-1), then the windows of each length
    count = lambda n: F.greatest(F.col("n_words") - n + 1, F.lit(0))
    last = sum((count(n) for n in lengths), F.lit(-1))
    rows = rows.select("key", "doc_id", "ws", "n_words", F.explode(F.sequence(F.lit(-1), last)).alias("at"))
    start, size, before = F.col("at"), F.lit(lengths[0] if lengths else width), F.lit(0)
    for n, next_ in zip(lengths, lengths[1:], strict=False):
        before = before + count(n)
        start, size = F.when(F.col("at") >= before, F.col("at") - before).otherwise(start), F.when(F.col("at") >= before, F.lit(next_)).otherwise(size)
    rows = rows.withColumn("start", start).withColumn("n", size)
    if len(lengths) < 2:
        h = _hash("ws", F.col("start"), lengths[0] if lengths else width)
    else:
        h = F.xxhash64(*[F.when(F.col("n") > i, F.get("ws", F.col("start") + i)) for i in range(width)])
    rows = rows.withColumn("h", h)
    right = held.select(F.col("h").alias("h2"), "check", "win")
    same = (F.col("h") == F.col("h2")) & (F.slice("ws", F.greatest(F.col("start") + 1, F.lit(1)), F.col("n")) == F.col("win")) & (F.col("at") >= 0)
    met = rows.join(F.broadcast(right) if small else right, same, "left").where("at = -1 or check is not null")
    hit = F.when(F.col("check").isNotNull(), F.struct("start", (F.col("start") + F.col("n")).alias("end"), "h", "check"))
    own_row = F.count(F.when(F.col("at") == -1, 1))
    return met.groupBy("key").agg(F.first("doc_id").alias("doc_id"), own_row.alias("copies"), F.first("n_words").cast("bigint").alias("n_words"), F.collect_set(hit).alias("found"))


def annotate(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, doc_id, copies, n_words, n_hit, spans, items): n_hit words are inside a window of an item, spans are maximal runs
    of them (from word start to before word end), items the sorted ids of the items that have such a window. One row for each
    different document, copies says how many it stands for."""
    windows = item_windows(items, width, item_col, item_text)
    found = hits(docs, windows, width, id_col, text_col)
    # sorted starts and ends: a span opens where as many windows have ended as have begun before
    ordered = found.withColumns({"s": F.array_sort(F.transform("found", lambda x: x["start"])), "e": F.array_sort(F.transform("found", lambda x: x["end"]))})
    opens = F.filter("s", lambda x, i: (i == 0) | (F.get("e", i - 1) < x))
    ends = F.filter("e", lambda x, i: (i == F.size("e") - 1) | (x < F.get("s", i + 1)))
    spans = ordered.select("key", "doc_id", "copies", "n_words", "found", opens.alias("opens"), ends.alias("ends"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    pair = F.zip_with("opens", "ends", lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    judged = spans.select("key", "doc_id", "copies", "n_words", (total("ends") - total("opens")).alias("n_hit"), pair.alias("spans"), F.transform("found", lambda x: F.struct(x["h"].alias("h"), x["check"].alias("check"))).alias("of"))
    named = windows.where("item is not null").select("item", F.col("h").alias("wh"), F.col("check").alias("wc"))
    # each document meets the items of its windows where it stands: the lookup keeps the partitioning by key
    asked = judged.withColumn("of", F.explode_outer(F.array_distinct("of")))
    few = windows.agg(F.sum(F.octet_length("item") + 64)).first()[0] or 0
    met = asked.join(F.broadcast(named) if few <= BROADCAST_BYTES else named, (F.col("of.h") == F.col("wh")) & (F.col("of.check") == F.col("wc")), "left")
    same = [F.first(c).alias(c) for c in ("doc_id", "copies", "n_words", "n_hit", "spans")]
    return met.groupBy("key").agg(*same, F.array_sort(F.collect_set("item")).alias("items"))


def remove(docs: DataFrame, items: DataFrame, how: str = "spans", width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without what they share with the items: how='documents' drops every document with a hit, how='spans' takes the hit
    words out of the texts, each with what stands between it and the word before. Other columns are unchanged."""
    if how not in ("spans", "documents"):
        raise ValueError(f"how must be spans or documents, not {how}")
    judged = annotate(docs, items, width, id_col, text_col, item_col, item_text).where("n_hit > 0").select("key", "n_words", "spans")
    rows = docs.select(_document_key(docs, id_col, text_col).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if how == "documents":
        return rows.join(judged.select("key"), "key", "left_anti").select("row.*")
    hit = rows.join(judged, "key", "left")
    text = F.col(f"row.`{text_col}`").cast("string")
    # the text is gap, word, gap, word, ..., gap
    gaps = F.split(text, f"{WORD}+")
    said = F.array_remove(F.split(F.translate(text, GAPS, " " * len(GAPS)), " "), "")
    parts = hit.withColumns({"said": F.when(F.col("n_words").isNotNull(), said), "gaps": F.when(F.col("n_words").isNotNull(), gaps)})
    parts = parts.withColumn("both", F.zip_with(F.slice("gaps", 1, F.greatest(F.size("said"), F.lit(1))), "said", lambda g, w: F.concat(F.coalesce(g, F.lit("")), F.coalesce(w, F.lit("")))))
    froms = F.concat(F.array(F.lit(0)), F.transform("spans", lambda x: x["end"]))
    tos = F.concat(F.transform("spans", lambda x: x["start"]), F.array(F.col("n_words").cast("int")))
    kept = F.zip_with(froms, tos, lambda a, b: F.array_join(F.slice("both", a + 1, b - a), ""))
    left = F.concat(F.array_join(kept, ""), F.element_at("gaps", -1))
    field = lambda c: F.when(F.col("n_words").isNotNull(), F.col("left")).otherwise(text) if c == text_col else F.col(f"row.`{c}`")
    return parts.withColumn("left", left).select(*[field(c).alias(c) for c in docs.columns])


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """annotate() with a row for each row of docs, without its key."""
    out = annotate(docs, items, width, id_col, text_col, item_col, item_text)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies", "key")
