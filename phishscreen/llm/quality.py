"""Quality rules with an isolation forest on rule statistics.

Each text gives a few statistics (lengths, symbols, repeats, case). Two base rules reject outright. For the rest an
isolation forest of random splits counts all good labelled rows in its parts; the mean path length of a document over its
trees tells how easily it is set apart. The threshold comes from the scores of all labelled rows: a document goes only if its
anomaly score passes the one that best separates quality 0 from quality 1 while at most max_false_reject of the good ones go.

Statistics cover every whole text. Null and empty texts have zeros and fail the base rules; null ids are kept as they
are; labels that are null, repeated or of no document don't count (of repeated ones the worst). Without labels of both kinds only
the base rules judge. Extra columns are ignored by statistics() and kept by filter_docs().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Hasher, cut, utf8, window_room, word_spans

#: A path is as long as it would be on average among so many rows drawn from all good ones; this bounds the depth of trees.
TREES, TREE_ROWS = 100, 256
#: Scores are counted in so many steps between 0 and 1, a power of 2; thresholds lie between steps.
SCORE_STEPS = 1 << 14
MAX_FALSE_REJECT = 0.01
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
SLICE_BYTES = 1 << 20

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_chars", "n_alpha_words", "n_doubled")
STAT_SCHEMA = ", ".join(f"{c} bigint" for c in STATS)


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[at])


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _UPPER, _BANG = _table("#*$%&|<>"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("!?")
_LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0x80)
_SPACES = _table(" \t\n\x0b\x0c\r")


def text_statistics(data: np.ndarray, off: np.ndarray, hasher: Hasher, window: int = REPEAT_WINDOW) -> dict[str, np.ndarray]:
    """STATS of each text, from the UTF-8 bytes of a few texts and their offsets."""
    starts, ends, first = word_spans(data, off)
    n_words, docs = np.diff(first), len(off) - 1
    lead = (data & 0xC0) != 0x80
    words = hasher.spans(data, starts, ends)
    doc = np.repeat(np.arange(docs, dtype=np.uint64), n_words) * np.uint64(0xA0761D6478BD642F)
    doubled = np.zeros(len(words), bool)
    doubled[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    repeat = np.zeros(len(starts), bool)
    grams = hasher.windows(words, window)
    if len(grams):
        grams ^= doc[: len(grams)]
        room = np.flatnonzero(window_room(first, window)[: len(grams)])
        grams = grams[room]
        order = np.argsort(grams)
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(len(grams), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        edge = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edge, room[twice], 1)
        np.add.at(edge, room[twice] + window, -1)
        repeat = np.cumsum(edge[:-1]) > 0
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data], out=letters[1:])
    raw, dup, lines = data.tobytes(), np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    for i in range(docs):
        all_lines = [x for x in raw[off[i] : off[i + 1]].split(b"\n") if x.strip()]
        lines[i], dup[i] = len(all_lines), len(all_lines) - len(set(all_lines))
    values = (n_words, _sums(lead & ~_SPACES[data], off), _sums(_SYMBOL[data], off), dup, _sums(repeat, first), lines, _sums(_UPPER[data], off), _sums(_BANG[data], off), _sums(lead, off), _sums(letters[ends] > letters[starts], first), _sums(doubled, first))
    return dict(zip(STATS, values, strict=True))


def slices(off: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about size bytes."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = to


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, STATS...), a row for each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for lo, hi in slices(off):
                got = text_statistics(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], hasher)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *[pa.array(got[c].astype(np.int64)) for c in STATS]], names=["doc_id", *STATS])

    return rows.mapInArrow(run, f"doc_id bigint, {STAT_SCHEMA}")


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """The statistics as rates, which don't depend on the length of the text."""
    s = {k: np.asarray(v, np.float64) for k, v in stats.items()}
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.column_stack([s["n_symbols"] / words, s["n_bangs"] / words, s["n_upper"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, 1 - s["n_alpha_words"] / words, s["n_doubled"] / words])


#: Features of a row, and their names in tables.
FEATURES = tuple(f"f{i}" for i in range(7))


def _c(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows, n also between whole numbers: 2 H(n - 1) - 2 (n - 1) / n."""
    n = np.maximum(np.asarray(n, np.float64), 1.0)
    x = n + 12
    digamma = np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) - sum(1 / (n + k) for k in range(12))
    return 2 * (digamma + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), split value, left child (right is next to it), depth or, once counted, path
    length at leaves."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    rows: int

    @classmethod
    def drawn(cls, low: np.ndarray, high: np.ndarray, rows: int, trees: int = TREES, seed: int = 7) -> Forest:
        """Splits are drawn from the box between low and high, which may be wider than the good rows: what lies in a part of the
        box without rows is set apart by the first split that cuts the part off. No row is needed to draw them."""
        rng, out = np.random.default_rng(seed), []
        limit = int(np.ceil(np.log2(max(rows, 2))))
        for _ in range(trees):
            nodes: list[list] = [[-1, 0.0, 0, 0.0]]
            todo = [(0, 0, low, high)]
            while todo:
                at, depth, lo, hi = todo.pop()
                nodes[at][3] = float(depth)
                spread = np.flatnonzero(hi > lo)
                if depth >= limit or not len(spread):
                    continue
                f = int(rng.choice(spread))
                v = float(rng.uniform(lo[f], hi[f]))
                cut_hi, cut_lo = hi.copy(), lo.copy()
                cut_hi[f] = cut_lo[f] = v
                nodes[at][:3] = [f, v, len(nodes)]
                todo += [(len(nodes), depth + 1, lo, cut_hi), (len(nodes) + 1, depth + 1, cut_lo, hi)]
                nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
            cols = list(zip(*nodes, strict=True))
            out.append((np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3])))
        return cls(out, rows)

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the leaf of each row."""
        for feature, value, left, _ in self.trees:
            at = np.zeros(len(x), np.int64)
            inner = np.flatnonzero(feature[at] >= 0)
            while len(inner):
                node = at[inner]
                at[inner] = left[node] + (x[inner, feature[node]] > value[node])
                inner = inner[feature[at[inner]] >= 0]
            yield at

    def counted(self, counts: dict[tuple[int, int], int], total: int) -> Forest:
        """Path lengths from the number of good rows in each (tree, leaf). A part that holds one of self.rows drawn rows or fewer on
        average is a leaf."""
        out = []
        for t, (feature, value, left, depth) in enumerate(self.trees):
            n = np.array([counts.get((t, i), 0) for i in range(len(feature))], np.float64)
            for i in range(len(n) - 1, -1, -1):  # children come after their parents
                if feature[i] >= 0:
                    n[i] = n[left[i]] + n[left[i] + 1]
            share = n * self.rows / max(total, 1)
            out.append((np.where(share <= 1, -1, feature), value, left, depth + _c(share)))
        return Forest(out, self.rows)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that few splits set apart."""
        total = np.zeros(len(x))
        for (*_, path), at in zip(self.trees, self.leaves(x), strict=True):
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(float(_c(self.rows)), 1e-9))


@dataclass
class Model:
    forest: Forest | None
    threshold: float

    @classmethod
    def fit(cls, rows: DataFrame, max_false_reject: float = MAX_FALSE_REJECT) -> Model:
        """From all rows of labelled(). Good rows are counted in the parts of the trees, so that what is unlike them has short paths;
        the threshold is calibrated on the scores of all rows. The driver gets counts of leaves and of steps of scores."""
        ends = rows.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"), F.array(*[F.min(c) for c in FEATURES]).alias("low"), F.array(*[F.max(c) for c in FEATURES]).alias("high")).first()
        if not ends.good or not ends.bad:
            return cls(None, np.inf)
        forest = Forest.drawn(np.array(ends.low), np.array(ends.high), min(TREE_ROWS, ends.good))

        def in_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros(len(t[0]), np.int64) for t in forest.trees]
            for batch in batches:
                for n, at in zip(sums, forest.leaves(_matrix(batch)), strict=True):
                    n += np.bincount(at, minlength=len(n))
            for t, n in enumerate(sums):
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), t)), pa.array(used), pa.array(n[used])], names=["tree", "node", "n"])

        found = rows.where("good").mapInArrow(in_leaves, "tree bigint, node bigint, n bigint").groupBy("tree", "node").agg(F.sum("n").alias("n")).collect()
        forest = forest.counted({(r.tree, r.node): r.n for r in found}, ends.good)

        def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = np.floor(forest.scores(_matrix(batch)) * SCORE_STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(step)], names=["good", "step"])

        count = rows.mapInArrow(steps, "good boolean, step bigint").groupBy("step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy("step").collect()
        step, good, bad = (np.array([r[c] for r in count], np.int64) for c in ("step", "good", "bad"))
        if len(step) < 2:
            return cls(None, np.inf)
        false, true = 1 - np.cumsum(good)[:-1] / ends.good, 1 - np.cumsum(bad)[:-1] / ends.bad
        gain = np.where(false <= max_false_reject, true - false, -1.0)
        best = int(np.argmax(gain))
        # halfway between two steps that have rows, and just below the first score that goes
        edge = int(step[best] + step[best + 1] + 1) // 2 / SCORE_STEPS
        return cls(forest, float(np.nextafter(edge, 0))) if gain[best] > 0 else cls(None, np.inf)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy() for c in FEATURES])


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(good, FEATURES...) of all labelled rows that pass the base rules."""
    worst = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = stats.where(~base_failed()).join(worst, "doc_id").select((F.col("quality") > 0).alias("good"), *STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in STATS})
            yield pa.RecordBatch.from_arrays([batch.column("good"), *[pa.array(x[:, i]) for i in range(len(FEATURES))]], names=["good", *FEATURES])

    # three passes follow
    return cut(rows.mapInArrow(run, f"good boolean, {', '.join(f'{c} double' for c in FEATURES)}"))


def judged(stats: DataFrame, model: Model) -> DataFrame:
    """stats with base_failed, anomaly (score of the forest) and kept."""
    schema = f"doc_id bigint, {STAT_SCHEMA}, base_failed boolean, anomaly double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in STATS})
            score = model.forest.scores(x) if model.forest else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "anomaly"])

    out = stats.withColumn("base_failed", base_failed()).mapInArrow(run, schema)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= model.threshold))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, STATS..., base_failed, anomaly, kept) for every document."""
    stats = cut(statistics(docs))
    return judged(stats, Model.fit(labelled(stats, labels)))


def filter_docs(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, columns unchanged. The model is fit first, then one pass judges and filters: no join, no shuffle of text."""
    model = Model.fit(labelled(cut(statistics(docs, id_col, text_col)), labels))
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            data, off = utf8(batch.column(names.index(text_col)))
            for lo, hi in slices(off):
                got = text_statistics(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], hasher)
                bad = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
                if model.forest:
                    bad |= model.forest.scores(features(got)) > model.threshold
                yield batch.slice(lo, hi - lo).filter(pa.array(~bad))

    return docs.mapInArrow(run, schema)
