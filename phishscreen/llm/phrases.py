"""Phrase collocation mining: multikey three-way quicksort of suffix pointers, routed globally by leading words.

Every word of a piece of text begins a suffix of at most five words. Chunks of documents (about four megabytes) first send their
distinct words and pairs of neighbours with counts to buckets of a hash space, which add them up and answer which pairs are
frequent. A suffix is cut at its first pair that is not, as no phrase over it can be frequent, and those of three words or more
are routed to buckets by their leading three words; by four if more than ``HOT`` occurrences share their leading pair, so that no
pair, however frequent, meets in one place. A chunk sends equal suffixes once, with their number. A bucket sorts pointers to its
suffixes by three-way partition on one word after another: the size of the equal part is the count of a phrase, the part goes on
with the next word, and parts below the least count are abandoned. Buckets compare
words by their bytes; hashes route, and tell words apart inside a chunk, along with lengths and last bytes. What buckets find is joined once more to score each phrase by its cuts, all in exact integers.

Null and empty texts hold no words; a null language is ``und``; repeated rows count each. An empty table gives an empty result, as
does one without a frequent phrase. Extra columns are ignored. A chunk and a document must fit in a task's memory about 60 times over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import LOW_BYTES, Hasher, bounds, cut, eights, joined, lowered, pack, partitions, unpack, utf8

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Bytes of text that a chunk holds on average: the larger, the more equal suffixes are sent as one.
CHUNK_BYTES = 4 << 20
#: Occurrences of a leading pair beyond which its suffixes are routed by four words.
HOT = 1 << 20
#: Languages whose totals are broadcast; more are joined by a shuffle.
BROADCAST_LANGS = 100_000
#: Groups of a ranking that meet in one task.
FAN_IN = 16
PACKET = "bucket int, chunk bigint, kind int, lang string, blob binary"
TALLY = f"{PACKET}, phrase string, words int, f bigint"
WORDS, PAIRS, FOUND, TOTAL = 0, 1, 2, 3

_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


class Text:
    """The texts of one language in a chunk: words in order as numbers of a sorted vocabulary, and which ones have a neighbour."""

    def __init__(self, lang: str, texts: list[bytes], hasher: Hasher) -> None:
        self.lang = lang
        data = lowered(np.frombuffer(b"\n".join([*texts, b""]), np.uint8))
        breaks = _BREAK[data]
        word = ~(breaks | _BLANK[data])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], word.astype(np.int8), [0]])))
        starts, ends = edge[::2], edge[1::2]
        raw = data.tobytes()
        piece = np.cumsum(breaks)[starts] if len(starts) else starts
        self.near = np.append(piece[1:] == piece[:-1], False)[: len(starts)]  # the next word is in the same piece
        hashes = hasher.spans(data, starts, ends)
        known, first, self.ids = np.unique(hashes, return_index=True, return_inverse=True)
        # words with one hash and other lengths or last bytes are told apart by all their bytes
        vocab = pa.array([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], pa.binary())
        sizes, tails = ends - starts, _tails(data, starts, ends)
        if (sizes[first][self.ids] != sizes).any() or (tails[first][self.ids] != tails).any():
            said = pa.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()).dictionary_encode()
            vocab, self.ids = said.dictionary, said.indices.to_numpy()
            order = pc.sort_indices(vocab).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            vocab, self.ids = vocab.take(pa.array(order)), rank[self.ids]
            lengths = pc.binary_length(vocab).to_numpy()
            flat = np.frombuffer(b"".join(vocab.to_pylist()), np.uint8)
            ends = np.cumsum(lengths)
            known = hasher.spans(flat, ends - lengths, ends)
        self.vocab, self.hashes = vocab, known

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and second word, hash and count of each different pair in order of hashes, and where each of the places with a
        neighbour has its pair."""
        at, size = np.flatnonzero(self.near), max(1, len(self.vocab))
        code, back, times = np.unique(self.ids[at] * size + self.ids[at + 1] if len(at) else at, return_inverse=True, return_counts=True)
        a, b = code // size, code % size
        hashes = joined(self.hashes[a], self.hashes[b])
        order = np.lexsort((code, hashes))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return a[order], b[order], hashes[order], times[order], rank[back]


def _tails(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last 8 bytes of each word, fewer of a shorter one."""
    size = np.minimum(ends - starts, 8)
    return eights(data)[ends - size] & LOW_BYTES[size]


def _texts(chunk: pa.Table, hasher: Hasher):
    langs = chunk["lang"].combine_chunks().dictionary_encode() if chunk.num_rows else None
    if langs is None:
        return
    langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
    which, texts = langs.indices.to_numpy(), chunk["text"].cast(pa.binary()).to_pylist()
    names = langs.dictionary.to_pylist()
    for i in sorted(range(len(names)), key=names.__getitem__):
        yield Text(names[i], [texts[j] for j in np.flatnonzero(which == i).tolist()], hasher)


def _said(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of words, to be packed."""
    data, off = utf8(words)
    return np.diff(off).astype(np.uint32), data


def _heard(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)


def _with_words(text: Text, columns: np.ndarray, *more: np.ndarray) -> bytes:
    """Rows of word numbers (-1 for none) with the words that they need."""
    used, local = np.unique(columns, return_inverse=True)
    skip = int(len(used) > 0 and used[0] < 0)
    local = local.reshape(columns.shape) + (1 - skip)  # 0 is none
    return pack(*_said(text.vocab.take(pa.array(used[skip:]))), *(_narrow(c) for c in local), *more)


def _unified(blobs: list[bytes], columns: int) -> tuple[pa.Array, np.ndarray, list[np.ndarray], list[int]]:
    """All different words, the rows of all packets by their numbers (-1 for none), further arrays, and rows of each packet."""
    parts = [unpack(b) for b in blobs]
    heard = [_heard(p[0], p[1]) for p in parts]
    words = pa.concat_arrays(heard).dictionary_encode()
    numbers, at, rows = words.indices.to_numpy(), 0, []
    for p, own in zip(parts, heard, strict=True):
        table = np.append(-1, numbers[at : at + len(own)])
        at += len(own)
        rows.append(np.stack([table[c] for c in p[2 : 2 + columns]]) if columns else table[1:][None])
    more = [np.concatenate([p[i] for p in parts]) for i in range(2 + columns, len(parts[0]))]
    return words.dictionary, np.concatenate(rows, axis=1), more, [r.shape[1] for r in rows]


def _packets(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


class Miner:
    """The steps on one chunk or bucket."""

    def __init__(self, least: int, most_words: int, hot: int, bits: int) -> None:
        self.least, self.most, self.hot, self.bits, self.hasher = least, most_words, hot, bits, Hasher()

    def count(self, key: tuple, chunk: pa.Table) -> pa.Table:
        """Sends the words and pairs of a chunk with their numbers."""
        out = []
        for text in _texts(chunk, self.hasher):
            times = np.bincount(text.ids, minlength=len(text.vocab))
            order = np.argsort(text.hashes, kind="stable")
            edges = bounds(text.hashes[order], self.bits)
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[b] : edges[b + 1]]
                out.append((b, key[0].as_py(), WORDS, text.lang, pack(*_said(text.vocab.take(pa.array(own))), times[own].astype(np.uint32))))
            first, second, hashes, times, _ = text.pairs()
            edges = bounds(hashes, self.bits)
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[b], edges[b + 1])
                out.append((b, key[0].as_py(), PAIRS, text.lang, _with_words(text, np.stack([first[own], second[own]]), times[own].astype(np.uint32))))
        return _packets(out, PACKET)

    def tally(self, key: tuple, rows: pa.Table) -> pa.Table:
        """Adds up words and pairs of a bucket, and answers each chunk which of its pairs are frequent and which are hot."""
        bucket, lang, out = key[0].as_py(), key[1].as_py(), []
        kinds = rows["kind"].to_numpy()
        sent = rows.filter(pa.array(kinds == WORDS))
        if sent.num_rows:
            words, numbers, (times,), _ = _unified(sent["blob"].to_pylist(), 0)
            total = np.bincount(numbers[0], times.astype(np.float64), len(words)).astype(np.int64)
            out.append((bucket, None, TOTAL, lang, None, None, 0, int(total.sum())))
            for i in np.flatnonzero(total >= self.least).tolist():
                out.append((bucket, None, FOUND, lang, None, words[i].as_py().decode("utf-8", "replace"), 1, int(total[i])))
        sent = rows.filter(pa.array(kinds == PAIRS))
        if sent.num_rows:
            words, pairs, (times,), sizes = _unified(sent["blob"].to_pylist(), 2)
            code, back = np.unique(pairs[0] * len(words) + pairs[1], return_inverse=True)
            total = np.bincount(back, times.astype(np.float64), len(code)).astype(np.int64)
            for i in np.flatnonzero(total >= self.least).tolist():
                phrase = b" ".join(words[int(j)].as_py() for j in divmod(int(code[i]), len(words)))
                out.append((bucket, None, FOUND, lang, None, phrase.decode("utf-8", "replace"), 2, int(total[i])))
            often, hot, at = (total >= self.least)[back], (total >= self.hot)[back], 0
            for chunk, n in zip(sent["chunk"].to_pylist(), sizes, strict=True):
                own = slice(at, at + n)
                at += n
                if often[own].any():
                    out.append((bucket, chunk, PAIRS, lang, pack(np.packbits(often[own]), np.packbits(hot[own])), None, None, None))
        return _packets(out, TALLY)

    def route(self, key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        """Sends the different suffixes of three frequent words or more, cut where they stop being frequent, by leading words."""
        out, by_lang = [], {}
        for lang, bucket, blob in zip(*(answers[c].to_pylist() for c in ("lang", "bucket", "blob")), strict=True):
            by_lang.setdefault(lang, []).append((bucket, blob))
        for text in _texts(chunk, self.hasher) if by_lang else ():
            said = by_lang.get(text.lang)
            if not said:
                continue
            _, _, hashes, _, back = text.pairs()
            edges, often, hot = bounds(hashes, self.bits), np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
            for bucket, blob in said:
                own = slice(edges[bucket], edges[bucket + 1])
                for flags, packed in zip((often, hot), unpack(blob), strict=True):
                    flags[own] = np.unpackbits(packed, count=own.stop - own.start).astype(bool)
            n = len(text.ids)
            chain, is_hot = np.zeros(n + self.most, bool), np.zeros(n, bool)
            chain[:n][text.near], is_hot[text.near] = often[back], hot[back]
            at = np.flatnonzero(chain[:n] & chain[1 : n + 1])
            suffix, goes = np.full((self.most, len(at)), -1), np.ones(len(at), bool)
            suffix[0] = text.ids[at]
            for d in range(1, self.most):
                goes &= chain[at + d - 1]
                suffix[d, goes] = text.ids[at[goes] + d]
            suffix, times = _distinct_columns(suffix, len(text.vocab))
            # pointers of one chunk's equal suffixes are one; a hot pair's go by four words
            first = joined(joined(text.hashes[suffix[0]], text.hashes[suffix[1]]), text.hashes[suffix[2]])
            warm = np.zeros(len(times), bool)
            if is_hot.any():
                code = np.unique(text.ids[:-1][is_hot[:-1]] * len(text.vocab) + text.ids[1:][is_hot[:-1]])
                warm = np.isin(suffix[0] * len(text.vocab) + suffix[1], code)
            fourth = suffix[3] if self.most > 3 else np.full(len(times), -1)
            deep = joined(first, np.where(fourth < 0, np.uint64(1), text.hashes[fourth]))
            place = np.where(warm, deep, first)
            order = np.argsort(place, kind="stable")
            edges = bounds(place[order], self.bits)
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[b] : edges[b + 1]]
                out.append((b, key[0].as_py(), PAIRS, text.lang, _with_words(text, suffix[:, own], times[own].astype(np.uint32), warm[own].astype(np.uint8))))
        return _packets(out, PACKET)

    def sort(self, key: tuple, rows: pa.Table) -> pa.Table:
        """The frequent phrases of a bucket of suffixes, by three-way quicksort."""
        words, suffix, (times, warm), _ = _unified(rows["blob"].to_pylist(), self.most)
        out, times = [], times.astype(np.int64)
        for hot in (False, True):
            # a hot phrase of three words is met in several buckets, so none of its parts is given up before the fourth
            least = lambda depth, hot=hot: 1 if hot and depth < 3 else self.least
            for phrase, count in three_way(suffix, times, np.flatnonzero(warm.astype(bool) == hot), least, self.most):
                if len(phrase) > 2:
                    said = b" ".join(words[i].as_py() for i in phrase).decode("utf-8", "replace")
                    out.append((key[0].as_py(), None, FOUND, key[1].as_py(), None, said, len(phrase), count))
        return _packets(out, TALLY)


def _distinct_columns(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different columns and how often each occurs. Numbers are below size, or -1."""
    per = max(1, 63 // max(1, int(size + 1).bit_length()))
    keys = []
    for lo in range(0, len(rows), per):
        code = np.zeros(rows.shape[1], np.int64)
        for row in rows[lo : lo + per]:
            code = code * (size + 1) + row + 1
        keys.append(code)
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([np.diff(k[order]) != 0 for k in keys])
    at = np.flatnonzero(new)
    return rows[:, order[at]], np.diff(np.append(at, len(order)))


def three_way(suffix: np.ndarray, times: np.ndarray, pointers: np.ndarray, least, depth_limit: int):
    """Yields (words, count) of every prefix of the suffixes that occurs least(depth) times or more. Partitions pointers by the
    word at a depth into smaller, equal and larger than a pivot's; the equal ones go one word deeper."""
    stack = [(pointers, 0)]
    while stack:
        own, depth = stack.pop()
        if not len(own) or int(times[own].sum()) < least(depth):
            continue
        at = suffix[depth][own]
        low, mid, high = sorted((int(at[0]), int(at[len(at) // 2]), int(at[-1])))
        less, more = at < mid, at > mid
        if less.any():
            stack.append((own[less], depth))
        if more.any():
            stack.append((own[more], depth))
        same = own[~(less | more)]
        if mid >= 0:
            count = int(times[same].sum())
            if count >= least(depth):
                yield [int(suffix[d][same[0]]) for d in range(depth + 1)], count
                if depth + 1 < depth_limit:
                    stack.append((same, depth + 1))


def frequent(docs: DataFrame, least: int = MIN_COUNT, most_words: int = MAX_WORDS, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f): all phrases of up to most_words words that occur least times or more, (lang, n): words)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(id_col, text_col).alias("draw"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    chunks = max(1, -(-int(total) // CHUNK_BYTES))
    chunks = rows.select(F.pmod("draw", F.lit(chunks)).alias("chunk"), "lang", "text").repartition(partitions(spark), "chunk")
    # a bucket for each partition
    by = Miner(least, most_words, hot, max(1, (partitions(spark) - 1).bit_length()))
    sent = chunks.groupBy("chunk").applyInArrow(lambda k, t: by.count(k, t), PACKET)
    tally = cut(sent.groupBy("bucket", "lang").applyInArrow(lambda k, t: by.tally(k, t), TALLY))
    answers = tally.where(F.col("kind") == PAIRS).select("bucket", "chunk", "lang", "blob")
    suffixes = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda k, a, b: by.route(k, a, b), PACKET)
    longer = suffixes.groupBy("bucket", "lang").applyInArrow(lambda k, t: by.sort(k, t), TALLY)
    found = tally.where(F.col("kind") == FOUND).select("lang", "phrase", "words", "f")
    deep = longer.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return cut(found.unionByName(deep.select("lang", "phrase", "words", "f"))), tally.where(F.col("kind") == TOTAL).groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(docs: DataFrame, least: int = MIN_COUNT, most_words: int = MAX_WORDS, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, words, a, l, r, n, k, score): phrases of two words or more with their lowest-scoring cut, without those
    that always occur inside a longer one."""
    known, totals = frequent(docs, least, most_words, hot, id_col, text_col, lang_col)
    said = F.split("phrase", " ")
    rows = known.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), said.alias("said"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    rows = rows.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice("said", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("said", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    rows = rows.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    totals = cut(totals)
    rows = rows.join(F.broadcast(totals) if totals.count() <= BROADCAST_LANGS else totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    over = F.lit(1000).cast("decimal(4,0)") * big("a") * big("n")
    rows = cut(rows.withColumn("over", over).withColumn("under", big("l") * big("r")).withColumn("score", F.expr("over div under")).drop("over", "under"))
    best = rows.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("m"))
    # a phrase that is as frequent as one with a word more on one side is a part of it; if of a longer one, then of one of these
    whole = lambda side, count, k: rows.where((F.col("words") > 2) & (F.col("k") == k) & (F.col(count) == F.col("a"))).select("lang", F.col(side).alias("phrase"))
    inside = whole("left", "l", F.col("words") - 1).unionByName(whole("right", "r", F.lit(1))).distinct()
    return best.join(inside, ["lang", "phrase"], "left_anti").select("lang", "phrase", "words", "a", "m.l", "m.r", "n", "m.k", "m.score")


def top(found: DataFrame, n: int = TOP) -> DataFrame:
    """The first n phrases of each language with their rank: by score, then a, both descending, then by the phrase's bytes.
    Languages are ranked in parts first, some of which meet at a time."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = partitions(found.sparkSession)
    out = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)).cast("int"))
    while True:
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)).cast("bigint")).where(F.col("rank") <= n)
        if parts == 1:
            return out.drop("part")
        parts = -(-parts // FAN_IN)
        out = out.withColumn("part", F.expr(f"cast(part div {FAN_IN} as int)"))
