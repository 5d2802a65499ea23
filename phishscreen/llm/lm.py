"""Scoring documents with a gated recurrent language model.

Words are counted over all training documents by the exchange of chunks and buckets; that gives the smoothed unigram base.
The model's vocabulary grows with the corpus: of N tokens it holds every word that occurs sqrt(N) / RARE times or more, and
at least the VOCABULARY most frequent ones, so at most VOCABULARY + RARE sqrt(N) words. All others are one symbol that is
spelled by the base's probability among them, so the model gives every text a probability. The model is a small gated
recurrent unit in numpy. Its softmax is factored: a class, then a word of the class; there are about 0.6 sqrt(V) classes, of
equal sums of square roots of counts, so both steps take some sqrt(V). A task holds 4 HIDDEN + 1 floats for each of V words
and as many sums of Adagrad, 776 V bytes, and gradients of the output. Training cuts the documents of a partition into parallel streams and runs
truncated backpropagation over short windows, the state carried from window to window and cleared where a document
begins; tokens that don't fill all streams go on to the next buffer, the very last ones are a shorter window, so every token
of every training document is used once. Each task trains from the same start on its own documents, the results are
averaged in a tree, and the next round goes on from there with other documents. Scoring carries the state through each
whole document.

A document is held out if crc32 of its id as text is 0 modulo 10; a null id is not. Null texts count as empty: one end.
Repeated rows train and score one by one. Without any training document all counts are 0 and both scores are of the
smoothing alone. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import PACKET, Hasher, bounds, bucket_bits, chunked, cut, groups, lowered, pack, packets, sorted_chunk, steps, unpack, utf8, word_spans
from .quality import slices

HELD_OUT, ALPHA = 10, 0.1
VOCABULARY, RARE, CLASSES, HIDDEN = 2047, 8, 0.6, 24
STREAMS, WINDOW, STREAM_WINDOWS, ROUNDS, RATE = 256, 16, 64, 2, 0.05
CHUNK_BYTES, FAN_IN = 8 << 20, 16
#: Predictions that are made at once when documents are scored.
SAY_AT_ONCE = 1 << 14
#: Counts are below 2 ** COUNT_BITS.
COUNT_BITS = 48
#: Stands for the end of a document among the hashes of words.
END = np.uint64(0xE0D)
RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; float32 has room for exp of every gate that is not saturated."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place, by exp, which takes half the time of numpy's tanh."""
    x += x
    np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


def _narrow(x: np.ndarray, n: int) -> np.ndarray:
    """Numbers below n in 16 bits if they fit, as these are sorted by radix."""
    return x.astype(np.uint16) if n <= 1 << 16 else x


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What np.unique gives with the inverse. Words repeat a lot, so they are hashed, and only the different ones sorted."""
    coded = pa.array(hashes).dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(words)
    rank = np.empty(len(order), np.intp)
    rank[order] = np.arange(len(order))
    return words[order], rank.take(coded.indices.to_numpy(zero_copy_only=False))


def class_edges(counts: np.ndarray) -> list[int]:
    """Where the classes of the words begin, and the end. Word 0 is a class of its own; the others, the most frequent first,
    form some sqrt(n) classes of equal sums of square roots of counts, which keeps the classes of frequent words small."""
    n = len(counts)
    sums = np.cumsum(np.sqrt(counts[1:] + ALPHA))
    classes = max(1, round(CLASSES * sqrt(n)))
    cuts = np.searchsorted(sums, sums[-1] * np.arange(1, classes) / classes) + 1 if n > 1 else []
    return np.unique(np.concatenate([[0, 1], cuts, [n]])).astype(int).tolist()


class Network:
    """The parameters. Word 0 is the symbol for all other words. The last column of cls and out is the bias. Of inp and rec
    the first third is for the reset gate, then update gate, then candidate."""

    NAMES = ("inp", "rec", "cls", "out")

    def __init__(self, counts: np.ndarray, seed: int = 3) -> None:
        """counts: of each word in training, for the biases to start as the unigram model."""
        rng, n = np.random.default_rng(seed), len(counts)
        self.n, self.edges = n, class_edges(counts)
        self.classes, sizes = len(self.edges) - 1, np.diff(self.edges)
        self.klass = np.repeat(np.arange(self.classes), sizes)
        self.inside = np.arange(n) - np.repeat(self.edges[:-1], sizes)
        self.width = sizes
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.inp, self.rec = draw(3, n, HIDDEN), draw(3, HIDDEN, HIDDEN)
        self.cls, self.out = draw(self.classes, HIDDEN + 1), draw(n, HIDDEN + 1)
        mass = np.bincount(self.klass, counts + ALPHA, self.classes)
        self.cls[:, HIDDEN] = np.log(mass / mass.sum())
        self.out[:, HIDDEN] = np.log((counts + ALPHA) / mass[self.klass])

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def step(self, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The next state of each row."""
        return self.advance(h, self.inp.take(words, 1))[0]

    def advance(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state, gates, candidate and its recurrent part, from the last state and the rows of inp, which are used up."""
        a = np.matmul(h, self.rec)
        gates, cand = g[:2], g[2]
        gates += a[:2]
        _sigmoid(gates)
        cand += gates[0] * a[2]
        _tanh(cand)
        after = h - cand
        after *= gates[1]
        after += cand
        return after, gates, cand, a[2]

    def predict(self, h: np.ndarray, words: np.ndarray, learn: bool = False, careful: bool = False):
        """Log probability (natural) of each word after its state; with learn also the gradients by cls, out and h. States are
        within 1 and logits small, so exp rarely leaves float32; where it does all is done again with the largest logit as 0."""
        klass = self.klass[words]
        order = np.argsort(_narrow(klass, self.classes), kind="stable")
        sorted_h, said_words, klass = np.ones((len(order), HIDDEN + 1), h.dtype), words.take(order), klass.take(order)
        sorted_h[:, :HIDDEN] = h.take(order, 0)
        at = np.searchsorted(klass, np.arange(self.classes + 1)).tolist()
        rows = np.arange(len(sorted_h))
        said = np.einsum("ij,ij->i", sorted_h, self.out.take(said_words, 0)) + np.einsum("ij,ij->i", sorted_h, self.cls.take(klass, 0))
        first = at[1]
        said[:first] = np.einsum("ij,j->i", sorted_h[:first], self.cls[0])
        p = sorted_h @ self.cls.T
        if careful:
            top = p.max(axis=1)
            p -= top[:, None]
            said -= top
        np.exp(p, out=p)
        sums = p @ np.ones(self.classes, np.float32)
        logp = said.astype(np.float64)
        logp -= np.log(sums)
        if learn:
            p *= np.reciprocal(sums)[:, None]
            p[rows, klass] -= 1
            grads = {"cls": p.T @ sorted_h, "out": np.zeros_like(self.out)}
            dh = p @ self.cls
            width = self.width[klass]
            target = (rows - np.repeat(at[:-1], np.diff(at))) * width + self.inside[said_words]
        norm = np.ones(len(sorted_h), h.dtype)
        for c in range(1, self.classes):
            a, b = at[c], at[c + 1]
            if a == b:
                continue
            own, table = sorted_h[a:b], self.out[self.edges[c] : self.edges[c + 1]]
            q = own @ table.T
            if careful:
                top = q.max(axis=1)
                q -= top[:, None]
                logp[a:b] -= top
            np.exp(q, out=q)
            total = q @ np.ones(len(table), np.float32)
            norm[a:b] = total
            if learn:
                q *= np.reciprocal(total)[:, None]
                q.reshape(-1)[target[a:b]] -= 1
                np.matmul(q.T, own, out=grads["out"][self.edges[c] : self.edges[c + 1]])
                dh[a:b] += q @ table
        logp -= np.log(norm)
        if not careful and not np.isfinite(logp).all():
            return self.predict(h, words, learn, True)
        back = np.empty(len(order))
        back[order] = logp
        if not learn:
            return back
        left = np.empty((len(order), HIDDEN), np.float32)
        left[order] = dh[:, :HIDDEN]
        return back, grads, left


class Trainer:
    """Truncated backpropagation with Adagrad."""

    def __init__(self, net: Network) -> None:
        self.net, self.sums = net, {k: np.full_like(getattr(net, k), 1e-6) for k in net.NAMES}

    def _move(self, name: str, grad: np.ndarray, rows=None) -> None:
        """rows are of the second axis; grad is used up."""
        at = getattr(self.net, name)
        sums = self.sums[name] if rows is None else self.sums[name].take(rows, 1)
        sums += grad * grad
        grad /= np.sqrt(sums)
        grad *= RATE
        if rows is None:
            at -= grad
        else:
            self.sums[name][:, rows] = sums
            at[:, rows] -= grad

    def window(self, h: np.ndarray, x: np.ndarray, y: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, float]:
        """One window of (steps, streams); new marks where a document begins. Returns the state after it and the loss."""
        net, (length, streams) = self.net, x.shape
        shape = (length, streams, HIDDEN)
        before, states, cand, part, r, z = (np.empty(shape, h.dtype) for _ in range(6))
        fresh, words = new.any(axis=1), x.ravel()
        inp = net.inp.take(words, 1).reshape(3, *shape)
        for t in range(length):
            before[t] = h
            if fresh[t]:
                before[t][new[t]] = 0
            h, (r[t], z[t]), cand[t], part[t] = net.advance(before[t], inp[:, t])
            states[t] = h
        logp, grads, dh = net.predict(states.reshape(-1, HIDDEN), y.ravel(), learn=True)
        dh = dh.reshape(shape)
        # all factors that don't need the gradient of the state: of reset, update and candidate before their squashing
        rest = 1 - z
        by_cand = 1 - cand * cand
        by_cand *= rest
        rest *= z
        rest *= np.subtract(before, cand, out=cand)
        pulled = by_cand * r
        part *= pulled
        part *= np.subtract(1, r, out=r)
        gate = np.empty((3, *shape), h.dtype)
        back, recT = np.zeros_like(h), np.ascontiguousarray(net.rec.transpose(0, 2, 1))
        for t in range(length - 1, -1, -1):
            back += dh[t]
            dh[t] = back
            for g, factor in zip(gate, (part, rest, pulled), strict=True):
                np.multiply(back, factor[t], out=g[t])
            back *= z[t]
            for g, matrix in zip(gate, recT, strict=True):
                back += g[t] @ matrix
            if fresh[t]:
                back[new[t]] = 0
        scale = np.float32(1 / y.size)
        rec = before.reshape(-1, HIDDEN).T @ gate.reshape(3, -1, HIDDEN)
        np.multiply(dh, by_cand, out=gate[2])
        order = np.argsort(_narrow(words, net.n), kind="stable")
        at = groups(words[order])
        self._move("inp", np.add.reduceat(gate.reshape(3, -1, HIDDEN).take(order, 1), at, axis=1) * scale, words[order[at]])
        self._move("rec", rec * scale)
        for name, g in grads.items():
            g *= scale
            self._move(name, g)
        return h, float(logp.mean())


class Vocabulary:
    """The model's words by hash; the end is among them whenever there was a training document."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, distinct: int) -> None:
        order = np.lexsort((hashes, -counts))
        self.hashes, self.counts, self.tokens, self.distinct = hashes[order], counts[order], tokens, distinct
        self.by_hash = np.argsort(self.hashes)
        self.sorted = self.hashes[self.by_hash]

    def ids(self, words: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.zeros(len(words), np.int64)
        known, back = distinct(words)
        at = np.minimum(np.searchsorted(self.sorted, known), len(self.sorted) - 1)
        return np.where(self.sorted[at] == known, self.by_hash[at] + 1, 0).take(back)

    @property
    def all_counts(self) -> np.ndarray:
        return np.concatenate([[self.tokens - self.counts.sum()], self.counts]).astype(np.float64)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ALPHA) / (self.tokens + ALPHA * (self.distinct + 1)))

    @property
    def rest(self) -> float:
        """log10 of the base's probability of all words outside the vocabulary, the one never seen among them."""
        seen = (self.counts + ALPHA).sum()
        return float(np.log10((self.tokens + ALPHA * (self.distinct + 1) - seen) / (self.tokens + ALPHA * (self.distinct + 1))))


def held_out(ids: list) -> np.ndarray:
    return np.array([x is not None and crc32(str(x).encode()) % HELD_OUT == 0 for x in ids], bool)


def _tokens(data: np.ndarray, off: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with an end after each document, and where each document begins in them (one more at the end)."""
    data = lowered(data)
    starts, ends, first = word_spans(data, off)
    words = hasher.spans(data, starts, ends)
    docs = len(off) - 1
    return np.insert(words, first[1:], END), first + np.arange(docs + 1)


class Counter:
    """Counting by chunks and buckets."""

    def __init__(self, bits: int) -> None:
        self.bits, self.hasher = bits, Hasher()

    def read(self, chunk: pa.Table) -> None:
        _, self.ids, data, off = sorted_chunk(chunk)
        self.held = held_out(self.ids)
        self.tokens, self.first = _tokens(data, off, self.hasher)
        self.known, self.back = distinct(self.tokens)
        self.edges = bounds(self.known, self.bits)

    def send(self, key: tuple, chunk: pa.Table) -> pa.Table:
        self.read(chunk)
        learns = np.repeat(~self.held, np.diff(self.first))
        times = np.bincount(self.back[learns], minlength=len(self.known)).astype(np.uint32)
        return packets([(b, key[0].as_py(), 0, pack(steps(self.known[part]), times[part])) for b in np.flatnonzero(np.diff(self.edges)).tolist() for part in [slice(self.edges[b], self.edges[b + 1])]])


def least_count(tokens: int) -> float:
    """Words that occur as often are in the vocabulary."""
    return max(1.0, sqrt(tokens) / RARE)


def total(key: tuple, rows: pa.Table) -> pa.Table:
    """Answers each chunk with the counts over all training documents; one row of kind 2 has the sums and all words
    that the vocabulary may hold: by the bucket's own tokens, which are no more than all, a word's least count is no higher."""
    parts = [unpack(x) for x in rows["blob"].to_pylist()]
    sizes = [len(p[0]) for p in parts]
    words = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    known, back = np.unique(words, return_inverse=True)
    sums = np.bincount(back, np.concatenate([p[1] for p in parts]).astype(np.float64), len(known)).astype(np.int64)
    out, at = [], 0
    for b, chunk, n in zip(rows["bucket"].to_pylist(), rows["chunk"].to_pylist(), sizes, strict=True):
        out.append((b, chunk, 0, pack(sums[back[at : at + n]])))
        at += n
    top = np.lexsort((known, -sums))
    top = top[: max(VOCABULARY, int((sums >= least_count(int(sums.sum()))).sum()))]
    top = top[sums[top] > 0]
    out.append((b, -1, 2, pack(known[top], sums[top], np.array([sums.sum(), (sums > 0).sum()], np.int64))))
    return packets(out)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The words above the least count, or the most frequent ones if these are more. Buckets first tell how many words they
    have of each order of magnitude, then send only the words that may be in."""
    sizes = [f"h{i}" for i in range(COUNT_BITS)]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + COUNT_BITS, np.int64)
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                _, times, sums = unpack(blob)
                total[:2] += sums
                total[2:] += np.bincount(np.log2(times).astype(np.int64), minlength=COUNT_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(total[i : i + 1]) for i in range(len(total))], names=["tokens", "distinct", *sizes])

    rows = counts.where("kind = 2").select("blob")
    told = rows.mapInArrow(tell, ", ".join(f"{c} bigint" for c in ("tokens", "distinct", *sizes)))
    tokens, distinct, *of_size = (int(x or 0) for x in told.agg(*[F.sum(c) for c in told.columns]).first())
    size = COUNT_BITS - 1
    while size and sum(of_size[size:]) < VOCABULARY:
        size -= 1
    least = min(least_count(tokens), 1 << size)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                words, times, _ = unpack(blob)
                yield pa.RecordBatch.from_arrays([pa.array(words[times >= least].view(np.int64)), pa.array(times[times >= least])], names=["word", "times"])

    got = rows.mapInArrow(send, "word bigint, times bigint").toArrow()
    words, times = got["word"].to_numpy().view(np.uint64), got["times"].to_numpy()
    top = np.lexsort((words.view(np.int64), -times))
    top = top[: max(VOCABULARY, int((times >= least_count(tokens)).sum()))]
    return Vocabulary(words[top], times[top], tokens, distinct)


def train_texts(net: Network, vocab: Vocabulary, texts: Iterator[tuple[np.ndarray, np.ndarray]]) -> int:
    """Trains on token arrays as they come: enough tokens for the streams are gathered, then run through window by window."""
    trainer, seen, need = Trainer(net), 0, STREAMS * WINDOW * STREAM_WINDOWS
    ids, begins, held = [], [], 0
    end = int(vocab.ids(np.array([END]))[0])
    before = end

    def run() -> int:
        """Trains what fills all streams alike, and keeps the rest, with the symbol before it, for the next run."""
        nonlocal before
        y, new = np.concatenate(ids), np.concatenate(begins)
        x = np.append(before, y[:-1])
        streams = max(1, min(STREAMS, len(y) // (WINDOW * STREAM_WINDOWS)))
        length = len(y) // streams
        used = streams * length
        before, ids[:], begins[:] = y[used - 1], [y[used:]], [new[used:]]
        x, y, new = (a[:used].reshape(streams, length).T for a in (x, y, new))
        h = np.zeros((streams, HIDDEN), np.float32)
        for t in range(0, length, WINDOW):
            h, _ = trainer.window(h, x[t : t + WINDOW], y[t : t + WINDOW], new[t : t + WINDOW])
        return used

    for tokens, first in texts:
        got = vocab.ids(tokens)
        new = np.zeros(len(got), bool)
        new[first[:-1]] = True
        ids.append(got), begins.append(new)
        held += len(got)
        if held >= need:
            used = run()
            seen, held = seen + used, held - used
    while held >= STREAMS:
        used = run()
        seen, held = seen + used, held - used
    if held:
        y, new = np.concatenate(ids)[:, None], np.concatenate(begins)[:, None]
        x = np.append(before, y[:-1])[:, None]
        trainer.window(np.zeros((1, HIDDEN), np.float32), x, y, new)
    return seen + held


def train(docs: DataFrame, vocab: Vocabulary, id_col: str, text_col: str) -> Network:
    """Rounds of training in every partition and averaging in a tree."""
    net = Network(vocab.all_counts)
    if not vocab.tokens:
        return net
    key = F.crc32(F.col(id_col).cast("string").cast("binary"))
    learns = F.coalesce(key % HELD_OUT != 0, F.lit(True))
    rows = docs.where(learns).select(F.pmod(F.xxhash64(id_col, text_col), F.lit(ROUNDS)).alias("turn"), F.col(text_col).cast("string").alias("text"))
    spec = "part bigint, weight double, blob binary"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, hasher = Network(vocab.all_counts), Hasher()
        own.load(start)

        def texts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                data, off = utf8(batch.column("text"))
                for lo, hi in slices(off):
                    yield _tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], hasher)

        weight = train_texts(own, vocab, texts())
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(weight)]), pa.array([own.flat().astype(np.float32).tobytes()], pa.binary())], names=["part", "weight", "blob"])

    def mean(key: tuple, rows: pa.Table) -> pa.Table:
        weights, out = rows["weight"].to_numpy(), 0.0
        for w, blob in zip(weights, rows["blob"], strict=True):
            out = out + np.frombuffer(blob.as_py(), np.float32).astype(np.float64) * w
        return pa.table({"part": pa.array([key[0].as_py()]), "weight": pa.array([float(weights.sum())]), "blob": pa.array([(out / weights.sum()).astype(np.float32).tobytes()], pa.binary())})

    for turn in range(ROUNDS):
        start = net.flat()
        parts = rows.where(F.col("turn") == turn).select("text").mapInArrow(learn, spec)
        n = max(2, rows.rdd.getNumPartitions())
        while n > 1:
            parts = parts.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part").applyInArrow(mean, spec)
            n = -(-n // FAN_IN)
        got = parts.select("blob").head()
        if got:
            net.load(np.frombuffer(got.blob, np.float32))
    return net


def document_scores(net: Network, ids: np.ndarray, first: np.ndarray, end: int, block: int = SAY_AT_ONCE) -> np.ndarray:
    """log10 probability of each document's symbols. All documents advance together, the longest first; the state is carried to the end."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    out, h = np.zeros(len(order)), np.zeros((len(order), HIDDEN), np.float32)
    before = np.full(len(order), end)
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), "left").tolist()
    states = np.empty((block + len(order), HIDDEN), np.float32)
    words, owners, held = np.empty(len(states), np.int64), np.empty(len(states), np.int64), 0
    nth = np.arange(len(order))

    def say() -> None:
        logp = net.predict(states[:held], words[:held])
        np.add(out, np.bincount(owners[:held], logp, len(out)), out=out)

    for t, live in enumerate(alive):
        h = net.step(h[:live], before[:live])
        before = ids.take(begin[:live] + t)
        to = held + live
        states[held:to], words[held:to], owners[held:to] = h, before, nth[:live]
        held = to
        if held >= block:
            say()
            held = 0
    if held:
        say()
    back = np.empty(len(order))
    back[order] = out / np.log(10)
    return back


class Scorer(Counter):
    def __init__(self, bits: int, net: Network, vocab: Vocabulary) -> None:
        super().__init__(bits)
        self.net, self.vocab = net, vocab

    def score(self, key: tuple, chunk: pa.Table, counts: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            names = [x.split()[0] for x in RESULT.split(", ")]
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            return pa.table([pa.array([], k) for k in kinds], names=names)
        self.read(chunk)
        times = np.zeros(len(self.known), np.int64)
        for b, blob in zip(counts["bucket"].to_pylist(), counts["blob"].to_pylist(), strict=True):
            times[self.edges[b] : self.edges[b + 1]] = unpack(blob)[0]
        base = self.vocab.base(times)
        kinds = self.vocab.ids(self.known)
        spelled = np.where(kinds == 0, base - self.vocab.rest, 0.0)
        docs = len(self.ids)
        doc = np.repeat(np.arange(docs), np.diff(self.first))
        per = lambda x: np.bincount(doc, x[self.back], docs)
        scores = document_scores(self.net, kinds[self.back], self.first, int(self.vocab.ids(np.array([END]))[0])) + per(spelled)
        longs = lambda x: pa.array(np.asarray(x).astype(np.int64))
        return pa.table({"doc_id": pa.array(self.ids, pa.int64()), "held_out": pa.array(self.held), "n_tokens": longs(np.diff(self.first)), "n_known": longs(per((times > 0).astype(np.float64))), "train_tokens": longs(np.full(docs, self.vocab.tokens)), "base_score": pa.array(per(base)), "score": pa.array(scores)})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each document."""
    bits = bucket_bits(docs.sparkSession)
    chunks, counter = chunked(docs, id_col, text_col, CHUNK_BYTES), Counter(bits)
    sent = chunks.groupBy("chunk").applyInArrow(lambda k, t: counter.send(k, t), PACKET)
    counts = cut(sent.groupBy("bucket").applyInArrow(lambda k, t: total(k, t), PACKET))
    vocab = vocabulary(counts)
    scorer = Scorer(bits, train(docs, vocab, id_col, text_col), vocab)
    answers = counts.where("kind = 0")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda k, a, b: scorer.score(k, a, b), RESULT)
