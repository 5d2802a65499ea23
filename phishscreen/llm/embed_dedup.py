"""Embedding near-dedup with a robust-pruned flat graph.

Vectors are compared inside their label. Equal vectors are one node from the start. Large groups of near copies, all within
half the threshold's angle of a centre, are met as groups: all their pairs link, others link with all of a group or none
where the angle to its centre tells, and are compared with its vectors one by one where it doesn't. The centres come from a
bounded sample, the groups hold all vectors near them, but for a few that stay in the graph. Centroids, fit on a sample too,
split what is left of each label into shards; every node goes to the shards of its few nearest centroids, so shards overlap. In a shard
each node picks neighbours from the nearest ones and some random ones by robust pruning: a candidate is dropped if an
already picked neighbour is much nearer to it than the node is. The lists of all shards of a node are united. Then every
node is searched for in each of its shards, over the united graph there: the shard's nodes and those neighbours of theirs
that lie in other shards but are near enough for a link to lead over them. Greedy beam search goes from the shard's medoid,
then the range expands from every node over the threshold to its neighbours until no new one is found. Whatever is found is
verified in double precision.

A shard's links are a matrix of bits; searches run for a few nodes at once and widen in steps of a bounded size, so a task's
memory grows with the size of a shard and not with its links. A link is counted in one of the shards that both nodes are in, the first by name, and only the sums of each node and edges
that span the links leave a shard; links of nodes without a common shard leave it one by one. A brute-force audit measures
recall, by link and by query, on some queries drawn from all nodes and some from those that have a link; below the target
the overlap doubles and the work is done again, and after the last overlap all pairs of each label are compared exactly, in
tiles. Where neither draw has a link, recall can't be measured, so all pairs are compared at once; that work grows with the
square of a label's vectors, and is met only where no shard holds a link.

Shards beyond a size are split into tiles, and each pair of tiles is a shard of its own, so that memory stays bounded and
no pair is lost.

Vectors that are null, zero, empty, or hold a null or non-finite component, and vectors without a label, link with
nothing and are their own component. Vectors of different length never link. Repeated rows are equal vectors: they link
with each other. A component's id is the smallest vec_id in it that is not null. An empty table gives an empty result;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut
from .components import components

THRESHOLD = 0.93
#: Rows of the sample that centroids are fit on, and rows that a shard is meant to own.
SAMPLE_ROWS, SHARD_ROWS = 20_000, 256
OVERLAP, MAX_SHARD = 3, 4096
DEGREE, POOL, RANDOM_POOL, ALPHA, BEAM = 24, 64, 32, 1.2, 32
#: Vectors that a group has at least, by the sample; rows of the sample that it has at least, and those that stay in the graph.
GROUP_ROWS, GROUP_SAMPLE, GROUP_KEPT = 256, 8, 4
#: Rows of a group, and of vectors to compare with it, that one task holds.
GROUP_TILE = 2048
#: Angles are told apart by no less.
SLACK = 1e-6
#: Bits of links, and neighbours, that are looked at in one step.
STEP = 1 << 20
#: Queries of each of the two draws of the audit.
AUDIT_QUERIES, TARGET_RECALL = 200, 0.95
LAST_OVERLAP = 24
#: Hashes that are tried as ids of the vectors until no two different vectors share one.
SALTS = 8


def _matrix(column) -> np.ndarray:
    """The vectors as rows of length one; all have the same number of components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def build(x: np.ndarray, seed: int = 5) -> tuple[list[np.ndarray], np.ndarray]:
    """Neighbours of each row by robust pruning, with the reverse edges, and the similarity of the nearest one."""
    n = len(x)
    rng, out = np.random.default_rng(seed), [[] for _ in range(n)]
    near, far, best = min(POOL, n - 1), min(RANDOM_POOL, n - 1), np.full(n, -1.0)
    for lo in range(0, n if n > 1 else 0, 256):
        sims = x[lo : lo + 256] @ x.T
        rows = np.arange(len(sims))
        sims[rows, lo + rows] = -2.0
        best[lo : lo + 256] = sims.max(axis=1)
        pool = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        pool = np.concatenate([pool, rng.integers(0, n, (len(sims), far))], axis=1)
        gap = 1 - np.take_along_axis(sims, pool, axis=1)
        gap[pool == (lo + rows)[:, None]] = np.inf
        order = np.argsort(gap, axis=1)
        pool, gap = np.take_along_axis(pool, order, axis=1), np.take_along_axis(gap, order, axis=1)
        alive = np.isfinite(gap)
        for _ in range(DEGREE):
            pick = np.argmax(alive, axis=1)
            some = alive[rows, pick]
            if not some.any():
                break
            chosen = pool[rows, pick]
            for i in np.flatnonzero(some).tolist():
                out[lo + i].append(int(chosen[i]))
            between = 1 - np.einsum("qpd,qd->qp", x[pool], x[chosen])
            alive &= ~(some[:, None] & (ALPHA * between <= gap)) & (np.arange(pool.shape[1]) != pick[:, None])
    back = [[] for _ in range(n)]
    for i, picked in enumerate(out):
        for j in picked:
            back[j].append(i)
    return [np.unique(np.array(a + b[:DEGREE], np.int64)) for a, b in zip(out, back, strict=True)], best


def _dots(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of row a[i] of x and row b[i] of y."""
    return np.concatenate([np.einsum("id,id->i", x[a[i : i + 16384]], y[b[i : i + 16384]]) for i in range(0, len(a), 16384)] or [np.zeros(0, x.dtype)])


def padded(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Lists, one after another in flat, as rows that are filled up with -1."""
    out = np.full((len(counts), max(1, int(counts.max(initial=0)))), -1, np.int32)
    out[np.arange(out.shape[1]) < counts[:, None]] = flat
    return out


def search(x: np.ndarray, near: np.ndarray, threshold: float, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) over the threshold: beam search from the medoid for all queries at once, then range expansion.
    near has the neighbours of each row, filled up with -1."""
    n, k, width = len(x), len(rows), near.shape[1]
    y = x.astype(np.float32)
    medoid = int(np.argmax(x @ x.sum(axis=0)))
    seen = np.zeros((k, n), bool)
    seen[:, medoid] = True
    beam, score, done = np.full((k, 1), medoid), (y[rows] @ y[medoid])[:, None], np.zeros((k, 1), bool)
    over = np.flatnonzero(score[:, 0] >= threshold - 1e-4)
    found = [(over, np.full(len(over), medoid))]
    for _ in range(4 * BEAM):
        open_score = np.where(done, -np.inf, score)
        best = np.argmax(open_score, axis=1)
        live = np.flatnonzero(np.isfinite(open_score[np.arange(k), best]))
        if not len(live):
            break
        done[live, best[live]] = True
        step = near[beam[live, best[live]]]
        fresh = (step >= 0) & ~seen[live[:, None], step]
        q, j = np.nonzero(fresh)
        node = step[q, j].astype(np.int64)
        seen[live[q], node] = True
        sim = np.full(step.shape, -np.inf, np.float32)
        sim[q, j] = got = _dots(y, node, y, rows[live[q]])
        found.append((live[q[got >= threshold - 1e-4]], node[got >= threshold - 1e-4]))
        more_score, more_beam = np.full((k, step.shape[1]), -np.inf, np.float32), np.zeros((k, step.shape[1]), np.int64)
        more_score[live], more_beam[live] = sim, step
        score, beam, done = np.concatenate([score, more_score], 1), np.concatenate([beam, more_beam], 1), np.concatenate([done, ~np.isfinite(more_score)], 1)
        if score.shape[1] > BEAM:
            top = np.argpartition(-score, BEAM - 1, axis=1)[:, :BEAM]
            score, beam, done = (np.take_along_axis(a, top, 1) for a in (score, beam, done))
    out, ahead = [], [tuple(np.concatenate([f[i] for f in found]) for i in (0, 1))]
    while ahead:
        q, node = ahead.pop()
        if len(q) > max(1, STEP // width):  # no more neighbours at once than a step has
            ahead += [(q[i : i + max(1, STEP // width)], node[i : i + max(1, STEP // width)]) for i in range(0, len(q), max(1, STEP // width))]
            continue
        out.append((q, node))
        step = near[node]
        i, j = np.nonzero((step >= 0) & ~seen[q[:, None], step])
        code = np.unique(q[i] * n + step[i, j])
        q, node = code // n, code % n
        seen[q, node] = True
        keep = _dots(y, node, y, rows[q]) >= threshold - 1e-4
        if keep.any():
            ahead.append((q[keep], node[keep]))
    q, node = (np.concatenate([h[i] for h in out]) for i in (0, 1))
    sure = (_dots(x, node, x, rows[q]) >= threshold) & (node != rows[q])
    return q[sure], node[sure]


def rows_of(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vec): label and vec are null for vectors that link with nothing; the label tells lengths apart too."""
    vec = F.col(vec_col).cast("array<double>")
    good = F.col(label_col).isNotNull() & F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0), F.lit(False))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, F.concat_ws(":", F.col(label_col).cast("string"), F.size(vec).cast("string"))).alias("label"), F.when(good, vec).alias("vec"))


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with node, a hash of label and vector, and the nodes (node, label, vec, times), which are equal vectors and no others."""
    for salt in range(SALTS):
        named = rows.withColumn("node", F.when(F.col("label").isNotNull(), F.xxhash64("label", "vec", F.lit(salt))))
        same = F.struct("label", "vec")
        nodes = named.where("node is not null").groupBy("node").agg(F.min(same).alias("low"), F.max(same).alias("high"), F.count("*").alias("times"))
        nodes = cut(nodes.select("node", "low.label", "low.vec", "times", (F.col("low") != F.col("high")).alias("clash")))
        if not nodes.where("clash").limit(1).count():
            return named, nodes.drop("clash")
    raise RuntimeError("hashes of vectors clash")


def _tiled(placed: DataFrame) -> DataFrame:
    """(shard, place, tile, ...) of (shard, node, ...): shards that fit are one place, of others each pair of tiles is one."""
    tiles = placed.groupBy("shard").agg(F.ceil(F.count("*") * 2 / MAX_SHARD).cast("int").alias("tiles"))
    tiles = tiles.withColumn("tiles", F.when(F.col("tiles") > 2, F.col("tiles")).otherwise(1))
    at = F.pmod(F.xxhash64("node", F.lit(3)), F.col("tiles")).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.concat_ws("/", "shard", F.least(o, "tile").cast("string"), F.greatest(o, "tile").cast("string")))
    return placed.join(tiles, "shard").withColumn("tile", at).withColumn("place", F.explode(places)).drop("tiles")


def _sample(nodes: DataFrame) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], float]:
    """The ids and vectors of a label's rows in a sample of SAMPLE_ROWS nodes by a hash, and the share of all nodes it is."""
    total, place = nodes.count(), F.xxhash64("node")
    if total > 2 * SAMPLE_ROWS:  # so that few rows more than the sample are sorted
        nodes = nodes.where(place < F.lit(int(-(2**63) + 1.5 * SAMPLE_ROWS / total * 2**64)))
    sample = nodes.orderBy(place, "node").limit(SAMPLE_ROWS).select("label", "node", "vec").toArrow()
    labels, ids = np.array(sample["label"].to_pylist(), dtype=object), sample["node"].to_numpy()
    at = {label: np.flatnonzero(labels == label) for label in sorted(set(labels.tolist()))}
    return {label: (ids[i], _matrix(sample["vec"].take(pa.array(i)))) for label, i in at.items()}, len(ids) / max(1, total)


def fit_groups(x: np.ndarray, half: float, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(centre, rows) of balls of that angle around their centre, the fullest first, that hold so many rows at least."""
    cos, live, out = np.cos(half), np.ones(len(x), bool), []
    near = lambda rows: np.concatenate([(x[i : i + 512] @ x[rows].T >= cos).sum(axis=1) for i in range(0, len(x), 512)])
    held = near(np.arange(len(x)))
    while held.max() >= least:
        seed = x[np.argmax(held)]
        mean = x[live & (x @ seed >= cos)].mean(axis=0)
        centre, ball = max(((c, np.flatnonzero(live & (x @ c >= cos))) for c in (seed, mean / np.linalg.norm(mean))), key=lambda b: len(b[1]))
        out.append((centre, ball))
        live[ball] = False
        held = np.where(live, held - near(ball), 0)
    return out


def _arcs(column, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_matrix(column) @ centres.T, -1.0, 1.0))


def grouped(nodes: DataFrame, threshold: float) -> DataFrame | None:
    """(label, node, times, vec, grp, n, whole, part): grp is the node that a group is named by, null in the graph; whole are
    the other groups that the node links with all of, part those whose nodes it has to be compared with; n are its links with
    its own group and the whole ones. None if there is no group."""
    reach = float(np.arccos(min(1.0, max(-1.0, threshold))))
    half = min(reach / 2, np.pi / 4) - SLACK
    sample, share = _sample(nodes) if half > 0 else ({}, 1.0)
    fitted, kept = {}, []
    for label, (ids, x) in sample.items():
        if balls := fit_groups(x, half, max(GROUP_SAMPLE, int(np.ceil(GROUP_ROWS * share)))):
            fitted[label] = np.array([ids[rows[0]] for _, rows in balls]), np.array([c for c, _ in balls])
            kept += [ids[rows[:GROUP_KEPT]] for _, rows in balls]
    if not fitted:
        return None
    stay = np.concatenate(kept)

    def owned(batch: pa.RecordBatch) -> Iterator[tuple]:
        """Rows of each label, the groups' names, the angles to their centres, and each row's own group or -1."""
        names = np.array(batch.column("label").to_pylist(), dtype=object)
        for label in sorted(set(names.tolist())):
            own = batch.take(pa.array(np.flatnonzero(names == label)))
            heads, centres = fitted.get(label, (np.zeros(0, np.int64), None))
            arc = np.zeros((own.num_rows, 0)) if centres is None else _arcs(own.column("vec"), centres)
            best = np.full(own.num_rows, -1) if centres is None else np.argmin(arc, axis=1)
            inside = (best >= 0) & ~np.isin(own.column("node").to_numpy(), stay)
            if len(heads):
                inside &= arc[np.arange(len(arc)), best] <= half
            yield own, heads, arc, np.where(inside, best, -1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, heads, arc, at in owned(batch):
                rows = np.flatnonzero(at >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(heads[at[rows]], pa.int64()), pa.array(arc[rows, at[rows]]), own.column("times").take(pa.array(rows))], names=["grp", "arc", "times"])

    sizes = nodes.select("label", "node", "times", "vec").mapInArrow(measure, "grp bigint, arc double, times bigint").groupBy("grp").agg(F.max("arc"), F.sum("times")).collect()
    radius, total = {r[0]: r[1] for r in sizes}, {r[0]: r[2] for r in sizes}

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, heads, arc, at in owned(batch):
                r, n = (np.array([d.get(h, least) for h in heads.tolist()], kind) for d, least, kind in ((radius, -4.0, float), (total, 0, np.int64)))
                other = (np.arange(len(heads)) != at[:, None]) & (r > -4)
                whole, mine = other & (arc + r <= reach - SLACK), at >= 0
                part = other & ~whole & (arc - r <= reach + SLACK)
                sums = whole @ n
                sums[mine] += n[at[mine]] - own.column("times").to_numpy()[mine]
                lists = [pa.array([heads[x].tolist() for x in ties], pa.list_(pa.int64())) for ties in (whole, part)]
                grp = np.zeros(len(at), np.int64)
                grp[mine] = heads[at[mine]]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("label", "node", "times", "vec")), pa.array(grp, mask=~mine), pa.array(sums, pa.int64()), *lists], names=["label", "node", "times", "vec", "grp", "n", "whole", "part"])

    kinds = "label string, node bigint, times bigint, vec array<double>, grp bigint, n bigint, whole array<bigint>, part array<bigint>"
    return cut(nodes.select("label", "node", "times", "vec").mapInArrow(tie, kinds))


def _compare(key: tuple, rows: pa.Table, threshold: float) -> pa.Table:
    """What a tile of a group returns: sums of links and edges to the group. A group's vectors get theirs with other groups'
    as those that ask, so here with vectors of no group only."""
    x, ids, times = _matrix(rows["vec"]), rows["node"].to_numpy(), rows["times"].to_numpy().astype(float)
    asks, own = rows["asks"].to_numpy(zero_copy_only=False).astype(bool), rows["rep"].to_numpy()
    free = (own == ids).astype(float)
    here, there, sums = np.flatnonzero(~asks), np.flatnonzero(asks), np.zeros(len(ids))
    for i in range(0, len(there) if len(here) else 0, 256):
        q = there[i : i + 256]
        hit = (x[q] @ x[here].T >= threshold).astype(float)
        sums[q] = hit @ times[here]
        sums[here] += (times[q] * free[q]) @ hit
    some, ends = np.flatnonzero(sums), np.unique(own[there[sums[there] > 0]])
    a, b = np.concatenate([ids[some], ends]), np.concatenate([ids[some], np.full(len(ends), key[0].as_py())])
    kinds = np.repeat([_SUM, _SPAN], [len(some), len(ends)]).astype(np.int32)
    return pa.table({"kind": pa.array(kinds), "a": pa.array(a), "b": pa.array(b), "n": pa.array(np.concatenate([sums[some].astype(np.int64), np.zeros(len(ends), np.int64)]))})


def group_links(ties: DataFrame, threshold: float) -> DataFrame:
    """What graph_links() returns first, of all links that an end in a group has, from what grouped() returns."""
    spark, rep = ties.sparkSession, F.coalesce("grp", "node").alias("rep")
    free = ties.where("grp is null")
    outside = free.select(F.explode("whole").alias("grp"), "times").groupBy("grp").agg(F.sum("times").alias("n"))
    sums = [ties.where("n > 0").select("node", "n"), ties.where("grp is not null").select("node", "grp").join(F.broadcast(outside), "grp").select("node", "n")]
    sums = [df.select(F.lit(_SUM).alias("kind"), F.col("node").alias("a"), F.col("node").alias("b"), "n") for df in sums]
    edges = ties.select(rep, F.explode("whole").alias("b")).distinct().select(F.lit(_SPAN).alias("kind"), F.col("rep").alias("a"), "b", F.lit(0).cast("long").alias("n"))
    found = sums[0].unionByName(sums[1]).unionByName(edges)
    # groups are few, as their centres come from the sample
    asked = {r[0]: r[1] for r in ties.select(F.explode("part").alias("b")).groupBy("b").count().collect()}
    held = {r[0]: r[1] for r in ties.where("grp is not null").groupBy("grp").count().collect()}
    tiles = [(b, -(-held[b] // GROUP_TILE), -(-n // GROUP_TILE)) for b, n in sorted(asked.items())]
    if tiles:
        dims = F.broadcast(spark.createDataFrame(tiles, "b bigint, tiles int, chunks int"))
        dealt = lambda df, name, size, salt: df.withColumn(name, F.pmod(F.xxhash64("node", F.lit(salt)), F.col(size)).cast("int"))
        each = lambda df, name, size: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(size) - 1)))
        row = ["node", rep, "times", "vec"]
        asks = each(dealt(ties.select(*row, F.explode("part").alias("b"), F.lit(True).alias("asks")).join(dims, "b"), "chunk", "chunks", 5), "tile", "tiles")
        holds = each(dealt(ties.where("grp is not null").select(*row, F.col("grp").alias("b"), F.lit(False).alias("asks")).join(dims, "b"), "tile", "tiles", 6), "chunk", "chunks")
        both = asks.unionByName(holds).drop("tiles", "chunks")
        found = found.unionByName(both.groupBy("b", "tile", "chunk").applyInArrow(lambda k, t: _compare(k, t, threshold), _FOUND))
    return cut(found)


def _shards(nodes: DataFrame, overlap: int) -> DataFrame:
    """(shard, place, tile, homes, node, times, vec): each node in the shards of its nearest centroids, its homes."""
    sizes = {r["label"]: r["count"] for r in nodes.groupBy("label").count().orderBy(F.desc("count"), "label").limit(SAMPLE_ROWS).collect()}
    # labels that the sample misses have one shard, which is tiled if it is large
    fitted = {label: fit_centroids(x, min(-(-sizes.get(label, 1) // SHARD_ROWS), max(1, len(x) // 4))) for label, (_, x) in _sample(nodes)[0].items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("label").to_pylist(), dtype=object)
            for label in sorted(set(names.tolist())):
                own = batch.take(pa.array(np.flatnonzero(names == label)))
                c = fitted.get(label)
                near = np.zeros((own.num_rows, 1), np.int64) if c is None else np.argsort(-(_matrix(own.column("vec")) @ c.T), axis=1)[:, :overlap]
                homes = pa.array([[f"{label}/{i}" for i in x] for x in near.tolist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([homes, *(own.column(c) for c in ("node", "times", "vec"))], names=["homes", "node", "times", "vec"])

    placed = nodes.select("label", "node", "times", "vec").mapInArrow(assign, "homes array<string>, node bigint, times bigint, vec array<double>")
    return cut(_tiled(cut(placed).withColumn("shard", F.explode("homes"))))


def _build_place(key: tuple, rows: pa.Table, threshold: float) -> pa.Table:
    """(node, near, close, linked): close are the neighbours over which a link may lead to another shard: what both ends of a
    path of two links may be apart."""
    ids, x = rows["node"].to_numpy(), _matrix(rows["vec"])
    lists, best = build(x)
    reach = 2 * threshold * threshold - 1 if threshold > 0 else -1.0
    close = [a[np.einsum("id,d->i", x[a], x[i]) >= reach - 1e-9] for i, a in enumerate(lists)]
    longs = lambda found: pa.array([ids[a].tolist() for a in found], pa.list_(pa.int64()))
    return pa.table({"node": pa.array(ids), "near": longs(lists), "close": longs(close), "linked": pa.array(best >= threshold)})


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that row i of a and row i of b have in common; rows are filled up with -1, which counts as none."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for c in a.T:
        both = (b == c[:, None]).any(axis=1) & (c >= 0)
        out[both] = np.minimum(out[both], c[both])
    return out


def _spanning(links: np.ndarray) -> np.ndarray:
    """The first node that each node reaches, by a symmetric matrix of links."""
    root = np.full(len(links), -1)
    for i in range(len(links)):
        front = np.array([i] if root[i] < 0 else [], np.int64)
        while len(front):
            root[front] = i
            front = np.flatnonzero(np.logical_or.reduce([links[front[k : k + 256]].any(axis=0) for k in range(0, len(front), 256)]) & (root < 0))
    return root


#: What a place returns: sums of links (a, n), edges that span them, links over shards, and numbers of links of audited
#: queries (a, n).
_SUM, _SPAN, _CROSS, _ASKED = range(4)


def _links_in(key: tuple, rows: pa.Table, threshold: float, asked: np.ndarray, exact: bool) -> pa.Table:
    if not exact:  # the place's own nodes first
        rows = rows.take(pa.array(np.argsort(~rows["own"].to_numpy(zero_copy_only=False).astype(bool), kind="stable")))
    ids, x, times = rows["node"].to_numpy(), _matrix(rows["vec"]), rows["times"].to_numpy()
    tile, shard, n = rows["tile"].to_numpy(), rows["shard"][0].as_py(), len(rows)
    m, near = n, None
    if not exact:
        m = int(rows["own"].to_numpy(zero_copy_only=False).astype(bool).sum())
        flat, counts = rows["near"].combine_chunks(), rows["near"].combine_chunks().value_lengths().to_numpy()
        flat = flat.flatten().to_numpy()
        order = np.argsort(ids)
        at = order[np.minimum(np.searchsorted(ids, flat, sorter=order), n - 1)]
        there = ids[at] == flat
        near = padded(at[there], np.bincount(np.repeat(np.arange(n), counts)[there], minlength=n))
    # few rows at once, so that no more of them are listed than a step has
    height = max(1, min(512, 2 * STEP // n))
    hit = np.zeros((m, n), bool)
    for lo in range(0, m, height):
        queries = np.arange(lo, min(m, lo + height))
        if exact:
            hit[queries] = x[queries] @ x.T >= threshold
        else:
            q, node = search(x, near, threshold, queries)
            hit[queries[q], node] = True
    own = hit[:, :m]
    for lo in range(0, m, 512):  # who is found finds too
        own[lo : lo + 512, lo:] |= own[lo:, lo : lo + 512].T
        own[lo:, lo : lo + 512] = own[lo : lo + 512, lo:].T
    hit[np.arange(m), np.arange(m)] = False
    names, homes = rows["homes"].to_pylist(), np.full((n, max(map(len, rows["homes"].to_pylist()))), -1)
    code = {name: i for i, name in enumerate(sorted({h for x in names for h in x} | {shard}))}
    for i, held in enumerate(names):
        homes[i, : len(held)] = [code[h] for h in held]
    # a tiled shard has a place for each pair of tiles: the pair's own one counts it
    low, high = (int(t) for t in key[0].as_py().rsplit("/", 2)[1:])
    sums, partners, cross = np.zeros(n), np.zeros(n, np.int64), []
    for lo in range(0, m, height):
        a, b = np.nonzero(hit[lo : lo + height])
        a += lo
        a, b = a[a < b], b[a < b]
        here = _first_common(homes[a], homes[b])
        over = here == np.iinfo(np.int64).max
        cross.append((a[over], b[over]))
        counted = (here == code[shard]) & (b < m) & (np.minimum(tile[a], tile[b]) == low) & (np.maximum(tile[a], tile[b]) == high)
        a, b = a[counted], b[counted]
        sums += np.bincount(a, times[b], n) + np.bincount(b, times[a], n)
        partners += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    root = _spanning(own)
    some, ask, span = np.flatnonzero(sums), np.flatnonzero((partners > 0) & np.isin(ids, asked)), np.flatnonzero(root != np.arange(m))
    parts = [(kind, ids[i], ids[i], n[i].astype(np.int64)) for kind, i, n in ((_SUM, some, sums), (_ASKED, ask, partners))]
    for kind, i, j in ((_SPAN, root[span], span), (_CROSS, *(np.concatenate([c[k] for c in cross]) for k in (0, 1)))):
        parts.append((kind, np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), np.zeros(len(i), np.int64)))
    kinds = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]).astype(np.int32)
    a, b, n = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    return pa.table({"kind": pa.array(kinds), "a": pa.array(a), "b": pa.array(b), "n": pa.array(n)})


_FOUND = "kind int, a bigint, b bigint, n bigint"


def graph_links(nodes: DataFrame, threshold: float, overlap: int) -> tuple[DataFrame, DataFrame]:
    """What the places return, and the audit's queries (node, label, vec)."""
    shards = _shards(nodes, overlap)
    built = cut(shards.groupBy("place").applyInArrow(lambda k, t: _build_place(k, t, threshold), "node bigint, near array<bigint>, close array<bigint>, linked boolean"))
    merged = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    united = cut(built.groupBy("node").agg(merged("near"), merged("close"), F.max("linked").alias("linked")))
    draw = lambda df: df.orderBy(F.xxhash64("node", F.lit(9)), "node").limit(AUDIT_QUERIES).select("node")
    asked = cut(draw(united).union(draw(united.where("linked"))).distinct())
    ids = np.array([r.node for r in asked.collect()], np.int64)
    members = shards.join(united.select("node", "near", "close"), "node")
    # neighbours in other shards, near enough for a link to lead over them; each pair in a tiled shard has a place of its own
    seats = shards.select("shard", "node")
    ring = members.select("shard", "place", F.explode("close").alias("node")).distinct().join(seats, ["shard", "node"], "left_anti")
    homes = nodes.select("node", "times", "vec").join(shards.select("node", "homes").dropDuplicates(["node"]), "node")
    ring = ring.join(homes, "node").join(united.select("node", "near"), "node").withColumn("tile", F.lit(-1)).withColumn("own", F.lit(False))
    columns = ["shard", "place", "tile", "homes", "node", "times", "vec", "near", "own"]
    rows = members.withColumn("own", F.lit(True)).select(*columns).unionByName(ring.select(*columns))
    return cut(rows.groupBy("place").applyInArrow(lambda k, t: _links_in(k, t, threshold, ids, False), _FOUND)), nodes.join(F.broadcast(asked), "node")


def exact_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """What graph_links() returns first, by comparing all pairs of each label in pairs of tiles."""
    rows = _tiled(nodes.select(F.col("label").alias("shard"), F.array("label").alias("homes"), "node", "times", "vec"))
    return cut(rows.groupBy("place").applyInArrow(lambda k, t: _links_in(k, t, threshold, np.zeros(0, np.int64), True), _FOUND))


def audit(nodes: DataFrame, found: DataFrame, asked: DataFrame, threshold: float) -> float | None:
    """The share of the queries' links that were found, by link or the mean by query, whichever is less; None if they have none.
    The queries are few and fixed by a hash; they are compared with every node."""
    asked = asked.select("node", "label", "vec").collect()
    labels = np.array([r.label for r in asked], dtype=object)
    own = {label: (np.array([r.node for r in asked if r.label == label]), _matrix(pa.array([r.vec for r in asked if r.label == label]))) for label in set(labels.tolist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("label").to_pylist(), dtype=object)
            for label, (ids, x) in own.items():
                rows = np.flatnonzero(names == label)
                if len(rows):
                    there = batch.take(pa.array(rows))
                    n, q = np.nonzero(_matrix(there.column("vec")) @ x.T >= threshold)
                    held = np.bincount(q[ids[q] != there.column("node").to_numpy()[n]], minlength=len(ids))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[held > 0]), pa.array(held[held > 0])], names=["query", "links"])

    truth = nodes.select("node", "label", "vec").mapInArrow(run, "query bigint, links bigint").groupBy("query").agg(F.sum("links").alias("links"))
    # found links are verified, so their number tells how many are missing
    cross = found.where(f"kind = {_CROSS}").select("a", "b").distinct().select(F.explode(F.array("a", "b")).alias("query"), F.lit(1).alias("n"))
    got = found.where(f"kind = {_ASKED}").select(F.col("a").alias("query"), "n").unionByName(cross).groupBy("query").agg(F.sum("n").alias("hits"))
    by = truth.join(got, "query", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    r = by.agg(F.sum("hits") / F.sum("links"), F.avg(F.col("hits") / F.col("links"))).first()
    return None if r[0] is None else min(r)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each vector."""
    rows, every = numbered(cut(rows_of(vectors, id_col, vec_col, label_col)))
    ties = grouped(every, threshold)
    nodes = every if ties is None else ties.where("grp is null").select("node", "label", "vec", "times")
    overlap = OVERLAP
    while True:
        found, asked = graph_links(nodes, threshold, overlap)
        recall = audit(nodes, found, asked, threshold)
        if recall is not None and recall >= TARGET_RECALL:
            break
        if recall is None or overlap >= LAST_OVERLAP:
            found = exact_links(nodes, threshold)
            break
        overlap *= 2
    if ties is not None:
        found = found.unionByName(group_links(ties, threshold))
    times = every.select("node", "times", F.col("node").alias("rep")) if ties is None else ties.select("node", "times", F.coalesce("grp", "node").alias("rep"))
    cross = cut(found.where(f"kind = {_CROSS}").select("a", "b").distinct())
    ways = cross.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(cross.select(F.col("b").alias("node"), F.col("a").alias("other")))
    sums = found.where(f"kind = {_SUM}").select(F.col("a").alias("node"), "n")
    links = sums.unionByName(ways.join(times.select(F.col("node").alias("other"), "times"), "other").select("node", F.col("times").alias("n"))).groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(found.where(f"kind in ({_SPAN}, {_CROSS})").select("a", "b")).withColumnRenamed("node", "rep")
    out = rows.select("vec_id", "node").join(times, "node", "left").join(links, "node", "left").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = out.where("node is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    out = out.join(least, "component", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    n_links = F.when(F.col("node").isNull(), F.lit(0)).otherwise(F.col("times") - 1 + F.coalesce("n", F.lit(0))).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
