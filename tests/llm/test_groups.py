"""Dense groups of near copies in op7: counted whole, and in bounded memory."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from phishscreen.llm import embed_dedup

from .helpers import union_find
from .test_others import vectors


def test_links_of_a_dense_place_take_bounded_memory():
    """2000 near copies link in two million pairs; their neighbours' lists have some hundred million entries."""
    rng, n = np.random.default_rng(2), 2000
    x = rng.standard_normal(64) + rng.standard_normal((n, 64)) * 0.1
    ids = np.arange(n) * 3
    near, _ = embed_dedup.build(embed_dedup._matrix(pa.array(x.tolist())))
    rows = {"shard": ["1:64/0"] * n, "place": ["1:64/0/0/0"] * n, "tile": pa.array([0] * n, pa.int32()), "homes": [["1:64/0"]] * n, "node": ids, "times": [1 + i % 2 for i in range(n)]}
    rows = pa.table(rows | {"vec": x.tolist(), "near": [ids[a].tolist() for a in near], "own": [True] * n})
    tracemalloc.start()
    got = embed_dedup._links_in((pa.scalar("1:64/0/0/0"),), rows, 0.93, np.zeros(0, np.int64), False)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 250, peak
    sums = {a: n for kind, a, _, n in zip(*(got[c].to_pylist() for c in got.column_names), strict=True) if kind == embed_dedup._SUM}
    assert sums == {3 * i: 3000 - (1 + i % 2) for i in range(n)}
    span = [(a, b) for kind, a, b in zip(*(got[c].to_pylist() for c in ("kind", "a", "b")), strict=True) if kind == embed_dedup._SPAN]
    assert len(span) == n - 1 and set(union_find(ids.tolist(), span).values()) == {0}


def test_neighbours_are_padded():
    got = embed_dedup.padded(np.array([4, 5, 6]), np.array([2, 0, 1]))
    assert got.tolist() == [[4, 5], [-1, -1], [6, -1]]
    assert embed_dedup.padded(np.array([], np.int64), np.array([0, 0])).tolist() == [[-1], [-1]]


def turned(axis, other, degrees):
    return np.cos(np.radians(degrees)) * axis + np.sin(np.radians(degrees)) * other


@pytest.mark.parametrize("tile", [2048, 16])
def test_groups_links_are_brute_force(spark, monkeypatch, tile):
    """Groups in one label: a tight one, one that all of it links with, one that only parts link with, and single vectors whole
    in reach of it, partly, and not; equal vectors in and outside of groups."""
    for name, value in (("GROUP_ROWS", 24), ("GROUP_TILE", tile)):
        monkeypatch.setattr(embed_dedup, name, value)
    rng = np.random.default_rng(12)
    e = np.linalg.qr(rng.standard_normal((16, 16)))[0]
    noisy = lambda c, s: c + rng.standard_normal(16) * s
    points = [(noisy(e[0], 0.01), 1) for _ in range(60)] + [(noisy(turned(e[0], e[1], 14), 0.01), 1) for _ in range(50)]
    points += [(noisy(turned(e[0], e[1], 34), 0.02), 1) for _ in range(50)] + [(noisy(e[5], 0.045), 1) for _ in range(60)]
    points += [(turned(e[0], e[3], a), 1) for a in (12, 19, 20, 21, 22, 23, 30)] + [(noisy(e[0], 0.01), 2) for _ in range(40)]
    points += [points[3], points[3], points[70]] + [(rng.standard_normal(16), 1) for _ in range(40)]
    pairs = rng.standard_normal((40, 16))
    points += [(noisy(p, 0.02), 1) for p in pairs for _ in range(2)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(points)]
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    labels = np.array([label for *_, label in rows])
    hit = (unit @ unit.T >= 0.93) & (labels[:, None] == labels)
    links = [(a, b) for a, b in np.argwhere(hit).tolist() if a < b]
    count, root = Counter(x for pair in links for x in pair), union_find(range(len(rows)), links)
    nodes = embed_dedup.numbered(embed_dedup.cut(embed_dedup.rows_of(vectors(spark, rows), "vec_id", "embedding", "label")))[1]
    ties = embed_dedup.grouped(nodes, 0.93)
    assert ties.where("grp is not null").count() > 150 and ties.where("grp is null").count() < 250
    assert ties.where("size(whole) > 0").count() and ties.where("grp is null and size(part) > 0").count() and ties.where("grp is not null and size(part) > 0").count()
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert [got[i].n_links for i in range(len(rows))] == [count[i] for i in range(len(rows))]
    assert [got[i].component_id for i in range(len(rows))] == [root.get(i, i) for i in range(len(rows))]


def test_vectors_far_apart_have_no_groups():
    x = np.random.default_rng(1).standard_normal((300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert embed_dedup.fit_groups(x, 0.18, 8) == []
    x[:20] = x[0]
    (centre, rows), = embed_dedup.fit_groups(x, 0.18, 8)
    assert rows.tolist() == list(range(20)) and np.allclose(centre, x[0])
