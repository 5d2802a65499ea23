import numpy as np

from phishscreen.llm import quality

SCHEMA = "good boolean, " + ", ".join(f"{c} double" for c in quality.FEATURES)


def rows(n):
    rng = np.random.default_rng(3)
    x = rng.normal(0.3, 0.05, (n, 7)) + (np.arange(n) % 10 == 0)[:, None] * 0.5
    return x, np.arange(n) % 10 != 0


def table(spark, x, good, parts=4):
    return spark.createDataFrame([(bool(g), *map(float, r)) for r, g in zip(x, good, strict=True)], SCHEMA).repartition(parts)


def test_path_lengths():
    harmonic = lambda n: sum(1 / k for k in range(1, n + 1))
    assert np.allclose(quality._c([0, 0.5, 1]), 0, atol=1e-9)
    assert np.allclose(quality._c([2, 3, 256]), [2 * harmonic(n - 1) - 2 * (n - 1) / n for n in (2, 3, 256)], atol=1e-7)


def test_every_labelled_row_is_counted(spark):
    """The counts in the trees are those of all good rows, and the threshold is the best one over the scores of all rows."""
    x, good = rows(3000)
    model = quality.Model.fit(table(spark, x, good))
    drawn = quality.Forest.drawn(x.min(0), x.max(0), quality.TREE_ROWS)
    counts = {}
    for t, at in enumerate(drawn.leaves(x[good])):
        for node in at:
            counts[t, int(node)] = counts.get((t, int(node)), 0) + 1
    plain = drawn.counted(counts, int(good.sum()))
    assert all(np.array_equal(a, b) for one, two in zip(model.forest.trees, plain.trees, strict=True) for a, b in zip(one, two, strict=True))
    score = plain.scores(x)
    assert set(range(len(drawn.trees))) == {t for t, _ in counts} and sum(counts.values()) == good.sum() * len(drawn.trees)
    gain = lambda cut: (score[~good] > cut).mean() - (score[good] > cut).mean()
    allowed = [c for c in np.arange(1, quality.SCORE_STEPS) / quality.SCORE_STEPS if (score[good] >= c).mean() <= quality.MAX_FALSE_REJECT]
    assert gain(model.threshold) == max(gain(np.nextafter(c, 0)) for c in allowed) > 0.9
    again = quality.Model.fit(table(spark, x[::-1], good[::-1], 2))
    assert again.threshold == model.threshold


def test_labelled_rows_beyond_twenty_thousand_count(spark):
    """The last tenth of 22,000 labelled rows was left out before, wherever its hashes put it."""
    n = 22_000
    stats = spark.range(n).selectExpr("id as doc_id", *[f"cast({60 if c == 'n_words' else 300 if c == 'n_chars' else 0} as bigint) as {c}" for c in quality.STATS])
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    found = quality.labelled(stats, labels).groupBy("good").count().collect()
    assert {r.good: r["count"] for r in found} == {True: n // 2, False: n // 2}


def test_labels_of_one_kind_give_no_model(spark):
    x, _ = rows(50)
    for good in (np.ones(50, bool), np.zeros(50, bool)):
        assert quality.Model.fit(table(spark, x, good)).forest is None
    assert quality.Model.fit(table(spark, np.full((20, 7), 0.5), np.arange(20) < 10)).forest is None
