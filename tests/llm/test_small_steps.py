"""Steps on few rows leave few files."""

from phishscreen.llm import base, components


def test_components_of_few_edges_leave_few_partitions(spark, monkeypatch):
    released = []
    monkeypatch.setattr(components, "release", released.append, raising=False)
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21), (30, 30)], "a bigint, b bigint").repartition(40)
    got = components.components(edges)
    assert {(r.node, r.component) for r in got.collect()} == {(i, 0) for i in range(10)} | {(20, 20), (21, 20)}
    assert len(released) >= 2  # once a round
    kept = base.fitted(base.cut(edges))
    assert kept.rdd.getNumPartitions() == 1 and sorted(kept.collect()) == sorted(edges.collect())
    assert base.fitted(base.cut(edges), 4).rdd.getNumPartitions() == 3
