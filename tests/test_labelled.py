import pytest

from phishscreen.plans import queries
from phishscreen.testmail import spread


@pytest.fixture
def scored(monkeypatch):
    seen, score = [], queries.plan.scored

    def watch(messages, *rest):
        seen.append(messages)
        return score(messages, *rest)

    monkeypatch.setattr(queries.plan, "scored", watch)
    return seen


@pytest.mark.parametrize("name", ["run_transitions", "unanswered_cases", "evaluation_cases", "threshold_sweep", "false_positives", "missed_sample"])
def test_labelled_messages_are_scored_once_and_no_others(spark, sf_dir, scored, name):
    queries.QUERIES[name](spark, sf_dir)
    (once,) = scored
    labels = {r.label for r in once.select("label").distinct().collect()}
    assert labels == {"spam", "ham"} and "ArrowEvalPython" not in once._jdf.queryExecution().executedPlan().toString()


def test_scores_of_cases_are_read_back_not_made_again(spark, sf_dir):
    plan = queries.QUERIES["run_over_change"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "InMemoryRelation" not in plan


def test_a_table_of_many_tasks_is_not_dealt_out(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(400_000).selectExpr("id", "sha2(cast(id as string), 256) as x").coalesce(1).write.option("parquet.block.size", 1 << 20).parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        table = spark.read.parquet(path)
        assert len(table.inputFiles()) == 1 and spread(table) is table
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    few = spread(spark.range(10, numPartitions=1))
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
