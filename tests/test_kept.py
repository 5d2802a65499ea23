from datetime import datetime

import pytest
from pyspark.sql import functions as F

from phishscreen.operators import evaluate
from phishscreen.operators.rules import RULES
from phishscreen.plans import kept, queries
from phishscreen.plans.screen import scored
from phishscreen.plans.settings import Settings
from phishscreen.sources import runs
from phishscreen.sources.schemas import MESSAGES


def _message(key, sender="info@jgdyyt.shop", subject="amazon", body="hello", name="Amazon"):
    headers = {"from": [f"{name} <{sender}>"], "subject": [subject]}
    return (key, f"<{key}@x>", "box", "spam", datetime(2024, 1, 1), None, None, headers, [{"content_type": "text/plain", "body": body}], None)


def _mail(spark, rows):
    return spark.createDataFrame(rows, MESSAGES)


def _by_key(df):
    return sorted((r.msg_key or "", r.score, [tuple(h) for h in r.rule_hits]) for r in df.select("msg_key", "score", "rule_hits").collect())


def test_only_new_content_is_read_for_features(spark, tmp_path, monkeypatch):
    path, first = str(tmp_path / "hits"), [_message(f"m{i}", subject=f"s{i % 3}") for i in range(6)]
    assert kept.update(_mail(spark, first), path) == 3
    calls = []
    monkeypatch.setattr(kept, "featured", lambda m, *a: calls.append(m.count()) or featured(m, *a))
    from phishscreen.plans.screen import featured

    files = sorted(p.name for p in (tmp_path / "hits").rglob("*.parquet"))
    assert kept.update(_mail(spark, first), path) == 0 and calls == []
    assert sorted(p.name for p in (tmp_path / "hits").rglob("*.parquet")) == files
    more = [*first, _message("new", sender="a@example.com", name="x"), (None, None, None, None, None, None, None, None, None, None)]
    assert kept.update(_mail(spark, more), path) == 2 and calls == [2]
    assert _by_key(kept.scores(_mail(spark, more), path)) == _by_key(scored(_mail(spark, more)))
    unknown = kept.scores(_mail(spark, [_message("other", body="other")]), path).first()
    assert unknown.score is None and unknown.rule_hits is None


def test_versions_and_weights(spark, tmp_path):
    path, mail = str(tmp_path / "hits"), _mail(spark, [_message("a"), _message("b", sender="me@own.example")])
    assert kept.version() == kept.version() != kept.version(Settings(self_domains=("own.example",)))
    assert len({kept.version(), kept.version(Settings(fix_raw_ip=True)), kept.version(decode_words=False), kept.version(rules=RULES[1:])}) == 4
    assert kept.version(Settings(spam_threshold=60)) == kept.version()
    assert kept.update(mail, path) == 2
    assert kept.scores(mail, path, Settings(self_domains=("own.example",))).where("score is not null").count() == 0
    assert kept.update(mail, path, Settings(self_domains=("own.example",))) == 2
    got = _by_key(kept.scores(mail, path, Settings(self_domains=("own.example",))))
    assert got == _by_key(scored(mail, Settings(self_domains=("own.example",))))
    none = kept.scores(mail, path, weights={r.id: 0 for r in RULES})
    assert {r.score for r in none.collect()} == {0} and "bodies" not in none.columns
    # a content stored twice, as two updates at the same time do, is read once
    once = spark.read.schema(kept.HITS).parquet(path).where(F.col("version") == kept.version())
    once.write.mode("append").partitionBy("version").parquet(path)
    assert kept.scores(mail, path).count() == 2


def test_an_empty_table(spark, tmp_path):
    empty = _mail(spark, [])
    assert kept.update(empty, str(tmp_path / "hits")) == 0
    assert kept.scores(empty, str(tmp_path / "hits")).count() == 0


@pytest.fixture
def stored(spark, tmp_path):
    names = []

    def store(run, buckets=4):
        names.append(f"run_{tmp_path.name}_{len(names)}".replace("-", "_"))
        runs.store_run(run, names[-1], buckets, str(tmp_path / names[-1]))
        return names[-1]

    yield store
    for name in names:
        spark.sql(f"drop table {name}")


def _run(spark, rows):
    return spark.createDataFrame(rows, "key string, label string, model_score int, final_score int, detail map<string,double>, from_domain string, subject string")


def test_stored_runs_are_compared_without_a_shuffle(spark, stored):
    old = _run(spark, [(f"phish:<{i}@x>:40", "phish", 30, 40 + i % 30, {"q": 0.5}, "d", "s") for i in range(200)] + [("ham:a:b:40", "ham", 10, 20, None, None, None), (None, "ham", 1, 1, None, None, None)])
    new = _run(spark, [(f"phish:<{i}@x>:4{j}", "phish", 60 + j, 40 + i % 20, {"q": 0.7}, "d", "s") for i in range(0, 250, 2) for j in (1, 2)] + [("ham:a:b:41", "ham", None, None, None, None, None)])
    pairs = runs.compare_stored(spark, stored(old), stored(new))
    assert sorted(map(str, pairs.collect())) == sorted(map(str, evaluate.compare_runs(old, new).select(*pairs.columns).collect()))
    assert pairs.count() == 100
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Window" not in plan
    assert evaluate.conclusion(pairs).collect() == evaluate.conclusion(evaluate.compare_runs(old, new)).collect()


def test_stored_runs_of_other_buckets_and_empty_ones(spark, stored):
    run = _run(spark, [(f"phish:{i}:40", "phish", 30, 40, None, "d", "s") for i in range(20)])
    a, b, none = stored(run, 4), stored(run, 3), stored(_run(spark, []))
    assert runs.compare_stored(spark, a, b).count() == 20
    assert runs.compare_stored(spark, a, none).count() == 0


def test_mail_is_written_once_and_fingerprints_are_made_once(spark, sf_dir, monkeypatch):
    plans, feature = [], kept.featured
    monkeypatch.setattr(kept, "featured", lambda m, *a: plans.append(m) or feature(m, *a))
    queries.QUERIES["kept_scores"](spark, sf_dir)
    first, second = [m._jdf.queryExecution().optimizedPlan().toString() for m in plans]
    assert not any(sf_dir in f for m in plans for f in m.inputFiles())
    assert first.count("sha2(") == 1 and second.count("sha2(") == 1 and "Join LeftSemi" in second


def test_rows_written_keep_their_schema(spark):
    rows = _mail(spark, [_message("a"), (None, None, None, None, None, None, None, None, None, None)])
    again = runs.written(rows)
    assert again.schema == rows.schema and sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    assert runs.written(_mail(spark, [])).schema == rows.schema
