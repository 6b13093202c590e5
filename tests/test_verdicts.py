"""The verdict store: one verdict a key whatever fails, lookups that leave it where it is."""

import pytest

from rulegrain.sources.verdicts import KEY, VERDICTS, VerdictStore


def rows(spark, *some):
    return spark.createDataFrame(some, VERDICTS)


def test_one_verdict_a_key(spark, tmp_path, monkeypatch):
    store = VerdictStore(spark, str(tmp_path / "kept"), buckets=4)
    assert store.read().count() == 0 and store.current() is None
    first = rows(spark, ("r1", "c1", "m", "followed", "e"), ("r1", "c1", "m", "violated", "e"), ("r2", "c1", "m", "violated", "x"), (None, "c", "m", "followed", "e"))
    # killed when the rows are there and the file that names them isn't
    monkeypatch.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.keep(first)
    assert store.read().count() == 0
    monkeypatch.undo()
    assert store.keep(first) == 1
    assert store.keep(first) == 2  # a repeated run
    assert store.keep(rows(spark, ("r1", "c1", "m", "violated", "later"), ("r1", "c1", "n", "followed", None))) == 3
    want = {("r1", "c1", "m", "followed", "e"), ("r2", "c1", "m", "violated", "x"), ("r1", "c1", "n", "followed", None)}
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted(want, key=str)
    again = VerdictStore(spark, str(tmp_path / "kept"), buckets=99)
    assert {tuple(r) for r in again.read().collect()} == want and again.current()["buckets"] == 4


def test_another_writer(spark, tmp_path):
    store = VerdictStore(spark, str(tmp_path / "kept"), buckets=2)
    store.keep(rows(spark, ("r", "c", "m", "followed", "e")))
    stale = store.current() | {"folder": "gen-other"}
    with pytest.raises(RuntimeError):
        store._commit({"generation": 9, "folder": "x", "buckets": 2}, stale)
    assert store.current()["generation"] == 1


def test_lookups_move_only_what_is_asked(spark, tmp_path):
    store = VerdictStore(spark, str(tmp_path / "kept"), buckets=4)
    store.keep(spark.range(2000).selectExpr("concat('r', id) rule_hash", "'c' chunk_id", "'m' model", "'followed' verdict", "'e' evidence"))
    asked = spark.range(500).selectExpr("concat('r', id * 5) rule_hash", "substr(concat('c', id), 1, 1) chunk_id", "substr(concat('m', id), 1, 1) model")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = asked.join(store.read(), KEY, "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert joined.filter("verdict is not null").count() == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
