"""Changes of a shared table: what a crash or another writer between two steps leaves."""

import pytest
from pyspark.sql import functions as F

from propwell.operators import state_log
from propwell.operators.state_log import StateChanged, StateLog

COLUMNS = "id STRING, status STRING, n BIGINT"


@pytest.fixture
def log(spark, tmp_path):
    return StateLog(spark, str(tmp_path / "table"), COLUMNS, "id")


def rows(log):
    return {r.id: (r.status, r.n) for r in log.read().collect()}


def put(log, *values):
    made = log.spark.createDataFrame(list(values), COLUMNS)
    return log.update(lambda _: made)


def test_newest_row_of_a_key_counts(log):
    assert log.version() == 0 and rows(log) == {}
    assert put(log, ("a", "x", 1), ("b", "x", 1)) == 1
    assert put(log, ("a", None, 2)) == 2
    assert rows(log) == {"a": (None, 2), "b": ("x", 1)}
    assert {r.id: r.n for r in log.read(1).collect()} == {"a": 1, "b": 1}


def test_a_stop_between_the_steps_leaves_the_table(log, monkeypatch):
    put(log, ("a", "x", 1))

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(StateLog, "_commit", stop)
    with pytest.raises(KeyboardInterrupt):
        put(log, ("a", "y", 2))
    monkeypatch.undo()
    assert rows(log) == {"a": ("x", 1)}
    put(log, ("a", "z", 3))
    assert rows(log) == {"a": ("z", 3)}


def test_two_writers_lose_no_change(log):
    put(log, ("a", "x", 0))
    state = log.version()
    late = log.read(state).withColumn("status", F.lit("late"))
    turns = []

    def add(now):
        if not turns:  # another writer commits after this one has read
            log.update(lambda other: other.withColumn("status", F.lit("other")))
        turns.append(1)
        return now.withColumn("n", F.col("n") + 1)

    log.update(add)
    assert len(turns) == 2 and rows(log) == {"a": ("other", 1)}
    with pytest.raises(StateChanged):
        log.commit(late, state)
    assert rows(log) == {"a": ("other", 1)}


def test_compaction_keeps_the_state(log, monkeypatch):
    monkeypatch.setattr(state_log, "COMPACT_AFTER", 3)
    for i in range(5):
        put(log, (str(i % 2), "x", i))
    assert len(log.folders()) <= 3
    assert rows(log) == {"0": ("x", 4), "1": ("x", 3)}
    assert log.compact() and len(log.folders()) == 1 and rows(log) == {"0": ("x", 4), "1": ("x", 3)}
