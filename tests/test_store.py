"""Interned ids and snapshots: batches, crashes, replays, readers."""

import pytest

from galley.sources import store


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_ids_stay_and_are_dense(spark):
    first = store.intern(spark.createDataFrame([], "id long, value string"), spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "value string"))
    ids = {r.value: r.id for r in first.collect()}
    assert sorted(ids.values()) == [1, 2] and set(ids) == {"a", "b"}
    second = store.intern(first, spark.createDataFrame([(f"w{i}",) for i in range(500)] + [("a",)], "value string"))
    found = {r.value: r.id for r in second.collect()}
    assert {k: found[k] for k in ids} == ids and sorted(found.values()) == list(range(1, 503))
    assert rows(store.intern(second, second.select("value"))) == rows(second)


@pytest.fixture
def kept(spark, tmp_path):
    return store.Snapshots(spark, f"file://{tmp_path}/store", buckets=4)


def test_books_are_replaced_whole(spark, kept):
    table = lambda data: spark.createDataFrame(data, "book string, title string, n int")
    assert kept.read() is None
    assert kept.commit("1", table([("a", "x", 1), ("a", "y", 2), ("b", "z", 3), (None, "w", 4), ("c", "v", 5)]))
    assert kept.commit("2", table([("a", "new", 9), (None, "w2", 8)]), spark.createDataFrame([("b",), ("nowhere",)], "book string"))
    assert rows(kept.read()) == rows(table([("a", "new", 9), (None, "w2", 8), ("c", "v", 5)]))
    assert kept.commit("3", table([]), spark.createDataFrame([("a",), (None,), ("c",)], "book string"))
    assert rows(kept.read()) == []


def test_a_crash_before_the_rename_changes_nothing(spark, kept, monkeypatch):
    table = lambda data: spark.createDataFrame(data, "book string, n int")
    kept.commit("1", table([("a", 1), ("b", 2)]))
    before = kept.read()

    def dies(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(kept, "_publish", dies)
        with pytest.raises(OSError, match="killed"):
            kept.commit("2", table([("a", 7), ("c", 8)]))
    assert rows(kept.read()) == rows(table([("a", 1), ("b", 2)]))
    assert kept.commit("2", table([("a", 7), ("c", 8)]))
    assert not kept.commit("2", table([("a", 7), ("c", 8)]))  # a replay
    assert rows(kept.read()) == rows(table([("a", 7), ("b", 2), ("c", 8)]))
    assert rows(before) == rows(table([("a", 1), ("b", 2)]))  # who read before still sees the old books


def test_two_commits_of_one_number(spark, kept, monkeypatch):
    table = lambda data: spark.createDataFrame(data, "book string, n int")
    kept.commit("1", table([("a", 1)]))
    state = kept._newest()
    kept.commit("2", table([("a", 2)]))
    monkeypatch.setattr(kept, "_newest", lambda: state)
    with pytest.raises(RuntimeError, match="another run"):
        kept.commit("3", table([("a", 3)]))
    monkeypatch.undo()
    assert rows(kept.read()) == [("a", 2)]
