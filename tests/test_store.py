"""The versioned store: readers see whole versions, killed writers change nothing, of two writers of a key one is refused."""

import pytest

from lithic.sources.store import MOST_PARTS, Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), "source_key")


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, source_key string")


def held(rows):
    return sorted(((r.id, r.source_key) for r in rows.collect()), key=str)


def test_versions(spark, store):
    with pytest.raises(ValueError):
        store.read()
    assert store.replace(frame(spark, [(1, "a"), (2, "a"), (3, "b"), (4, None)])) == 1
    assert store.replace(frame(spark, [(5, "a"), (6, None)])) == 2
    assert held(store.read()) == [(3, "b"), (5, "a"), (6, None)] and held(store.read(1)) == [(1, "a"), (2, "a"), (3, "b"), (4, None)]
    store.replace(frame(spark, []), keys=frame(spark, [(0, "b")]))  # a source that has lost all its rows
    assert held(store.read()) == [(5, "a"), (6, None)]


def test_a_killed_writer_changes_nothing(spark, store):
    store.replace(frame(spark, [(1, "a")]))
    store.write_aside(frame(spark, [(2, "a")]))  # rows and keys are there, the version is not
    frame(spark, [(3, "a")]).write.parquet(f"{store.path}/parts/half/rows")
    assert held(store.read()) == [(1, "a")] and store.latest() == 1
    assert store.vacuum() == 2 and held(store.read()) == [(1, "a")]


def test_two_writers(spark, store):
    store.replace(frame(spark, [(1, "a"), (2, "b")]))
    base = store.latest()
    first, second, other = (store.write_aside(frame(spark, rows)) for rows in ([(3, "a")], [(4, "a")], [(5, "b")]))
    assert store.commit(first, base) == 2
    with pytest.raises(Conflict):
        store.commit(second, base)
    assert store.commit(other, base) == 3  # another key: it follows
    assert held(store.read()) == [(3, "a"), (5, "b")]


def test_a_name_is_given_once(spark, store):
    part = store.write_aside(frame(spark, [(1, "a")]))
    assert store._publish(1, [part]) and not store._publish(1, ["another"])
    assert store.parts(1) == [part]


def test_readers_keep_their_version(spark, store):
    store.replace(frame(spark, [(1, "a")]))
    seen = store.read()
    store.replace(frame(spark, [(2, "a")]))
    assert held(seen) == [(1, "a")] and held(store.read()) == [(2, "a")]


def test_compaction(spark, store):
    for k in range(MOST_PARTS + 1):
        store.replace(frame(spark, [(k, f"k{k % 3}")]))
    assert len(store.parts(store.latest())) == 1
    assert held(store.read()) == [(MOST_PARTS - 2, "k2"), (MOST_PARTS - 1, "k0"), (MOST_PARTS, "k1")]


def test_contents_are_stored_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "contents"), "content_hash")
    rows = lambda *hashes: spark.createDataFrame([(h, n) for n, h in enumerate(hashes)], "content_hash string, size_bytes long")
    store.append_new(rows("x", "y", "x"))
    store.append_new(rows("y", "z", None, None))
    assert sorted((r.content_hash for r in store.read().collect()), key=str) == [None, "x", "y", "z"]
