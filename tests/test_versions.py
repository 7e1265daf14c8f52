"""Committed versions of tables."""

import pytest
from pyspark.sql import functions as F

from quillspan.sources.store import upsert
from quillspan.sources.versions import VersionConflict, Versions

CHUNKS = "chunk_id string, source_id string, text string, seq long"


def chunks(spark, *rows):
    return spark.createDataFrame([(c, "s" + c[:1], t, s) for c, t, s in rows], CHUNKS)


def texts(snapshot):
    return {r.chunk_id: r.text for r in snapshot.table("chunks").collect()}


def put(store, rows, **more):
    return store.change("chunks", rows, lambda old, new: upsert(old, new), **more)


def test_versions_are_pinned_and_only_touched_buckets_written(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "t"), {"chunks": ("chunk_id", CHUNKS)}, 8)
    assert store.pin().version == 0 and texts(store.pin()) == {}
    first = put(store, chunks(spark, *((f"a{i}", "old", 1) for i in range(40))))
    second = put(store, chunks(spark, ("a1", "new", 2), ("z", "more", 2)))
    assert texts(first) == {f"a{i}": "old" for i in range(40)} and texts(second) == texts(first) | {"a1": "new", "z": "more"}
    touched = set(store.touched(chunks(spark, ("a1", "", 0), ("z", "", 0)), "chunk_id"))
    before, after = (s.content["tables"]["chunks"]["folders"] for s in (first, second))
    assert len(touched) < 8 and {k for k in after if after[k] != before.get(k)} == {str(b) for b in touched}
    # a table rewritten from itself
    third = store.replace(chunks=second.table("chunks").withColumn("text", F.upper("text")))
    assert texts(third)["z"] == "MORE" and texts(store.pin(1)) == texts(first) and store.versions() == [1, 2, 3]
    assert store.vacuum(2) and store.versions() == [2, 3] and texts(store.pin()) == texts(third) and texts(store.pin(2)) == texts(second)


def test_a_writer_that_dies_and_one_that_comes_second(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "t"), {"chunks": ("chunk_id", CHUNKS)}, 4)
    first = put(store, chunks(spark, ("a", "old", 1)))
    store.write("chunks", chunks(spark, ("a", "lost", 2)))  # and no commit
    assert texts(store.pin()) == {"a": "old"} and store.pin().version == 1
    folders = store.write("chunks", chunks(spark, ("a", "mine", 3)))
    store.commit(first, {"chunks": (range(4), folders)})
    with pytest.raises(VersionConflict):
        store.commit(first, {"chunks": (range(4), folders)})
    assert texts(store.pin()) == {"a": "mine"}


def test_deletes_are_counted_by_the_scan_that_writes(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "t"), {"chunks": ("chunk_id", CHUNKS)}, 4)
    put(store, chunks(spark, ("a1", "x", 1), ("a2", "x", 1), ("b1", "x", 1), ("c1", "x", 1)))
    after, removed = store.delete("chunks", "source_id", ["sa", "sb", "none"])
    assert removed == {"sa": 2, "sb": 1, "none": 0} and texts(after) == {"c1": "x"}
    assert store.delete("chunks", "source_id", ["none"])[0].version == after.version


def test_a_batch_committed_changes_nothing(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "t"), {"chunks": ("chunk_id", CHUNKS)}, 4)
    put(store, chunks(spark, ("a", "one", 1)), writer="w", batch=0)
    assert put(store, chunks(spark, ("a", "again", 9)), writer="w", batch=0).version == 1
    assert put(store, chunks(spark, ("a", "other", 2)), writer="v", batch=0).version == 2 and texts(store.pin()) == {"a": "other"}
