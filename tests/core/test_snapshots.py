"""Snapshots stored by content: differences equal the plain join, equal subtrees are stored and read once."""

import random

import pytest

from tidelark.operators.access import snapshot_diff
from tidelark.functions import columns as C
from tidelark.operators import snapshots as S
from tidelark.operators.snapshots import SnapshotStore, tree_entries


def store_of(spark, tmp_path, **versions):
    store = SnapshotStore(spark, f"file://{tmp_path}/snapshots", buckets=4)
    stored = {name: store.add(name, spark.createDataFrame(sorted(files.items()), "path string, hash string")) for name, files in versions.items()}
    return store, stored


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_differences_equal_the_join_of_all_paths(spark, tmp_path, seed):
    rng = random.Random(seed)
    old = {f"{rng.choice('ab')}/{rng.choice('cde')}/{i % 7}/{i}.py": f"h{i % 5}" for i in range(60)} | {"top": "h", "a/only": "h"}
    new = {p: h if rng.random() < 0.8 else h + "x" for p, h in old.items() if rng.random() < 0.85} | {"z/y/x/new": "h", "a/c/added": "h1"}
    store, _ = store_of(spark, tmp_path, old=old, new=new)
    frames = [spark.createDataFrame(sorted(x.items()), "path string, hash string") for x in (old, new)]
    assert rows(store.diff("old", "new")) == rows(snapshot_diff(*frames).where("status <> 'same'"))


def test_a_file_that_becomes_a_directory_and_a_new_name(spark, tmp_path):
    store, _ = store_of(spark, tmp_path, old={"a/b": "1", "a/c": "2", "k/x": "3"}, new={"a/b/d": "1", "a/c": "2", "k/y": "3"})
    assert rows(store.diff("old", "new")) == {("a/b", "removed"), ("a/b/d", "added"), ("k/x", "removed"), ("k/y", "added")}


def test_equal_snapshots_and_empty_ones(spark, tmp_path):
    store, stored = store_of(spark, tmp_path, old={"a/b": "1"}, same={"a/b": "1"}, none={})
    assert stored["old"] == 2 and stored["same"] == 0
    assert rows(store.diff("old", "same")) == set()
    assert rows(store.diff("none", "old")) == {("a/b", "added")}
    assert rows(store.diff("old", "none")) == {("a/b", "removed")}
    with pytest.raises(ValueError):
        store.root("missing")


def test_equal_subtrees_are_stored_once(spark, tmp_path):
    tree = {f"{top}/lib/{i}": f"h{i}" for top in ("a", "b", "c") for i in range(10)}
    store, stored = store_of(spark, tmp_path, old=tree, new=tree | {"a/lib/0": "other"})
    assert stored == {"old": 3, "new": 3}  # root, a = b = c, lib; then the way down to the changed file
    assert store.entries().count() == (3 + 1 + 10) + (3 + 1 + 10)


def test_rows_read_go_with_the_change(spark, tmp_path):
    tree = {f"d{i}/e{j}/{k}": "h" for i in range(6) for j in range(6) for k in range(6)}
    store, _ = store_of(spark, tmp_path, old=tree, new=tree | {"d3/e2/1": "new"})
    read, plain = [], store.children

    def counted(wanted, side):
        found = plain(wanted, side)
        read.append(found.count())
        return found

    store.children = counted
    assert rows(store.diff("old", "new")) == {("d3/e2/1", "changed")}
    assert read == [6] * 6  # three levels, both sides, one directory each; the trees have 216 files


def test_a_path_that_comes_twice_counts_once(spark):
    frame = lambda x: spark.createDataFrame(x, "path string, hash string")
    twice, once = (rows(tree_entries(frame(x))[0]) for x in ([("a/b", "1"), ("a/b", "2")], [("a/b", "2")]))
    assert twice == once


def test_entries_are_written_by_more_tasks_than_buckets(spark, tmp_path):
    files = spark.createDataFrame([(f"{i % 7}/{i % 30}/{i}", str(i)) for i in range(300)], "path string, hash string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        SnapshotStore(spark, str(tmp_path), buckets=1).add("a", files)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list((tmp_path / "entries").rglob("*.parquet"))) > 1


def test_sums_are_of_longs_and_paths_are_cut_as_by_the_patterns(spark):
    paths = ["", "/", "//", "a", "a/", "/a", "/a/b/", "a//b", "a/b/c.d", "é/ü\n/ñ\n", "a/b\n"]
    df = spark.createDataFrame([(x,) for x in paths], "path string")
    found = df.select("path", S._parent("path"), S._name("path"), S._depth("path")).collect()
    assert [tuple(r) for r in found] == [tuple(r) for r in df.select("path", C.parent("path"), C.file_name("path"), C.depth("path")).collect()]
    parts = spark.createDataFrame([(str(i), i % 2 == 0, "x") for i in range(50)], "name string, is_dir boolean, child string").select(*S._entry_parts())
    assert {t for _, t in parts.dtypes} == {"bigint"}
    values = [v for r in parts.collect() for v in r]
    assert len(set(values)) > 390 and 0 <= min(values) and 2**31 < max(values) < 2**32
