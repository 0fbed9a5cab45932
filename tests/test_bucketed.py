"""Merges that touch only their buckets, and rebuilds that are resumed."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from vaultspark.sources import bucketed
from vaultspark.sources.bucketed import BucketedTable, Conflict, Rebuild, put_once

ROW = "path string, content_hash string, size int, made_in int"
NEW = "path string, content_hash string, size int"


def derive(made):
    return lambda rows: rows.withColumn("made_in", F.lit(made))


def contents(table, version=None):
    return {r.path: (r.content_hash, r.size, r.made_in) for r in table.read(version).collect()}


@pytest.fixture
def table(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), buckets=8)
    t.create(spark.createDataFrame([(f"p{i}", f"h{i}", i, 1) for i in range(40)], ROW))
    return t


def test_sync_makes_the_new_state(spark, table):
    new = [(f"p{i}", f"h{i}" if i != 5 else "changed", i) for i in range(40) if i not in (3, 7)] + [("moved", "h7", 7), ("fresh", "hx", 99)]
    done = table.sync(spark.createDataFrame(new, NEW), derive(2))
    assert done["actions"] == {"unchanged": 37, "updated": 1, "deleted": 1, "rebased": 1, "added": 1}
    want = {p: (h, s, 2 if p in ("p5", "fresh") else 1) for p, h, s in new}
    assert contents(table) == want and want["moved"] == ("h7", 7, 1)
    assert contents(table, 1) == {f"p{i}": (f"h{i}", i, 1) for i in range(40)}


def test_untouched_buckets_keep_their_files(spark, table):
    before = table.manifest()
    files = {p: sorted((f, os.path.getmtime(f)) for f in glob.glob(f"{table.folder}/{p}/*.parquet")) for p in before["buckets"].values()}
    done = table.sync(spark.createDataFrame([(f"p{i}", f"h{i}" if i else "changed", i) for i in range(40)], NEW), derive(2))
    after = table.manifest()
    assert done["rewritten"] and len(done["rewritten"]) == 1
    same = [b for b in after["buckets"] if int(b) not in done["rewritten"]]
    assert len(same) == len(before["buckets"]) - 1 and all(after["buckets"][b] == before["buckets"][b] for b in same)
    assert all(sorted((f, os.path.getmtime(f)) for f in glob.glob(f"{table.folder}/{p}/*.parquet")) == files[p] for p in (before["buckets"][b] for b in same))
    assert len(glob.glob(f"{table.folder}/data/*")) == 2


def test_sync_of_the_same_state_writes_nothing(spark, table):
    done = table.sync(spark.createDataFrame([(f"p{i}", f"h{i}", i) for i in range(40)], NEW), derive(2))
    assert done["rewritten"] == [] and table.versions() == [1] and len(glob.glob(f"{table.folder}/data/*")) == 1


def test_sync_to_nothing_and_back(spark, table):
    table.sync(spark.createDataFrame([], NEW), derive(2))
    assert contents(table) == {} and table.manifest()["buckets"] == {}
    table.sync(spark.createDataFrame([("a", "h", 1)], NEW), derive(3))
    assert contents(table) == {"a": ("h", 1, 3)} and table.versions() == [1, 2, 3]


def test_two_writers_of_one_version(spark, table, monkeypatch):
    other = BucketedTable(spark, table.folder, buckets=8)
    stale = other.manifest()
    table.sync(spark.createDataFrame([("a", "h", 1)], NEW), derive(2))
    monkeypatch.setattr(other, "manifest", lambda version=None: stale)
    with pytest.raises(Conflict):
        other.sync(spark.createDataFrame([("b", "h2", 1)], NEW), derive(2))
    assert contents(table) == {"a": ("h", 1, 2)}
    with pytest.raises(Conflict):
        table.create(spark.createDataFrame([], ROW))


def test_random_states(spark, tmp_path):
    rnd = random.Random(6)
    t = BucketedTable(spark, str(tmp_path / "r"), buckets=4)
    state = {f"p{i}": f"h{rnd.randint(0, 12)}" for i in range(15)}
    t.create(spark.createDataFrame([(p, h, 0, 1) for p, h in state.items()], ROW))
    for made in (2, 3):
        state = {(p if rnd.random() < 0.7 else f"q{rnd.randint(0, 30)}"): (h if rnd.random() < 0.7 else f"h{rnd.randint(0, 20)}") for p, h in state.items() if rnd.random() < 0.9}
        t.sync(spark.createDataFrame([(p, h, made) for p, h in state.items()], NEW), derive(made))
        assert {p: h for p, (h, _, _) in contents(t).items()} == state


def test_keys_must_be_unique(spark, table):
    for rows in ([("a", "h", 1), ("a", "h", 2)], [(None, "h", 1)]):
        with pytest.raises(ValueError):
            table.sync(spark.createDataFrame(rows, NEW), derive(2))


def test_vacuum_keeps_what_is_named(spark, table):
    table.sync(spark.createDataFrame([(f"p{i}", f"h{i}" if i else "changed", i) for i in range(40)], NEW), derive(2))
    table.sync(spark.createDataFrame([(f"p{i}", f"h{i}" if i else "again", i) for i in range(40)], NEW), derive(3))
    gone = table.vacuum(keep=1)
    assert len(gone) == 2 and table.versions() == [3] and contents(table)["p0"] == ("again", 0, 3) and len(contents(table)) == 40


def test_names_are_taken_once(spark, tmp_path):
    path = str(tmp_path / "m" / "1.json")
    assert put_once(spark, path, "ü") and not put_once(spark, path, "b") and bucketed.get_text(spark, path) == "ü"
    assert [f for f in os.listdir(tmp_path / "m") if f.endswith(".tmp")] == []


# rebuild


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, f"h{i}") for i in range(60)], "id long, h string")


class Counting:
    """Adds a column, and fails when it computes the batch of this number."""

    def __init__(self, fails=None):
        self.calls, self.fails = 0, fails

    def __call__(self, df):
        self.calls += 1
        # the first call asks for the schema only, if the plan isn't there yet
        if self.fails is not None and self.calls == self.fails + 1:
            raise RuntimeError("lost")
        return df.withColumn("twice", F.col("id") * 2)


def test_a_rebuild_is_resumed(spark, tmp_path, rows):
    job = Rebuild(spark, str(tmp_path / "r"))
    with pytest.raises(RuntimeError):
        job.run(rows, Counting(fails=3), key="id", digest="h", per_batch=12, model="m", dim=8)
    (mark,) = os.listdir(tmp_path / "r" / "runs")
    assert job.committed(mark) == [0, 1] and job.finished() == []
    with pytest.raises(FileNotFoundError):
        job.read()
    kept = {f: os.path.getmtime(f) for i in (0, 1) for f in glob.glob(f"{tmp_path}/r/runs/{mark}/batch={i}/*.parquet")}
    again = Counting()
    done = job.run(rows, again, key="id", digest="h", per_batch=12, model="m", dim=8)
    assert (done["resumed"], done["computed"], done["batches"]) == (2, 3, 5) and again.calls == 3
    assert {r.id: r.twice for r in job.read().collect()} == {i: 2 * i for i in range(60)}
    assert kept and all(os.path.getmtime(f) == t for f, t in kept.items()) and job.finished() == [mark]
    assert job.run(rows, again, key="id", digest="h", per_batch=12, model="m", dim=8)["computed"] == 0 and again.calls == 3


@pytest.mark.parametrize("change", [{"dim": 9}, {"model": "other"}, {"rows": 1}])
def test_another_fingerprint_starts_anew(spark, tmp_path, rows, change):
    job = Rebuild(spark, str(tmp_path / "r"))
    with pytest.raises(RuntimeError):
        job.run(rows, Counting(fails=3), key="id", digest="h", per_batch=12, model="m", dim=8)
    (old,) = os.listdir(tmp_path / "r" / "runs")
    if change.pop("rows", None):
        rows = rows.withColumn("h", F.when(F.col("id") == 7, "new").otherwise(F.col("h")))
    done = job.run(rows, Counting(), key="id", digest="h", per_batch=12, **({"model": "m", "dim": 8} | change))
    assert done["resumed"] == 0 and done["mark"] != old and os.listdir(tmp_path / "r" / "runs") == [done["mark"]]


def test_readers_see_the_table_before(spark, tmp_path, rows):
    job = Rebuild(spark, str(tmp_path / "r"))
    job.run(rows, Counting(), key="id", digest="h", per_batch=100, model="m")
    with pytest.raises(RuntimeError):
        job.run(rows.limit(30), Counting(fails=1), key="id", digest="h", per_batch=100, model="m")
    assert job.read().count() == 60
    job.run(rows.limit(30), Counting(), key="id", digest="h", per_batch=100, model="m")
    assert job.read().count() == 30


def test_fingerprint_ignores_order(spark, rows):
    one = bucketed.fingerprint(rows, "id", "h", model="m")
    assert one == bucketed.fingerprint(rows.orderBy(F.desc("id")).repartition(3), "id", "h", model="m")
    assert one != bucketed.fingerprint(rows.union(rows.limit(1)), "id", "h", model="m") != bucketed.fingerprint(rows, "id", "h", model="n")
