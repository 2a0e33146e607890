"""Known keys, updates of buckets and batches that count once, against plain versions."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import aggregates, updates
from strandframe.sources import appending


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sizes", [(40, 3000), (3000, 40), (500, 500), (0, 10), (10, 0)])
def test_skip_known(spark, sizes):
    draw = random.Random(sum(sizes))
    rows = [(draw.randrange(2000), draw.choice("ab")) for _ in range(sizes[0])] + [(None, "a")] * bool(sizes[0]) * 2
    known = [(draw.randrange(2000), draw.choice("ab")) for _ in range(sizes[1])] + [(None, "a")] * bool(sizes[1])
    a, b = spark.createDataFrame(rows, "k long, s string"), spark.createDataFrame(known, "k long, s string")
    want = sorted([r for r in rows if r[0] is None or r not in set(known)], key=str)
    for most in (64 << 20, 1):  # with the filter, and without
        assert _rows(updates.skip_known(a, b, ["k", "s"], most_bytes=most)) == want


def test_filter_lets_few_pass(spark):
    a = spark.range(100_000).select(F.col("id").alias("k"), F.lit(0).alias("x"))
    b = spark.range(200_000, 220_000).select(F.col("id").alias("k"))
    assert updates._met(a, b, ["k"], 1 << 13).where("__met").count() < 2_000
    assert updates._met(b, b, ["k"], 1 << 13).where("NOT __met").count() == 0
    plan = updates.skip_known(a, b, ["k"])._jdf.queryExecution().toString()
    assert "bit_or" in plan and "LeftAnti" in plan


def test_skip_known_needs_one_type(spark):
    with pytest.raises(ValueError, match="types"):
        updates.skip_known(spark.range(3), spark.range(3).selectExpr("cast(id as int) id"), ["id"])


@pytest.mark.parametrize("rows", [0, 1, 400])
def test_numbered_over_ranges(spark, rows):
    draw = random.Random(rows)
    data = [(draw.choice([None, *range(5)]), f"{draw.random()}") for _ in range(rows)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = aggregates.numbered(spark.createDataFrame(data, "a int, b string"), ["a", "b"], "n").orderBy("n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [tuple(r) for r in got] == [(*r, i) for i, r in enumerate(want)]


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(k, k * 1.0, "x") for k in range(500)] + [(None, 7.0, "n")] * 3
    updates.write_buckets(spark.createDataFrame(rows, "k long, v double, s string"), path, "k", 16)
    before = _files(path)
    changes = [(3, -3.0), (4, None), (1003, 9.0)]
    touched = updates.upsert_buckets(spark.createDataFrame(changes, "k long, v double"), path, "k", ["v"])
    after = _files(path)
    changed = {f.split("bucket_of_16=")[1].split("/")[0] for f, _ in set(before.items()) ^ set(after.items())}
    assert {int(b) for b in changed} == set(touched) and 1 <= len(touched) <= 3
    want = [(k, -3.0 if k == 3 else v, s) for k, v, s in rows] + [(1003, 9.0, None)]
    assert _rows(updates.read_buckets(spark, path)) == sorted(want, key=str)
    # again: nothing new; null keys are appended
    updates.upsert_buckets(spark.createDataFrame(changes, "k long, v double"), path, "k", ["v"])
    assert _rows(updates.read_buckets(spark, path)) == sorted(want, key=str)
    assert updates.upsert_buckets(spark.createDataFrame([(None, 1.0)], "k long, v double"), path, "k", ["v"]) == []
    assert _rows(updates.read_buckets(spark, path)) == sorted([*want, (None, 1.0, None)], key=str)
    assert updates.upsert_buckets(spark.createDataFrame([], "k long, v double"), path, "k", ["v"]) == []


KINDS = "k long, s string"
DATA = [(i, f'name, "{i}"' if i % 3 else None) for i in range(50)]


def test_batches_count_once(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame(DATA, KINDS).repartition(3)
    appending.append_batch(df.where("k < 20"), path, "one")
    appending.append_batch(df.where("k < 20"), path, "one")
    appending.append_batch(df.where("k >= 20"), path, "two")
    appending.append_batch(df.where("k > 1000"), path, "none")
    assert _rows(appending.read_batches(spark, path, KINDS)) == sorted(DATA, key=str)
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{path}/*.csv")))
    assert text.startswith("k,s\n") and text.count("k,s") == 1
    assert not os.listdir(f"{path}/_runs")
    with pytest.raises(Exception, match="line break"):
        appending.append_batch(spark.createDataFrame([(1, "a\nb")], KINDS), path, "three")
    with pytest.raises(ValueError, match="header"):
        appending.append_batch(df.select("s", "k"), path, "three")


def test_failed_run_and_broken_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame(DATA, KINDS).repartition(4)
    broken = df.withColumn("k", F.when(F.col("k") == 49, F.raise_error(F.lit("lost"))).otherwise(F.col("k")))
    with pytest.raises(Exception, match="lost"):
        appending.append_batch(broken, path, "one")
    assert appending.read_batches(spark, path, KINDS).count() == 0
    # a commit that moved a file but did not name it
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/one-000009.csv", "w") as f:
        f.write("1,x\n")
    assert appending.read_batches(spark, path, KINDS).count() == 0
    appending.append_batch(df, path, "one")
    assert _rows(appending.read_batches(spark, path, KINDS)) == sorted(DATA, key=str)
    assert not os.path.exists(f"{path}/one-000009.csv")


def test_a_task_tried_twice_leaves_one_file(tmp_path):
    """What the driver gets is the message of the attempt that counts; the other's file goes with the run's folder."""
    import pyarrow as pa

    writer = appending.BatchWriter(str(tmp_path), "b", ["k"], ",")
    batch = pa.RecordBatch.from_pydict({"k": [1, 2]})

    class Context:
        def partitionId(self):
            return 5

    old, appending.TaskContext.get = appending.TaskContext.get, classmethod(lambda cls: Context())
    try:
        writer.write(iter([batch]))
        kept = writer.write(iter([batch]))
    finally:
        appending.TaskContext.get = old
    writer.commit([kept])
    writer.commit([kept])
    assert open(tmp_path / "b-000005.csv").read() == "1\n2\n"
    assert sorted(os.listdir(tmp_path)) == ["0-header.csv", "_batches", "_runs", "b-000005.csv"]


def test_insert_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], KINDS)
    for _ in range(2):
        appending.insert_batch(df, path, "one", "k", [F.col("s")])
    appending.insert_batch(spark.createDataFrame([(2, "z"), (3, "d")], KINDS), path, "two", "k", [F.col("s")])
    assert _rows(appending.read_batches(spark, path, KINDS)) == [(1, "a"), (2, "c"), (3, "d")]
