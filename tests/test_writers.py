from __future__ import annotations

import hashlib
import os
import threading

import pytest
from pyspark.sql import functions as F

from rallypoint.sources import blobs, stages, writers
from rallypoint.streaming import ledger


def test_one_of_two_writers_fails(spark, tmp_path):
    base, df = f"file://{tmp_path}/v", spark.range(5)
    barrier, out = threading.Barrier(2), []

    def go(n):
        barrier.wait()
        try:
            out.append(stages.publish_version(df.withColumn("n", F.lit(n)), base, f"w{n}"))
        except (writers.Busy, writers.Fenced) as e:
            out.append(e)

    both = [threading.Thread(target=go, args=(n,)) for n in (1, 2)]
    [t.start() for t in both]
    [t.join() for t in both]
    assert sum(x is True for x in out) == 1 and sum(isinstance(x, RuntimeError) for x in out) == 1
    assert stages.versions(spark, base).count() == 1


def test_put_if_absent_has_one_winner(spark, tmp_path):
    out, barrier = [], threading.Barrier(8)

    def go(n):
        barrier.wait()
        out.append(writers.put_if_absent(spark, f"file://{tmp_path}/x/one", f'{{"n": {n}}}'))

    all_ = [threading.Thread(target=go, args=(n,)) for n in range(8)]
    [t.start() for t in all_]
    [t.join() for t in all_]
    assert sum(out) == 1 and list(writers.read_small(spark, f"file://{tmp_path}/x")) == ["one"]


def test_a_crashed_writer_is_taken_over_and_fenced_out(spark, tmp_path):
    base, now = f"file://{tmp_path}/v", [0.0]
    crashed = writers.hold(spark, base, "first", 10, lambda: now[0])
    now[0] = 9
    with pytest.raises(writers.Busy, match="first"):
        writers.hold(spark, base, "second", 10, lambda: now[0])
    crashed.renew(5)
    now[0] = 13
    with pytest.raises(writers.Busy):
        writers.hold(spark, base, "second", 10, lambda: now[0])
    now[0] = 15
    second = writers.hold(spark, base, "second", 10, lambda: now[0])
    assert second.fence == crashed.fence + 1
    with pytest.raises(writers.Fenced):
        stages.publish_version(spark.range(3), base, "late", writer=crashed)
    assert stages.publish_version(spark.range(4), base, "good", writer=second)
    second.release()
    with writers.hold(spark, base, "third", 10, lambda: now[0]) as third:
        assert third.fence == 3
    assert [r.name for r in stages.versions(spark, base).collect()] == ["good"]


def test_blobs_round_trip_and_refuse_changes(spark, tmp_path):
    folder = f"file://{tmp_path}/blobs"
    rows = spark.createDataFrame([('{"a": 1}',), ('{"é": 2}',), ('{"a": 1}',), (None,)], "content string")
    first = {r.digest: r for r in blobs.store_blobs(rows.repartition(3), "content", folder).collect()}
    assert len(first) == 2 and all(r.added for r in first.values())
    assert not any(r.added for r in blobs.store_blobs(rows, "content", folder).collect())
    read = {r.digest: r.content for r in blobs.read_blobs(spark, folder).collect()}
    assert read == {hashlib.sha256(x.encode()).hexdigest(): x for x in ('{"a": 1}', '{"é": 2}')}
    place = tmp_path / "blobs" / next(iter(first.values())).place
    place.write_text("changed")
    with pytest.raises(Exception, match="content differs"):
        blobs.read_blobs(spark, folder).collect()
    with pytest.raises(Exception, match="content differs"):
        blobs.store_blobs(rows, "content", folder).collect()


def test_tree_digest_in_path_order(spark, tmp_path):
    root = tmp_path / "t"
    (root / "b").mkdir(parents=True)
    names = ["z", "b/ä", "b/c", "a.x", "a"]
    for n in names:
        (root / n).write_text(n * 3)
    lines = [f"{n}\0{len((n * 3).encode())}\0{hashlib.sha256((n * 3).encode()).hexdigest()}\n" for n in sorted(names)]
    n, size, digest = blobs.ordered_digest(blobs.tree(spark, f"file://{root}"))
    assert (n, size, digest) == (5, sum(len((x * 3).encode()) for x in names), hashlib.sha256("".join(lines).encode()).hexdigest())
    parts = [hashlib.sha256("".join(lines[i : i + 2]).encode()).hexdigest() + "\n" for i in (0, 2, 4)]
    assert blobs.ordered_digest(blobs.tree(spark, f"file://{root}"), 2)[2] == hashlib.sha256("".join(parts).encode()).hexdigest()
    os.symlink(root / "a", root / "link")
    with pytest.raises(Exception, match="symbolic link"):
        blobs.tree(spark, f"file://{root}").collect()


def test_ledger_reads_the_buckets_it_can_meet(spark, tmp_path):
    folder, config = f"file://{tmp_path}/l", {"patch": "26.15"}
    one = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("c"))
    assert ledger.add_new(one, folder, "k", "c", config, 0, 16).count() == 1000
    few = spark.createDataFrame([(5, "x"), (5, "y"), (2000, "z"), (None, "n")], "k bigint, c string")
    read = ledger.reachable(few, folder, "k", 16)
    assert 0 < len(read.inputFiles()) <= 2 and read.where("k = 5").count() == 1
    assert [r.k for r in ledger.add_new(few, folder, "k", "c", config, 1, 16).collect()] == [2000]
    before = ledger.set_fingerprint(spark, folder, "k")
    assert [r.k for r in ledger.add_new(few, folder, "k", "c", config, 1, 16).collect()] == [2000]
    assert ledger.set_fingerprint(spark, folder, "k") == before and spark.read.parquet(f"{folder}/keys").count() == 1001
    with pytest.raises(ValueError, match="another configuration"):
        ledger.add_new(few, folder, "k", "c", {"patch": "26.16"}, 2, 16)
    keys = [*range(1000), 2000]
    lines = sorted(hashlib.sha256(str(k).encode()).hexdigest() + "\0" + "0\0" + hashlib.sha256(b"z" if k == 2000 else b"x").hexdigest() + "\n" for k in keys)
    assert before == hashlib.sha256("".join(lines).encode()).hexdigest()
