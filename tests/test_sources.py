"""Readers, writers, stages, keystones and streaming ingest."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rallypoint.sources import records, stages
from rallypoint.streaming import ingest


def lines(tmp_path, *rows):
    (tmp_path / "rows.jsonl").write_text("\n".join(rows) + "\n\n")
    return f"file://{tmp_path}/rows.jsonl"


def test_typed_lines(spark, tmp_path):
    path = lines(tmp_path, '{"a": 1, "b": "x"}', '{"a": 2, "b": null}')
    assert [tuple(r) for r in records.read_lines(spark, path, "a int, b string").orderBy("a").collect()] == [(1, "x"), (2, None)]


@pytest.mark.parametrize("bad", ['{"a": 1, "a": 2}', '{"a": "x"}', "{"])
def test_bad_lines_fail(spark, tmp_path, bad):
    with pytest.raises(Exception):  # noqa: B017
        records.read_lines(spark, lines(tmp_path, '{"a": 1}', bad), "a int").collect()


def test_partitioned_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "eu w", None, 420), ("m2", "na", "26.1", 420)], "match_id string, region string, patch string, queue int")
    records.write_partitioned(rows, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert {(r["match_id"], r["region"], str(r["patch"])) for r in back.collect()} == {("m1", "eu_w", "unresolved"), ("m2", "na", "26.1")}


def test_publish_is_immutable(spark, tmp_path):
    path = f"file://{tmp_path}/stage"
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    assert stages.publish(a, path) is True
    assert stages.publish(a.orderBy(F.desc("k")), path) is False
    with pytest.raises(ValueError, match="other rows"):
        stages.publish(a.dropDuplicates(), path)
    with pytest.raises(ValueError, match="one_winner"):
        stages.publish(a, path + "2", spark.createDataFrame([("one_winner", 3)], "check string, failures int"))
    stages.require_lineage({"a": a}, {"a": stages.fingerprint(spark.read.parquet(path))})
    with pytest.raises(ValueError, match="not the one"):
        stages.require_lineage({"a": a}, {})


def test_inventory(spark, tmp_path):
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab" / "one.json").write_text("{}")
    files = records.inventory(spark, f"file://{tmp_path}/ab")
    assert files.first()["size"] == 2 and len(records.tree_digest(files)) == 64


def payload(match_id, n=10, queue=420):
    people = [{"participantId": i + 1, "teamId": 100 if i < 5 else 200, "championId": i, "win": i < 5} for i in range(n)]
    return json.dumps({"metadata": {"matchId": match_id}, "info": {"gameCreation": 1_700_000_000_000, "gameDuration": 1800, "queueId": queue, "participants": people, "teams": [{"teamId": 100}, {"teamId": 200}]}})


def test_normalize(spark, tmp_path):
    path = lines(tmp_path, payload("a"), payload("b", 9), payload("c", queue=1))
    kept, rejected = records.normalize(spark.read.schema(records.MATCH).json(path))
    assert [r["match_id"] for r in kept.collect()] == ["a"]
    assert {r["match_id"]: r["reason"] for r in rejected.collect()} == {"b": "unexpected_participant_count", "c": "unsupported_queue"}


def test_keystones(spark):
    trees = spark.createDataFrame([(8000, [([(8005, "P"), (8010, "C")],), ([(9101, "x")],)])], "id int, slots array<struct<runes:array<struct<id:int,name:string>>>>")
    known = records.keystones(trees)
    assert {r["keystone"] for r in known.collect()} == {8005, 8010}
    style = lambda d, s, *p: (d, s, [(x,) for x in p])
    perks = [([style("primaryStyle", 8000, 8005, 9101)],), ([style("subStyle", 8000, 8005)],), ([style("primaryStyle", 8000, 8005, 8010)],), ([style("PRIMARYSTYLE", 7, 8005)],), None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(perks)], "i int, perks struct<styles:array<struct<description:string,style:int,selections:array<struct<perk:int>>>>>")
    got = {r["i"]: (r["keystone_id"], r["keystone_status"]) for r in records.map_keystone(rows, "perks", known).collect()}
    assert got == {0: (8005, "mapped"), 1: (None, "primary_style_missing"), 2: (None, "keystone_ambiguous"), 3: (None, "primary_style_unknown"), 4: (None, "perks_missing")}


def test_newest_version(spark):
    v = spark.createDataFrame([("16.9.1",), ("16.10.1",), ("15.20.1",), ("lolpatch",)], "version string")
    assert records.newest_version(v, "16") == "16.10.1"


def test_bans(spark):
    rows = spark.createDataFrame([([(5, None), (None, 1), (-1, 1), (7, 2)],)], "bans array<struct<championId:int,pickTurn:int>>")
    assert [tuple(b) for b in rows.select(records.sorted_bans(F.col("bans")).alias("b")).first()["b"]] == [(None, 1), (-1, 1), (7, 2), (5, None)]


def test_ingest_takes_each_key_once(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    rows.write.parquet(f"file://{src}")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"file://{src}")
    ingest.ingest_stream(spark, stream(), "id", out)
    spark.createDataFrame([(2, "late"), (3, "c")], "id int, v string").write.mode("append").parquet(f"file://{src}")
    ingest.ingest_stream(spark, stream(), "id", out)
    assert {tuple(r) for r in spark.read.parquet(f"{out}/ledger").collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_replaceable_stages(spark, tmp_path):
    base = f"file://{tmp_path}/stage"
    one, two = spark.range(5), spark.range(7)
    good, bad = (spark.createDataFrame([("rows", n)], "check string, failures bigint") for n in (0, 3))
    assert stages.publish_version(one, base, "a", good) and not stages.publish_version(one.repartition(3), base, "again")
    with pytest.raises(ValueError, match="checks failed: rows \\(3\\)"):
        stages.publish_version(two, base, "b", bad)
    assert stages.snapshots(spark, base).count() == 5
    assert stages.publish_version(two, base, "b") and stages.snapshots(spark, base).count() == 7
    assert stages.snapshots(spark, base, "a").count() == 5 and stages.snapshots(spark, base, "all").groupBy("version_name").count().count() == 2
    stages.roll_back(spark, base)
    assert stages.snapshots(spark, base).count() == 5
    with pytest.raises(ValueError, match="no version c"):
        stages.snapshots(spark, base, "c")


def test_one_json_object(spark, tmp_path):
    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text('{\n "a": 1,\n "b": "x"}')
    bad.write_text('[{"a": 1}, {"a": 2}]')
    assert stages.read_object(spark, f"file://{good}", "a int, b string").first().a == 1
    with pytest.raises(ValueError, match="not one JSON object"):
        stages.read_object(spark, f"file://{bad}", "a int, b string")
