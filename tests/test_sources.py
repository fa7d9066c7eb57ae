import json

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import placement as p
from fleetlens.sources import heartbeats as hb
from fleetlens.sources import history as h

CELL = "host string, role_id int, live int, releasing int, requested int, starting int, last_used bigint"


@pytest.fixture
def cells(spark):
    return spark.createDataFrame([("localhost", 0, 0, 0, 0, 0, 0x10), ("rack1server5", 1, 3, 0, 0, 0, 0),
                                  ("localhost", 1, 1, 1, 0, 0, 0x20)], CELL)


def test_write_and_read(spark, cells, tmp_path):
    folder = str(tmp_path / "hist")
    for at in (0x1000, 0x2000):
        h.write_history(h.history_snapshot(cells, at), folder)
    records = h.read_history(spark, folder)
    checks = h.check_snapshots(records).orderBy("saved").collect()
    assert [(c.saved_ms, c.entries, c.valid, c.footer_ok) for c in checks] == [(0x1000, 3, True, True), (0x2000, 3, True, True)]
    old = records.filter("kind = 'entry' and saved = '0000000000001000'")
    got = {(r.role_id, r.host): r.last_used for r in h.restore_history(old).collect()}
    assert got == {(0, "localhost"): 0x10, (1, "rack1server5"): 0x1000, (1, "localhost"): 0x1000}
    assert {r.saved for r in h.latest_valid_snapshot(records).collect()} == {"0000000000002000"}
    restored = h.restore_history(old).select("*", *[F.lit(0).alias(c) for c in ("live", "releasing", "requested", "starting")])
    assert {r.role_id: r["count"] for r in p.available_cells(restored).groupBy("role_id").count().collect()} == {0: 1, 1: 2}


def test_manifest_names_the_snapshot_to_read(spark, cells, tmp_path):
    folder = str(tmp_path / "hist")
    for at in (0x1000, 0x2000, 0x3000):
        records = h.history_snapshot(cells, at)
        h.write_history(records.filter("kind <> 'footer'") if at == 0x3000 else records, folder)
    h.write_history(h.history_snapshot(cells.limit(1), 0x1000), folder)  # saved again
    manifest = h.read_manifest(spark, folder)
    assert sorted((r.saved_ms, r.entries, r.valid) for r in manifest.collect()) == [(0x1000, 1, True), (0x2000, 3, True), (0x3000, 3, False)]
    records = h.read_history(spark, folder)
    latest = h.latest_valid_snapshot(records, manifest)
    assert {r.saved for r in latest.collect()} == {"0000000000002000"}
    scans = [x for x in latest._jdf.queryExecution().executedPlan().toString().splitlines() if "hist," in x or "hist]" in x]
    assert scans and all("PartitionFilters: [isnotnull(saved" in x and "Subquery" in x for x in scans)
    assert [r.saved for r in h.expired_snapshots(manifest).collect()] == ["0000000000001000"]
    assert h.expired_snapshots(manifest.filter("not valid")).count() == 0


def test_purge_sequence(spark):
    live = [f"{i:016x}" for i in range(1, 7)]
    for keep, deleted in [(1, 0), (2, 1), (2, 0), (5, 3), (6, 1)]:
        snaps = spark.createDataFrame([(s,) for s in live], "saved string")
        gone = {r.saved for r in h.expired_snapshots(snaps, f"{keep:016x}").collect()}
        assert len(gone) == deleted
        live = [s for s in live if s not in gone]
    with pytest.raises(ValueError):
        h.expired_snapshots(spark.createDataFrame([(s,) for s in live], "saved string"), f"{1:016x}")


def record(kind, **body):
    return json.dumps({"entry": {f"any.space.{kind}": body}})


def test_json_snapshots(spark, tmp_path):
    head = lambda v=1: record("Header", version=v, saved=0x1000, savedx="1000", savedate="", roles=2)
    entry = record("EntryRecord", host="a", role=1, active=True, last_used=5)
    foot = lambda n: record("Footer", count=n)
    files = {
        "0000000000005fff": "", "000000000000406c": "{ broken\n", "0000000000003000": "\n".join([entry, head(), foot(1)]),
        "0000000000002fff": "\n".join([head(2), entry, foot(1)]), "0000000000002000": "\n".join([head(), head(), foot(0)]),
        "0000000000001f00": "\n".join([head(), entry]), "000000000000001f": "\n".join([head(), entry, foot(3)]),
        "000000000000001a": "\n".join([head(), entry, foot(1)])}
    for name, text in files.items():
        (tmp_path / f"history-{name}.json").write_text(text)
    records = h.read_history_json(spark, str(tmp_path))
    checks = {r.saved: (r.valid, r.footer_ok) for r in h.check_snapshots(records).collect()}
    assert {s for s, (ok, _) in checks.items() if ok} == {"000000000000001f", "000000000000001a"}
    assert checks["000000000000001f"] == (True, False)
    got = h.latest_valid_snapshot(records).collect()
    assert [(r.saved, r.host, r.role_id, r.last_used) for r in got] == [("000000000000001f", "a", 1, 5)]


def beat(i):
    return {"responseId": 100 + i, "timestamp": 5, "hostname": "c1___master",
            "nodeStatus": {"status": "HEALTHY", "cause": "NONE"},
            "reports": [{"taskId": 7, "status": "COMPLETED", "exitCode": 0, "roleCommand": "INSTALL"}] * i,
            "mounts": [{"device": "/dev/sda", "size": "10"}]}


@pytest.mark.parametrize("streaming", [False, True])
def test_heartbeats(spark, tmp_path, streaming):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(beat(i)) for i in range(3)))
    df = hb.flatten_heartbeats(hb.read_heartbeats(spark, str(folder), streaming), "reports")
    if streaming:
        q = (df.writeStream.format("memory").queryName("beats").option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
        q.awaitTermination(120)
        df = spark.table("beats")
    got = sorted((r.response_id, r.position, r.taskId) for r in df.collect() if r.position is not None)
    assert got == [(101, 0, 7), (102, 0, 7), (102, 1, 7)]
    assert df.filter("position is null").count() == 1


def test_registrations(spark, tmp_path):
    from fleetlens.operators.agents import latest_profile
    msgs = [{"hostname": "h", "timestamp": t, "hardwareProfile": {"memorysize": t, "mounts": []}} for t in (3, 9, 5)]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, msgs)))
    got = latest_profile(hb.read_registrations(spark, str(tmp_path))).first()
    assert (got.timestamp, got.hardwareProfile.memorysize) == (9, 9)
