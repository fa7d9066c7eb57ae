"""A stream over the same rows gives the batch result, also when rows arrive shuffled."""

import itertools
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import agents, health, lifecycle, placement
from fleetlens.plans import views as v
from fleetlens.streaming import streams

FAR = "2030-01-01 00:00:00"
_names = itertools.count()


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    streams.use_rocksdb(spark)


def as_stream(spark, df, tmp_path, files=3):
    """The rows as ``files`` Parquet files in shuffled order, read one file per trigger."""
    folder = str(tmp_path / "in")
    df.withColumn("_r", F.xxhash64("seq")).repartition(1).sortWithinPartitions("_r").drop("_r").write.option(
        "maxRecordsPerFile", -(-df.count() // files)).parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, tmp_path, mode="append"):
    name = f"out_{next(_names)}"
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    return df.sparkSession.table(name)


def closing(df, **values):
    """One row far in the future, to move the watermark past all others."""
    cols = [F.lit(values[c]).cast(t).alias(c) if c in values else
            F.lit(FAR).cast(t).alias(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in df.dtypes]
    return df.unionByName(df.limit(1).select(*cols))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_transitions(spark, small, tmp_path):
    events = v.lifecycle(spark, small)
    stream = as_stream(spark, closing(events, container_id="end", event="ALLOCATED", seq=-1), tmp_path)
    got = run(streams.stream_transitions(stream, v.SHORT_MS, delay="400 days"), tmp_path)
    cols = ("container_id", "role_id", "host", "seq", "effect", "gone")
    want = lifecycle.transitions(events, v.SHORT_MS)
    assert rows(got.filter("container_id <> 'end'"), *cols) == rows(want, *cols)


def test_cells(spark, small, tmp_path):
    trans = lifecycle.transitions(v.lifecycle(spark, small), v.SHORT_MS).select("role_id", "host", "ts", "seq", "effect")
    stream = as_stream(spark, closing(trans, role_id=99, host=99, seq=-1, effect="IGNORED"), tmp_path)
    got = run(streams.stream_cells(stream, delay="400 days"), tmp_path, "update")
    assert_cells(got, trans)


def assert_cells(got, trans):
    cols = ("role_id", "host", "starting", "live", "releasing", "failed", "start_failed", "last_used_ms")
    newest = got.groupBy("role_id", "host").agg(F.max_by(F.struct(*cols[2:]), "seq").alias("r")).select("role_id", "host", "r.*")
    want = placement.placement_cells(trans).withColumn("last_used_ms", lifecycle.millis(F.col("last_used")))
    key = lambda d: sorted((tuple(r) for r in d.select(*cols).collect()), key=repr)
    assert key(newest) == key(want)


def in_time_order(spark, df, tmp_path, files=4):
    """The rows as files that appear one after the other in time order."""
    folder = tmp_path / "in"
    ordered = df.orderBy("ts", "seq").collect()
    size = -(-len(ordered) // files)
    for i in range(files):
        part = str(tmp_path / f"part{i}")
        spark.createDataFrame(ordered[i * size:(i + 1) * size], df.schema).coalesce(1).write.parquet(part)
        for f in Path(part).glob("*.parquet"):
            folder.mkdir(exist_ok=True)
            target = folder / f"{i}.parquet"
            target.write_bytes(f.read_bytes())
            os.utime(target, (1_700_000_000 + i * 60,) * 2)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_incremental(spark, small, tmp_path):
    """State carried over several triggers, with a short delay."""
    events = v.lifecycle(spark, small)
    want = lifecycle.transitions(events, v.SHORT_MS)
    stream = in_time_order(spark, closing(events, container_id="end", event="ALLOCATED", seq=-1), tmp_path)
    (tmp_path / "a").mkdir()
    got = run(streams.stream_transitions(stream, v.SHORT_MS, delay="1 hour"), tmp_path / "a")
    cols = ("container_id", "role_id", "host", "seq", "effect", "gone")
    assert rows(got.filter("container_id <> 'end'"), *cols) == rows(want, *cols)


def test_incremental_cells(spark, small, tmp_path):
    trans = lifecycle.transitions(v.lifecycle(spark, small), v.SHORT_MS).select("role_id", "host", "ts", "seq", "effect")
    stream = in_time_order(spark, closing(trans, role_id=99, host=99, seq=-1, effect="IGNORED"), tmp_path)
    got = run(streams.stream_cells(stream, delay="1 hour"), tmp_path, "update")
    assert got.groupBy("role_id", "host").count().agg(F.max("count")).first()[0] > 1
    assert_cells(got, trans)


def test_component_state(spark, small, tmp_path):
    reports = v.reports(spark, small).join(
        v.table(spark, small, "events").select(F.col("event_id").alias("seq"), "ts"), "seq")
    stream = as_stream(spark, closing(reports, label="end", seq=-1, kind="issue"), tmp_path)
    got = run(streams.stream_component_state(stream, delay="400 days"), tmp_path, "update")
    cols = ("label", "state", "failures", "illegal", "reports", "last_seq")
    assert rows(got.filter("label <> 'end'"), *cols) == rows(agents.component_state(reports), *cols)


def test_sequence_breaks(spark, small, tmp_path):
    beats = v.heartbeat(spark, small).select(F.col("label").cast("string").alias("label"), "seq", "ts", "response_id")
    stream = as_stream(spark, closing(beats, label="end", seq=-1, response_id=0), tmp_path)
    got = run(streams.stream_sequence_breaks(stream, delay="400 days"), tmp_path)
    cols = ("label", "seq", "response_id", "previous_id")
    want = rows(agents.sequence_breaks(beats), *cols)
    assert rows(got, *cols) == want and len(want) > 10


def test_state_of_a_stream_ends(spark, tmp_path):
    """Keys that are done leave the state store, those with something open stay."""
    schema = "container_id string, role_id int, host long, event string, ts timestamp_ntz, seq long"
    source = tmp_path / "in"

    def put(*events):
        made = spark.createDataFrame([(c, e, t, s) for c, e, t, s in events], "container_id string, event string, at string, seq long")
        made.select("container_id", F.lit(1).alias("role_id"), F.lit(2).cast("long").alias("host"), "event",
                    F.col("at").cast("timestamp_ntz").alias("ts"), "seq").coalesce(1).write.mode("append").parquet(str(source))
        q = (streams.stream_transitions(spark.readStream.schema(schema).parquet(str(source)), delay="1 hour")
             .writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        q.awaitTermination()
        assert q.exception() is None

    def held():
        state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "memory").load()
        return sorted(r.c for r in state.select(F.col("key.container_id").alias("c")).collect())
    put(("a", "ALLOCATED", "2020-01-01", 1), ("a", "COMPLETED", "2020-01-01 01:00:00", 2), ("b", "ALLOCATED", "2020-01-01", 3))
    put(("c", "SURPLUS", "2020-01-03", 4))
    assert held() == ["a", "b"]
    put(("d", "SURPLUS", "2020-01-20", 5))
    put(("d", "COMPLETED", "2020-02-20", 6))
    put(("e", "SURPLUS", "2020-04-20", 7))
    assert held() == ["b"]


def test_silence(spark, small, tmp_path):
    statuses = v.statuses(spark, small)
    stream = as_stream(spark, closing(statuses, key=-1, seq=-1, phase="INIT"), tmp_path)
    got = run(streams.stream_silence(stream, 3_600_000, 7_200_000, delay="100 days"), tmp_path)
    want = health.silence_alerts(statuses, 3_600_000, 7_200_000,
                                 as_of=__import__("datetime").datetime(2029, 1, 1))
    assert rows(got, "key", "seq", "phase") == rows(want, "key", "seq", "phase")


def test_phases(spark, small, tmp_path):
    probes = v.probes(spark, small)
    stream = as_stream(spark, closing(probes, service=-1, seq=-1, cycle=0, probe=0, kind="monitor", success=True), tmp_path)
    got = run(streams.stream_phases(stream, v.BOOT_MS, delay="400 days"), tmp_path)
    cols = ("service", "probe", "seq", "phase", "booted")
    want = health.label_phases(probes, v.BOOT_MS)
    with_deps = probes.filter("kind = 'dependency'").select("service").distinct()
    assert rows(got.join(with_deps, "service"), *cols) == rows(want.join(with_deps, "service"), *cols)


def timed_task_reports(spark, small):
    return v.task_reports(spark, small).join(
        v.table(spark, small, "events").select(F.col("event_id").alias("seq"), "ts"), "seq")


def test_drain(spark, small, tmp_path):
    reports = timed_task_reports(spark, small)
    got = run(streams.stream_drain(as_stream(spark, reports, tmp_path, files=1)), tmp_path)
    cols = ("task_id", "part", "status", "exit_code", "stdout", "forgotten")
    assert rows(got, *cols) == rows(agents.drain_reports(reports), *cols)


def test_running_tasks_are_sent_again(spark, small, tmp_path):
    reports = v.task_reports(spark, small).limit(40)
    running = agents.drain_reports(reports).filter("not forgotten").count()
    df = streams.stream_drain(as_stream(spark, reports, tmp_path, files=1), resend_ms=500)
    q = (df.writeStream.format("memory").queryName("resent").option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(processingTime="1 second").start())
    deadline = time.time() + 90
    while time.time() < deadline and spark.table("resent").filter("not forgotten").count() < 2 * running:
        time.sleep(1)
    q.stop()
    counts = spark.table("resent").groupBy("task_id", "forgotten").count().collect()
    assert running > 0 and {r["count"] for r in counts if r.forgotten} <= {1}
    assert all(r["count"] > 1 for r in counts if not r.forgotten)


def test_late_older_report_is_dropped(spark, tmp_path):
    """A late report is dropped, and a task is forgotten when its retention time is over."""
    schema = "task_id long, seq long, command_type string, status string, exit_code int, stdout string, ts timestamp_ntz"
    source = tmp_path / "late"
    for row in [(1, 5, "EXECUTION", "COMPLETED", 0, "done", "2020-01-01"), (1, 3, "EXECUTION", "IN_PROGRESS", 0, "old", "2020-01-01"),
                (2, 9, "STATUS", "COMPLETED", 0, "late", "2020-03-01")]:
        spark.createDataFrame([row[:-1]], schema.rsplit(",", 1)[0]).withColumn("ts", F.lit(row[-1]).cast("timestamp_ntz")).coalesce(
            1).write.mode("append").parquet(str(source))
        q = (streams.stream_drain(spark.readStream.schema(schema).parquet(str(source))).writeStream.format("parquet")
             .option("path", str(tmp_path / "sent")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        q.awaitTermination()
    assert [(r.task_id, r.status) for r in spark.read.parquet(str(tmp_path / "sent")).orderBy("task_id").collect()] == [
        (1, "COMPLETED"), (2, "COMPLETED")]
    state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "held").load()
    assert [r.key.task_id for r in state.select("key").collect()] == [2]
    with pytest.raises(ValueError):
        streams.stream_drain(spark.readStream.schema(schema).parquet(str(source)).drop("ts"))


def test_aggregates_take_streams(spark, small, tmp_path):
    trans = lifecycle.transitions(v.lifecycle(spark, small), v.SHORT_MS).select("role_id", "host", "seq", "effect", "gone")
    stream = as_stream(spark, trans, tmp_path)
    got = run(lifecycle.role_counters(stream), tmp_path, "complete")
    want = lifecycle.role_counters(trans)
    assert rows(got, *want.columns) == rows(want, *want.columns)


def test_probe_counts_stream(spark, small, tmp_path):
    probes = v.probes(spark, small)
    got = run(health.probe_counts(as_stream(spark, probes, tmp_path), "1 day"), tmp_path, "complete")
    want = health.probe_counts(probes, "1 day")
    assert rows(got, *want.columns) == rows(want, *want.columns)


def test_latest_task_status_stream(spark, small, tmp_path):
    reports = v.task_reports(spark, small)
    got = run(agents.latest_task_status(as_stream(spark, reports, tmp_path)), tmp_path, "complete")
    want = agents.latest_task_status(reports)
    assert rows(got, *want.columns) == rows(want, *want.columns)
