"""Streaming forms of the operators.

Aggregating operators (``lifecycle.role_counters``, ``placement.placement_sums``,
``health.probe_counts``, ``agents.latest_task_status``, ``agents.latest_profile``) take a
streaming frame as they are. The ordered folds below need a state store that supports
``transformWithState`` (RocksDB). ``delay`` is how late a row may come; later ones are
dropped and show up in the query's progress as dropped by watermark. ``retention_ms`` is
how long a key is remembered after its last row in event time (None: for ever); keys of which
something is still expected, such as live containers, do not end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.agents import (
    IN_PROGRESS_EXIT_CODE, IN_PROGRESS_LINES, without_markup, tail_text)
from fleetlens.streaming.folds import (
    RETENTION_MS, CellFold, ComponentFold, ContainerFold, OrderedFold, PhaseFold, ReportDrain, SequenceFold, SilenceFold)

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEFAULT_DELAY = "10 minutes"
SLOTS = 64


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def with_event_time(df: DataFrame, ts: str = "ts", delay: str = DEFAULT_DELAY) -> DataFrame:
    """Zoned event time under a watermark, and its milliseconds for the folds."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.withColumn("at_ms", F.floor(F.unix_micros(ts) / 1000).cast("long"))


def delay_millis(spark: SparkSession, delay: str) -> int:
    zero = "TIMESTAMP '2000-01-01 00:00:00 UTC'"
    return spark.sql(f"SELECT unix_millis({zero} + INTERVAL {delay}) - unix_millis({zero})").first()[0]


def _fold(df: DataFrame, keys: list[str], fold: OrderedFold, mode: str, delay: str, retention_ms: int | None) -> DataFrame:
    """``df`` under a watermark, folded by key; rows of a delay wait in at most about ``SLOTS`` slots."""
    fold.retention_ms = retention_ms
    fold.slot_ms = max(1, delay_millis(df.sparkSession, delay) // SLOTS)
    return with_event_time(df, delay=delay).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=fold, outputStructType=fold.output_schema, outputMode=mode, timeMode="EventTime")


def stream_transitions(events: DataFrame, short_lived_ms: int = 60, delay: str = DEFAULT_DELAY,
                       retention_ms: int | None = RETENTION_MS) -> DataFrame:
    """Effect of every event; containers are remembered for the retention time after their end."""
    known = events.filter(F.col("event").isin(
        "ALLOCATED", "SURPLUS", "STARTED", "START_FAILED", "RELEASED", "COMPLETED"))
    return _fold(known, ["container_id"], ContainerFold(short_lived_ms), "Append", delay, retention_ms)


def stream_cells(transitions: DataFrame, delay: str = DEFAULT_DELAY, retention_ms: int | None = RETENTION_MS) -> DataFrame:
    """Newest counters of each cell that changed; ``transitions`` has ``ts``."""
    return _fold(transitions, ["role_id", "host"], CellFold(), "Update", delay, retention_ms)


def stream_sequence_breaks(heartbeats: DataFrame, delay: str = DEFAULT_DELAY,
                           retention_ms: int | None = RETENTION_MS) -> DataFrame:
    """Breaks in the ids of heartbeats (label, seq, ts, response_id), sent as soon as the watermark passes them."""
    return _fold(heartbeats, ["label"], SequenceFold(), "Append", delay, retention_ms)


def stream_component_state(reports: DataFrame, delay: str = DEFAULT_DELAY, retention_ms: int | None = RETENTION_MS) -> DataFrame:
    """State and next command of each component that reported."""
    return _fold(reports, ["label"], ComponentFold(), "Update", delay, retention_ms)


def stream_silence(statuses: DataFrame, probe_timeout_ms: int, bootstrap_timeout_ms: int,
                   delay: str = DEFAULT_DELAY, retention_ms: int | None = RETENTION_MS) -> DataFrame:
    """Silence alerts; a key that stays silent is noticed when the watermark passes its limit."""
    return _fold(statuses, ["key"], SilenceFold(probe_timeout_ms, bootstrap_timeout_ms), "Append", delay, retention_ms)


def stream_phases(statuses: DataFrame, bootstrap_ms: int, has_dependencies: bool = True,
                  delay: str = DEFAULT_DELAY, retention_ms: int | None = RETENTION_MS) -> DataFrame:
    """Phase of every status; a service that is silent for the retention time begins anew."""
    return _fold(statuses, ["service"], PhaseFold(bootstrap_ms, has_dependencies), "Append", delay, retention_ms)


def stream_drain(reports: DataFrame, resend_ms: int | None = None, retention_ms: int | None = RETENTION_MS,
                 delay: str = DEFAULT_DELAY) -> DataFrame:
    """Reports to send with each trigger, shaped as by ``agents.drain_reports``.

    With ``resend_ms`` running tasks are reported again at that interval; such a query goes by the
    clock and has no end. After a report a task's number is remembered for ``retention_ms`` (None: for
    ever), so late older reports are dropped. Without ``resend_ms`` that time is event time, for which
    ``reports`` needs a column ``ts``; reports later than ``delay`` are dropped by the watermark.
    """
    event_time = bool(retention_ms) and not resend_ms
    if event_time and "ts" not in reports.columns:
        raise ValueError("reports need a column ts, or retention_ms=None to remember tasks for ever")
    sent = reports.filter(F.col("command_type").isin("EXECUTION", "STATUS"))
    sent = with_event_time(sent, delay=delay) if event_time else sent
    drain = ReportDrain(resend_ms, retention_ms, event_time)
    sent = sent.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=drain, outputStructType=drain.output_schema, outputMode="Append",
        timeMode="EventTime" if event_time else "ProcessingTime" if resend_ms else "None")
    execution = F.col("command_type") == "EXECUTION"
    running = execution & (F.col("status") == "IN_PROGRESS")
    return sent.select(
        "task_id", F.when(execution, "reports").otherwise("componentStatus").alias("part"), "status",
        F.when(running, IN_PROGRESS_EXIT_CODE).otherwise(F.col("exit_code")).alias("exit_code"),
        F.when(running, without_markup(tail_text(F.col("stdout"), IN_PROGRESS_LINES)))
        .otherwise(F.col("stdout")).alias("stdout"), (~running).alias("forgotten"))
