"""Health probes: phases, reported outcomes, silence and timeouts.

``statuses(service, cycle, seq, ts, probe, kind, success, message)``: one row per probe
result, kind ``dependency`` or ``monitor``; a cycle is one round of a service's probes
and ``seq`` orders the rows of a service. The phase of a service is fixed by a few
milestones (dependencies passed, all probes booted, first fatal failure), each a minimum
over the rows, so phases come from aggregates and joins instead of a row-by-row replay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.functions.ordered import join_counted, previous_in_group
from fleetlens.operators.lifecycle import millis
from fleetlens.session import durable

# fixed values: phases in order, and default limits in milliseconds
PHASES = ("INIT", "DEPENDENCY_CHECKING", "BOOTSTRAPPING", "LIVE", "TERMINATING")
PROBE_TIMEOUT_MS = 60_000
BOOTSTRAP_TIMEOUT_MS = 60_000


def _failed(kind: str) -> Column:
    return F.count_if((F.col("kind") == kind) & ~F.col("success"))


def _ran(kind: str) -> Column:
    return F.count_if(F.col("kind") == kind)


def _service_milestones(statuses: DataFrame, bootstrap_ms: int) -> DataFrame:
    """Per service: rows, dep_done, boot_start_ts, boot_done and timeout_seq."""
    cycles = durable(statuses.groupBy("service", "cycle").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"),
        F.min_by("ts", "seq").alias("start_ts"), F.max_by("ts", "seq").alias("end_ts"),
        _ran("dependency").alias("deps"), _failed("dependency").alias("dep_failed"),
        _ran("monitor").alias("mons"), _failed("monitor").alias("mon_failed")))
    passed = F.when((F.col("deps") > 0) & (F.col("dep_failed") == 0), F.col("cycle"))
    none = F.sum("deps") == 0
    first = durable(cycles.groupBy("service").agg(
        F.sum("n").alias("rows"), F.count("*").alias("cycles"),
        F.when(none, F.min("cycle")).otherwise(F.min(passed)).alias("dep_done"),
        F.when(none, F.min_by("end_ts", "cycle")).otherwise(F.min_by("end_ts", passed)).alias("boot_start_ts")))
    if bootstrap_ms <= 0:
        return first.select("service", "rows", "dep_done", "boot_start_ts", F.col("dep_done").alias("boot_done"),
                            F.lit(None).cast("long").alias("timeout_seq"))
    booting = join_counted(cycles, first, ["service"], "cycles", ["cycle"])
    later = F.col("cycle") > F.col("dep_done")
    late = later & (millis(F.col("start_ts")) > millis(F.col("boot_start_ts")) + bootstrap_ms)
    marks = booting.groupBy("service").agg(
        F.min(F.when(later & (F.col("mons") > 0) & (F.col("mon_failed") == 0), F.col("cycle"))).alias("boot_done"),
        F.min(F.when(late, F.col("cycle"))).alias("_late"),
        F.min_by("first_seq", F.when(late, F.col("cycle"))).alias("timeout_seq"))
    over = F.col("_late") <= F.coalesce(F.col("boot_done"), F.lit(2**62))
    marks = marks.select("service", F.when(~F.coalesce(over, F.lit(False)), F.col("boot_done")).alias("boot_done"),
                         F.when(over, F.col("timeout_seq")).alias("timeout_seq"))
    return durable(first.join(marks, "service").select(
        "service", "rows", "dep_done", "boot_start_ts", "boot_done", "timeout_seq"))


def _probe_marks(statuses: DataFrame, milestones: DataFrame) -> DataFrame:
    """Per (service, probe): rows, first success after the dependencies, and the service's milestones.

    Dependency probes have rows of their own, so that a later join knows how many rows each probe has.
    """
    rows = join_counted(statuses, milestones, ["service"], "rows", ["seq"])
    monitor = F.col("kind") == "monitor"
    ok = F.when(monitor & F.col("success") & (F.col("cycle") > F.col("dep_done")), F.col("seq"))
    carried = [c for c in milestones.columns if c not in ("service", "rows")]
    return durable(rows.groupBy("service", "probe").agg(
        F.count("*").alias("probe_rows"), F.count_if(monitor).alias("monitor_rows"),
        F.min(ok).alias("booted_seq"), F.min_by("ts", ok).alias("booted_ts"), *[F.first(c).alias(c) for c in carried]))


def label_phases(statuses: DataFrame, bootstrap_ms: int = BOOTSTRAP_TIMEOUT_MS) -> DataFrame:
    """Every status with the phase it was taken in and whether its probe had booted.

    ``service`` and ``probe`` must not be null. All that a row needs to know is put into one table per
    (service, probe), so the rows themselves are joined by that pair only.
    """
    marks = _probe_marks(statuses, _service_milestones(statuses, bootstrap_ms))
    in_boot = (F.col("cycle") > F.col("dep_done")) & (
        F.col("boot_done").isNull() | (F.col("cycle") <= F.col("boot_done")))
    is_live = F.col("cycle") > F.col("boot_done")
    had_booted = F.coalesce(F.col("booted_seq") < F.col("seq"), F.lit(False))
    fatal = (F.col("kind") == "monitor") & ~F.col("success") & ((in_boot & had_booted) | is_live)
    known = join_counted(statuses.select("service", "probe", "cycle", "seq", "kind", "success"),
                         marks, ["service", "probe"], "probe_rows", ["seq"])
    stops = known.groupBy("service").agg(
        F.least(F.min(F.when(fatal, F.col("seq"))), F.min("timeout_seq") - 1).alias("stop"))
    marks = durable(marks.join(stops, "service").select(
        "service", "probe", "probe_rows", "booted_seq", "dep_done", "boot_done", "stop"))
    final = join_counted(statuses, marks, ["service", "probe"], "probe_rows", ["seq"])
    phase = (
        F.when(F.col("seq") > F.col("stop"), "TERMINATING").when(is_live, "LIVE")
        .when(in_boot, "BOOTSTRAPPING").otherwise("DEPENDENCY_CHECKING"))
    return final.select(*statuses.columns, phase.alias("phase"), had_booted.alias("booted"))


def probe_phase(statuses: DataFrame, bootstrap_ms: int = BOOTSTRAP_TIMEOUT_MS) -> DataFrame:
    """Phase each service is in after its last status, and when each phase was first seen."""
    rows = label_phases(statuses, bootstrap_ms)
    seen = lambda p: F.min(F.when(F.col("phase") == p, F.col("ts")))
    return rows.groupBy("service").agg(
        F.max_by("phase", "seq").alias("phase"), seen("BOOTSTRAPPING").alias("bootstrapping_ts"),
        seen("LIVE").alias("live_ts"), seen("TERMINATING").alias("terminating_ts"))


def _took_part() -> Column:
    kind, phase = F.col("kind"), F.col("phase")
    return ((phase == "DEPENDENCY_CHECKING") & (kind == "dependency")) | (
        phase.isin("BOOTSTRAPPING", "LIVE") & (kind == "monitor"))


def reported_outcome(labelled: DataFrame) -> DataFrame:
    """What was told to the outside: early failures pass as successes, the truth is kept.

    Input from ``label_phases``; only probes that run in the phase are reported.
    """
    lenient = (F.col("phase") == "DEPENDENCY_CHECKING") | ((F.col("phase") == "BOOTSTRAPPING") & ~F.col("booted"))
    return labelled.filter(_took_part()).select(
        "service", "probe", "seq", "ts", "phase", (F.col("success") | lenient).alias("success"),
        F.col("success").alias("real_outcome"), "message")


def silence_alerts(statuses: DataFrame, probe_timeout_ms: int = PROBE_TIMEOUT_MS,
                   bootstrap_timeout_ms: int = BOOTSTRAP_TIMEOUT_MS, as_of=None) -> DataFrame:
    """Statuses that were followed by too long a silence.

    ``statuses(key, seq, ts, phase)``. The limit is that of the phase; there is none
    while dependencies are checked, and none when bootstrapping for a negative limit.
    With ``as_of`` the newest status of a key is measured against that time.
    """
    linked = previous_in_group(statuses.select("key", "seq", "ts", "phase"), ["key"], [F.col("seq").desc()],
                               {"next_ts": "ts"})
    until = F.col("next_ts") if as_of is None else F.coalesce(F.col("next_ts"), F.lit(as_of))
    limit = F.when(F.col("phase") == "LIVE", F.lit(probe_timeout_ms))
    if bootstrap_timeout_ms >= 0:
        limit = limit.when(F.col("phase") == "BOOTSTRAPPING", F.lit(bootstrap_timeout_ms))
    gap = millis(until) - millis(F.col("ts"))
    return linked.select("key", "seq", "ts", "phase", gap.alias("silence_ms")).filter(F.col("silence_ms") >= limit)


def bootstrap_timeout(statuses: DataFrame, limit_ms: int = BOOTSTRAP_TIMEOUT_MS) -> DataFrame:
    """Services whose probes had not all booted in time, with the last failing status."""
    m = _service_milestones(statuses, limit_ms).filter(F.col("boot_start_ts").isNotNull())
    booted = _probe_marks(statuses, m).filter("monitor_rows > 0")
    deadline = millis(F.col("boot_start_ts")) + limit_ms
    late = F.col("booted_ts").isNull() | (millis(F.col("booted_ts")) > deadline)
    missing = booted.groupBy("service").agg(F.count_if(late).alias("missing")).filter(F.col("missing") > 0)
    rows = join_counted(statuses.filter(F.col("kind") == "monitor"), m, ["service"], "rows", ["seq"])
    failing = ~F.col("success") & (F.col("cycle") > F.col("dep_done")) & (millis(F.col("ts")) <= deadline)
    last = rows.groupBy("service").agg(
        F.max_by("probe", F.when(failing, F.col("seq"))).alias("last_probe"),
        F.max_by("message", F.when(failing, F.col("seq"))).alias("last_message"))
    return missing.join(last, "service").select("service", "missing", "last_probe", "last_message")


def probe_counts(statuses: DataFrame, window: str = "1 hour") -> DataFrame:
    """Successes and failures per probe and window; the same body runs on a stream."""
    return statuses.groupBy("service", "probe", F.window("ts", window).alias("_w")).agg(
        F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"),
    ).select("service", "probe", F.col("_w.start").alias("window_start"), "successes", "failures")


def probe_totals(counts: DataFrame) -> DataFrame:
    """Running totals over the windows of each probe."""
    upto = W.partitionBy("service", "probe").orderBy("window_start").rowsBetween(W.unboundedPreceding, 0)
    return counts.select("service", "probe", "window_start",
                         F.sum("successes").over(upto).alias("successes"), F.sum("failures").over(upto).alias("failures"))


def http_outcome(accesses: DataFrame, low: int = 200, high: int = 299) -> DataFrame:
    """A response code outside [low, high] is a failure."""
    return accesses.withColumn("success", F.coalesce(F.col("code").between(low, high), F.lit(False)))


def human_millis(ms: Column) -> Column:
    """``s.mmms`` text of a duration; 0 stands alone."""
    whole = F.abs((ms / 1000).cast("long"))
    rest = F.abs(ms % 1000).cast("long")
    return F.when(ms == 0, "0").otherwise(F.format_string(
        "%s%d.%03ds", F.when(ms < 0, "-").otherwise(""), whole, rest))


def _pair(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), F.coalesce(F.concat(F.lit('"'), value, F.lit('"')), F.lit("null")))


def health_log_line(reported: DataFrame) -> DataFrame:
    """Log text of each reported status; the real outcome shows only when it differs."""
    word = lambda c: F.when(F.col(c), "success").otherwise("failure")
    text = F.concat_ws(
        ", ", F.lit("Probe Status"),
        _pair("time", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), _pair("phase", F.col("phase")),
        _pair("outcome", word("success")),
        F.when(F.col("success") != F.col("real_outcome"), _pair("originaloutcome", word("real_outcome"))),
        _pair("message", F.col("message")))
    return reported.select("service", "probe", "seq", text.alias("line"))
