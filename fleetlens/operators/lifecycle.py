"""Container life cycle: from an event log to states, classifications and counters.

Events have ``container_id, role_id, host, event, ts, seq[, exit_code, diagnostics]``;
``seq`` is the unique position in the log and decides the order. Everything is built
from first-occurrence aggregates per container (combined on the map side) and a join
back, so a container with very many events is never held in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.ordered import OPEN, SURE, cut_in_group, join_counted, join_one, rank_in_group
from fleetlens.session import durable

# fixed values: ordered container state codes
STATE_INCOMPLETE, STATE_SUBMITTED, STATE_CREATED = 0, 1, 2
STATE_LIVE, STATE_STOPPED, STATE_DESTROYED = 3, 4, 5
SHORT_LIVED_MS = 60
FAILURE_THRESHOLD = 5

EVENTS = ("ALLOCATED", "SURPLUS", "STARTED", "START_FAILED", "RELEASED", "COMPLETED")


def _at(cond: Column) -> Column:
    return F.when(cond, F.col("seq"))


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a zone-free timestamp, whatever the session's zone."""
    since = (ts.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second")
    return F.floor(since.cast("decimal(20,6)") * 1000).cast("long")


def container_summary(events: DataFrame) -> DataFrame:
    """First valid position and time of every step of each container.

    ``a`` allocated, ``u`` surplus, ``s`` started, ``f`` start failed, ``r`` release
    submitted, ``e`` ended; null when the step did not validly happen. A step counts
    only after the allocation and before the end.
    """
    ev = F.col("event")
    rel = events.filter(ev.isin(*EVENTS))
    opened = rel.groupBy("container_id").agg(
        F.count("*").alias("rows"),
        F.min(_at(ev == "ALLOCATED")).alias("a"),
        F.min(_at(ev == "SURPLUS")).alias("u"))
    seq, after = F.col("seq"), F.col("seq") > F.col("a")
    ended = (ev == "COMPLETED") & (seq > F.least("a", "u"))
    joined = join_counted(rel, durable(opened), ["container_id"], "rows", ["seq"])
    firsts = joined.groupBy("container_id").agg(
        F.first("rows").alias("rows"), F.first("a").alias("a"), F.first("u").alias("u"),
        F.min(_at((ev == "STARTED") & after)).alias("s"),
        F.min(_at((ev == "START_FAILED") & after)).alias("f"),
        F.min(_at((ev == "RELEASED") & after)).alias("r"),
        F.min(_at(ended)).alias("e"),
        F.min_by("role_id", "seq").alias("role_id"),
        F.min_by("host", "seq").alias("host"),
        F.min_by("ts", _at(ev == "ALLOCATED")).alias("create_ts"),
        F.min_by("ts", _at((ev == "STARTED") & after)).alias("start_ts"),
        F.min_by("ts", _at(ended)).alias("end_ts"),
        F.min_by("exit_code", _at(ended)).alias("exit_code"),
        F.min_by("diagnostics", _at(ended)).alias("diagnostics"),
        F.min_by("diagnostics", _at((ev == "START_FAILED") & after)).alias("start_diagnostics"))
    never = F.lit(2**63 - 1)
    e, s, f = (F.coalesce(F.col(c), never) for c in "esf")
    firsts = firsts.withColumn("f", F.when((f < s) & (f < e), F.col("f")))
    f = F.coalesce(F.col("f"), never)
    started = (F.col("s") < e) & (F.col("s") < f)
    return (
        firsts.withColumn("s", F.when(started, F.col("s")))
        .withColumn("start_ts", F.when(F.col("s").isNotNull(), F.col("start_ts")))
        .withColumn("r", F.when((F.col("r") < e) & (F.col("r") < f), F.col("r")))
        .withColumn("outcome", F.when(F.col("e").isNull(), F.lit(None))
                    .when(F.col("r").isNotNull(), "released")
                    .when(F.col("u") < F.col("e"), "surplus").otherwise("failed"))
    )


def container_state(events: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Current state of every container that was allocated.

    ``summary`` is a written ``container_summary`` of the events that several operators share.
    """
    c = (container_summary(events) if summary is None else summary).filter(F.col("a").isNotNull())
    gone = F.col("e").isNotNull() & F.col("s").isNotNull()
    return c.select(
        "container_id", "role_id", "host",
        F.when(gone, STATE_DESTROYED).when(F.col("s").isNotNull(), STATE_LIVE)
        .otherwise(STATE_SUBMITTED).alias("state"),
        F.col("r").isNotNull().alias("released"),
        "create_ts", "start_ts",
        F.when(gone, F.col("exit_code")).alias("exit_code"),
        F.when(gone, F.col("diagnostics")).when(F.col("f").isNotNull(), F.col("start_diagnostics"))
        .alias("diagnostics"),
    )


def transitions(events: DataFrame, short_lived_ms: int = SHORT_LIVED_MS, summary: DataFrame | None = None) -> DataFrame:
    """Every life-cycle event with the effect it had.

    ASSIGNED, SURPLUS, STARTED, START_ERROR, START_FAILED, RELEASING, RELEASE_ERROR,
    RELEASED, SURPLUS_ENDED, FAILED, FAILED_SHORT, UNKNOWN or IGNORED. A completion is
    decided in the order released, surplus, failed, unknown; its exit code plays no part.
    A completion after the one that ended a failed container is a failure again, after
    any other end it is unknown. ``gone`` marks the one event that ends an assigned
    container.
    """
    ev, seq = F.col("event"), F.col("seq")
    rel = events.filter(ev.isin(*EVENTS))
    steps = ("container_id", "rows", "a", "u", "s", "f", "r", "e", "outcome", "start_ts")
    summary = durable(container_summary(events).select(*steps)) if summary is None else summary.select(*steps)
    j = join_counted(rel, summary, ["container_id"], "rows", ["seq"])
    kind = (
        F.when(seq == F.col("e"), F.col("outcome"))
        .when((seq > F.col("e")) & ((F.col("outcome") == "failed") | F.col("f").isNotNull()), "failed")
        .otherwise("unknown"))
    lived = millis(F.col("ts")) - millis(F.col("start_ts"))
    short = F.col("start_ts").isNull() | (lived < short_lived_ms)
    dead = (seq > F.col("e")) | (seq > F.col("f"))
    effect = (
        F.when(ev == "ALLOCATED", F.when(seq == F.col("a"), "ASSIGNED").otherwise("IGNORED"))
        .when(ev == "SURPLUS", F.when(seq == F.col("u"), "SURPLUS").otherwise("IGNORED"))
        .when(ev == "STARTED", F.when(seq == F.col("s"), "STARTED").otherwise("START_ERROR"))
        .when(ev == "START_FAILED", F.when(seq == F.col("f"), "START_FAILED").otherwise("IGNORED"))
        .when(ev == "RELEASED", F.when(seq == F.col("r"), "RELEASING").otherwise("RELEASE_ERROR"))
        .when(kind == "released", "RELEASED").when(kind == "surplus", "SURPLUS_ENDED")
        .when(kind == "failed", F.when(short, "FAILED_SHORT").otherwise("FAILED"))
        .otherwise("UNKNOWN"))
    problem = F.when(effect == "START_ERROR", F.when(
        F.col("a").isNull() | (seq < F.col("a")) | F.coalesce(dead, F.lit(False)),
        "not an active container").otherwise("already started"))
    gone = F.coalesce((seq == F.col("e")) & F.col("a").isNotNull(), F.lit(False))
    return j.select(*events.columns, effect.alias("effect"), problem.alias("problem"), gone.alias("gone"),
                    F.when(ev == "COMPLETED", lived).alias("lived_ms"))


def start_errors(events: DataFrame) -> DataFrame:
    """Start events of unknown or already started containers."""
    return transitions(events).filter(F.col("problem").isNotNull()).select(
        "container_id", "seq", "problem")


def classify_completion(events: DataFrame) -> DataFrame:
    t = transitions(events).filter(F.col("event") == "COMPLETED")
    e = F.col("effect")
    return t.select("container_id", "role_id", "seq", "exit_code",
                    F.when(e == "RELEASED", "released").when(e == "SURPLUS_ENDED", "surplus")
                    .when(e == "UNKNOWN", "unknown").otherwise("failed").alias("result"))


def short_lived(events: DataFrame, threshold_ms: int = SHORT_LIVED_MS) -> DataFrame:
    """Failed completions with their run time and whether it was too short."""
    t = transitions(events, threshold_ms).filter(F.col("effect").isin("FAILED", "FAILED_SHORT"))
    return t.select("container_id", "seq", "lived_ms", (F.col("effect") == "FAILED_SHORT").alias("short_lived"))


def role_counters(trans: DataFrame) -> DataFrame:
    """Counters per role out of transitions; plain sums, so also valid on a stream."""
    e = F.col("effect")
    failed = e.isin("FAILED", "FAILED_SHORT", "START_FAILED")
    return trans.groupBy("role_id").agg(
        F.count_if(e.isin("ASSIGNED", "SURPLUS")).alias("allocated"),
        F.count_if(e == "ASSIGNED").alias("assigned"), F.count_if("gone").alias("ended"),
        F.count_if(e == "STARTED").alias("started"),
        F.count_if(e == "RELEASED").alias("completed"),
        F.count_if(failed).alias("failed"),
        F.count_if(e.isin("FAILED_SHORT", "START_FAILED")).alias("start_failed"),
        (F.count_if(e == "RELEASING") - F.count_if(e == "RELEASED")).alias("releasing"),
        F.count_if(e.isin("RELEASED", "FAILED", "FAILED_SHORT", "UNKNOWN")).alias("completions"),
        F.count_if(e.isin("STARTED", "START_ERROR")).alias("start_events"),
        F.count_if(e == "START_FAILED").alias("failed_starts"), F.count_if(e == "SURPLUS").alias("surplus"),
        F.count_if(e == "UNKNOWN").alias("unknown_completed"))


def role_statistics(events: DataFrame, roles: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """The eight counters of each role; ``roles(role_id, desired, requested)``.

    ``requested`` is all requests ever made. A container counts as live from its
    assignment to its first end. ``counters`` are ``role_counters`` that are there already.
    """
    counters = role_counters(transitions(events)) if counters is None else counters
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return roles.join(counters, "role_id", "left").select(
        "role_id",
        F.greatest(F.col("requested") - zero("allocated"), F.lit(0)).cast("long").alias("active_requests"),
        zero("completed").alias("completed"), F.col("desired").cast("long").alias("desired"),
        zero("failed").alias("failed"), (zero("assigned") - zero("ended")).alias("live"),
        F.col("requested").cast("long").alias("requested"), zero("started").alias("started"),
        zero("start_failed").alias("start_failed"))


def application_statistics(events: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """Totals over all roles, with surplus and unknown completions; one row, also without events.

    ``counters`` are ``role_counters`` that are there already.
    """
    counters = role_counters(transitions(events)) if counters is None else counters
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return counters.agg(
        total("completions", "completed"), total("failed", "failed"), total("start_events", "started"),
        total("failed_starts", "start_failed"), total("surplus", "surplus"), total("unknown_completed", "unknown_completed"))


def progress(roles: DataFrame) -> DataFrame:
    """Share of the desired instances that exist; 100 when none are desired."""
    wanted = F.sum("desired")
    return roles.agg(F.when(wanted == 0, F.lit(100.0)).otherwise(
        F.sum("actual") / wanted).alias("progress"))


def delta() -> Column:
    raw = F.col("desired") - (F.col("actual") + F.col("requested"))
    return F.when(raw < 0, F.least(raw + F.col("releasing"), F.lit(0))).otherwise(raw).cast("long")


def role_delta(roles: DataFrame) -> DataFrame:
    """How many instances each role is short of (positive) or has too many (negative)."""
    return roles.select("role_id", delta().alias("delta"))


def last_failure(events: DataFrame) -> DataFrame:
    """Text of the newest failure of each role; failures without text leave the older one."""
    t = transitions(events)
    text = F.when(F.col("effect").isin("FAILED", "FAILED_SHORT"), F.format_string(
        "Failure %s on host %s", F.col("container_id"), F.col("host").cast("string")))
    return (t.withColumn("text", text).filter(F.col("text").isNotNull())
            .groupBy("role_id").agg(F.max_by("text", "seq").alias("message")))


def unstable_roles(events: DataFrame, threshold: int = FAILURE_THRESHOLD) -> DataFrame:
    """Roles that failed more often than the threshold allows."""
    e = F.col("effect")
    text = F.when(e.isin("FAILED", "FAILED_SHORT"), F.format_string(
        "Failure %s on host %s", F.col("container_id"), F.col("host").cast("string")))
    return (
        transitions(events).withColumn("text", text).groupBy("role_id").agg(
            F.count_if(e.isin("FAILED", "FAILED_SHORT", "START_FAILED")).alias("failed"),
            F.count_if(e.isin("FAILED_SHORT", "START_FAILED")).alias("start_failed"),
            F.max_by("text", F.when(F.col("text").isNotNull(), F.col("seq"))).alias("message"))
        .filter(F.col("failed") > threshold))


def _offers_in_order(offers: DataFrame, requests: DataFrame, cells: DataFrame) -> DataFrame:
    from fleetlens.operators.placement import match_requests

    used = cells.select("role_id", "host", "last_used")
    return join_one(match_requests(offers, requests), used, ["role_id", "host"], ["container_id"], "left", written=True)


def admit_allocations(offers: DataFrame, roles: DataFrame, requests: DataFrame,
                      cells: DataFrame) -> DataFrame:
    """Accept offers up to the desired count of each role, the rest is surplus.

    Asked-for hosts come first, then the most recently used ones. ``position`` is the place of
    every offer; ``decide_allocations`` gives the decisions without ranking them all. ``cells``
    should be a written table.
    """
    ranked = rank_in_group(durable(_offers_in_order(offers, requests, cells)), ["role_id"], [
        F.col("requested").desc(), F.col("last_used").desc_nulls_last(), F.col("container_id").asc()], "position")
    return join_one(ranked, roles.select("role_id", "desired", "actual"), ["role_id"], ["container_id"]).select(
        "role_id", "container_id", "host", "requested", "position",
        F.when(F.col("actual") + F.col("position") <= F.col("desired"), "assigned")
        .otherwise("surplus").alias("decision"))


def decide_allocations(offers: DataFrame, roles: DataFrame, requests: DataFrame, cells: DataFrame) -> DataFrame:
    """The decisions of ``admit_allocations``.

    Offers are counted by (role, asked for), which tells how many of each kind fit, and by how
    recently their host was used, which decides all of them but those around the last place; only
    these are ranked.
    """
    from fleetlens.operators.placement import recency

    flagged = durable(_offers_in_order(offers, requests, cells))
    counts = flagged.groupBy("role_id").agg(F.count_if("requested").alias("_asked"))
    fit = F.greatest(F.col("desired") - F.col("actual"), F.lit(0))
    room = roles.join(counts, "role_id").select("role_id", F.least(fit, "_asked").cast("long").alias("_fit_asked"),
                                                F.greatest(fit - F.col("_asked"), F.lit(0)).cast("long").alias("_fit_other"))
    limited = join_one(flagged, room, ["role_id"], ["container_id"]).withColumn(
        "_fit", F.when(F.col("requested"), F.col("_fit_asked")).otherwise(F.col("_fit_other"))).drop("_fit_asked", "_fit_other")
    cut = durable(cut_in_group(limited, ["role_id", "requested"], recency(cells), "_fit"))
    unsure = rank_in_group(cut.filter(F.col("_side") == OPEN), ["role_id", "requested"],
                           [F.col("last_used").desc_nulls_last(), F.col("container_id").asc()], "_place")
    decided = cut.filter(F.col("_side") != OPEN).withColumn("_in", F.col("_side") == SURE).unionByName(
        unsure.withColumn("_in", F.col("_place") <= F.col("_left")).drop("_place"))
    return decided.select("role_id", "container_id", "host", "requested",
                          F.when(F.col("_in"), "assigned").otherwise("surplus").alias("decision"))


def rebuild_from_live(live: DataFrame) -> DataFrame:
    """Life-cycle events that bring a restarted master up to the reported containers.

    ``live(container_id, role_id, host, ts)``; each container is allocated and started.
    The result can be fed to every operator here, alone or in front of newer events:
    its positions are unique and lie far below any real log position.
    """
    steps = F.array(F.lit("ALLOCATED"), F.lit("STARTED"))
    # numbers are fixed by writing them down; their order does not matter
    numbered = durable(live.select(F.monotonically_increasing_id().alias("_n"), "container_id", "role_id", "host", "ts"))
    walked = numbered.select("_n", "container_id", "role_id", "host", "ts", F.posexplode(steps).alias("_i", "event"))
    return walked.select(
        "container_id", "role_id", "host", "event", "ts",
        (F.col("_n") * 2 + F.col("_i") - F.lit(2**62)).alias("seq"),
        F.lit(None).cast("int").alias("exit_code"), F.lit(None).cast("string").alias("diagnostics"))


def scale_plan(roles: DataFrame, cells: DataFrame) -> DataFrame:
    """Asks and releases that bring every role to its desired count.

    Roles excluded from flexing are left alone.
    """
    from fleetlens.operators.placement import EXCLUDE_FROM_FLEXING, pick_hosts, release_by_role

    flexed = roles.filter(F.col("policy").bitwiseAND(EXCLUDE_FROM_FLEXING) == 0).withColumn("delta", delta())
    asks = pick_hosts(cells, flexed.filter("delta > 0").select("role_id", F.col("delta").alias("k"), "policy"))
    drops = release_by_role(cells, flexed.filter("delta < 0").select("role_id", (-F.col("delta")).alias("n")))
    return asks.select("role_id", F.lit("request").alias("operation"), F.col("slot").alias("step"), "host").unionByName(
        drops.select("role_id", F.lit("release").alias("operation"), F.col("rank").alias("step"), "host"))


def instances_by_role(state: DataFrame, page: int = 1000) -> DataFrame:
    """Container ids of each role in sorted pages of at most ``page`` ids."""
    ranked = rank_in_group(state.select("role_id", "container_id"), ["role_id"], [F.col("container_id").asc()])
    return ranked.withColumn("page", F.floor((F.col("rank") - 1) / page).cast("long")).groupBy(
        "role_id", "page").agg(F.sort_array(F.collect_list("container_id")).alias("container_ids"))


def instance_records(state: DataFrame, page: int = 1000) -> DataFrame:
    """Records of the containers of each role, by id, in sorted pages of at most ``page`` records.

    ``state`` is the result of ``container_state``; times become epoch milliseconds. A page is
    an array of (container_id, record), so that it can be turned into a map from id to record.
    """
    known = state.filter(F.col("container_id").isNotNull())
    ranked = rank_in_group(known, ["role_id"], [F.col("container_id").asc()])
    record = F.struct(
        "host", "state", "released", millis(F.col("create_ts")).alias("create_time"),
        millis(F.col("start_ts")).alias("start_time"), "exit_code", "diagnostics").alias("record")
    return ranked.withColumn("page", F.floor((F.col("rank") - 1) / page).cast("long")).groupBy("role_id", "page").agg(
        F.sort_array(F.collect_list(F.struct("container_id", record))).alias("records"))


def live_in_role(state: DataFrame, role_id=None) -> DataFrame:
    live = state.filter(F.col("state") == STATE_LIVE)
    return live if role_id is None else live.filter(F.col("role_id") == role_id)


def by_ids(state: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the wanted containers, each once; ids without a row are left out."""
    return state.join(ids.select("container_id"), "container_id", "left_semi")


def missing_ids(state: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("container_id").distinct().join(state, "container_id", "left_anti")


def first_live(events: DataFrame, limit_ms: int | None = None) -> DataFrame:
    """When each role first had a live container, and whether that was soon enough.

    Time is counted from the first event of the role.
    """
    summary = container_summary(events)
    live = summary.groupBy("role_id").agg(F.min("start_ts").alias("live_ts"))
    begun = events.groupBy("role_id").agg(F.min("ts").alias("begun_ts"))
    took = millis(F.col("live_ts")) - millis(F.col("begun_ts"))
    ok = F.col("live_ts").isNotNull() if limit_ms is None else F.coalesce(took <= limit_ms, F.lit(False))
    return begun.join(live, "role_id", "left").select("role_id", "live_ts", ok.alias("in_time"))
