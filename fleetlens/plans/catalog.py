"""Registered queries: every operator over whole tables, with its SQL oracle.

``QUERIES[name] = (run(spark, sf_dir), sql or None)``.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import agents, config, health, lifecycle, logs, placement, registry, status
from fleetlens.plans import views as v
from fleetlens.plans.views import BOOT_MS, SHORT_MS, with_views
from fleetlens.session import durable, ensure_checkpoint_dir
from fleetlens.sources import heartbeats, history
from fleetlens.streaming import streams

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Run, str | None]] = {}

TRANS = "lifecycle opened firsts steps summary kinds transitions"
SUMMARY = "lifecycle opened firsts steps summary"
PROBE = "probes cycles passed marks booted phased fatal labelled"
CUTOFF = dt.datetime(1999, 6, 1)
RELEASE_N = 500


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[name] = (run, sql)
        return run
    return add


# --- placement ---------------------------------------------------------------

@query("release_candidates", with_views("placement copies chosen", f"""
    SELECT role_id, host, active, phase, copy, rank FROM chosen WHERE rank <= {RELEASE_N}"""))
def _(spark, d):
    return placement.release_candidates(v.placement(spark, d), RELEASE_N)


SCALE = """
  d AS (SELECT *, CASE WHEN desired - actual - requested < 0
                       THEN least(desired - actual - requested + releasing, 0)
                       ELSE desired - actual - requested END AS delta FROM roles WHERE policy <> 1),
  ranked AS (SELECT f.role_id, f.host, row_number() OVER (PARTITION BY f.role_id ORDER BY last_used DESC, f.host) AS slot
             FROM free f JOIN d USING (role_id) WHERE d.policy <> 2 AND d.delta > 0),
  slots AS (SELECT role_id, unnest(range(1, delta + 1)) AS slot FROM d WHERE delta > 0)
  SELECT role_id, 'request' AS operation, slot AS step, host FROM slots LEFT JOIN ranked USING (role_id, slot)
  UNION ALL SELECT role_id, 'release', rank, host FROM chosen JOIN d USING (role_id) WHERE rank <= -delta"""


@query("scale_plan", with_views("placement roles free copies chosen", SCALE, recursive=True))
def scale_plan(spark, d):
    cells = durable(v.placement(spark, d))
    return lifecycle.scale_plan(v.roles(spark, d, cells), cells)


@query("available_cells", with_views("placement free", "SELECT * FROM free"))
def _(spark, d):
    return placement.available_cells(v.placement(spark, d))


@query("recency_rank", with_views("placement", """
    SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY last_used DESC, host) AS recency FROM placement"""))
def _(spark, d):
    return placement.recency_rank(v.placement(spark, d))


@query("pick_hosts", with_views("placement roles demand free", """
    ranked AS (SELECT role_id, host, row_number() OVER (PARTITION BY role_id ORDER BY last_used DESC, host) AS slot
               FROM free WHERE role_id IN (SELECT role_id FROM demand WHERE policy <> 2)),
    slots AS (SELECT role_id, unnest(range(1, k + 1)) AS slot FROM demand)
    SELECT role_id, slot, host FROM slots LEFT JOIN ranked USING (role_id, slot)""", recursive=True))
def _(spark, d):
    cells = durable(v.placement(spark, d))
    return placement.pick_hosts(cells, v.demand(spark, d, cells))


@query("busiest_hosts", with_views("placement", """
    SELECT role_id, host, live - releasing AS active,
           rank() OVER (PARTITION BY role_id ORDER BY live - releasing DESC) AS rank
    FROM placement WHERE live > releasing"""))
def _(spark, d):
    return placement.busiest_hosts(v.placement(spark, d))


STALE = f"live = releasing AND requested = 0 AND starting = 0 AND last_used < TIMESTAMP '{CUTOFF:%Y-%m-%d}'"


@query("purge_cells", with_views("placement", f"SELECT * FROM placement WHERE NOT ({STALE})"))
def _(spark, d):
    return placement.purge_cells(v.placement(spark, d), CUTOFF)


@query("purged_hosts", with_views("order_placement", f"""
    SELECT host, count(*) AS cells FROM order_placement GROUP BY host HAVING bool_and({STALE})"""))
def _(spark, d):
    return placement.purged_hosts(v.placement(spark, d, "l_orderkey"), CUTOFF)


@query("located_requests", with_views("requests located", "SELECT * FROM located"))
def _(spark, d):
    return placement.located_requests(v.requests(spark, d))


@query("match_requests", with_views("requests located offers", """
    SELECT role_id, host, container_id, request_id IS NOT NULL AS requested FROM offers LEFT JOIN located USING (role_id, host)"""))
def _(spark, d):
    return placement.match_requests(v.offers(spark, d), v.requests(spark, d))


SETTLED = """
    SELECT l.role_id, l.host, l.request_id,
           CASE WHEN EXISTS (SELECT 1 FROM offers o WHERE o.role_id = l.role_id AND o.host = l.host) THEN 'satisfied'
                WHEN EXISTS (SELECT 1 FROM roles r JOIN (SELECT role_id, count(*) AS n FROM offers GROUP BY role_id) a
                             USING (role_id) WHERE r.role_id = l.role_id AND r.desired <= r.actual + a.n) THEN 'cancelled'
                ELSE 'outstanding' END AS status
    FROM located l"""


def settled(spark, d, cells=None):
    return placement.settle_requests(v.requests(spark, d), v.offers(spark, d), v.roles(spark, d, cells))


@query("settle_requests", with_views("placement roles requests located offers", SETTLED))
def _(spark, d):
    return settled(spark, d)


@query("returned_hosts", with_views("placement roles requests located offers free", f"""
    settled AS ({SETTLED}),
    pool AS (SELECT role_id, host FROM free UNION SELECT role_id, host FROM settled WHERE status = 'cancelled')
    SELECT role_id, host, last_used, row_number() OVER (PARTITION BY role_id ORDER BY last_used DESC, host) AS recency
    FROM pool JOIN placement USING (role_id, host)""", recursive=True))
def _(spark, d):
    cells = durable(v.placement(spark, d))
    return placement.returned_hosts(settled(spark, d, cells), cells)


@query("cluster_size", "SELECT count(DISTINCT l_partkey) AS hosts FROM lineitem")
def _(spark, d):
    return placement.cluster_size(v.placement(spark, d))


@query("containers_to_release", with_views("placement copies chosen containers", f"""
    named AS (SELECT role_id, host, container_id,
                     row_number() OVER (PARTITION BY role_id, host ORDER BY container_id) AS copy
              FROM containers WHERE NOT releasing),
    picked AS (SELECT role_id, host, rank, row_number() OVER (PARTITION BY role_id, host ORDER BY rank) AS copy
               FROM chosen WHERE rank <= {RELEASE_N})
    SELECT role_id, rank, host, container_id FROM picked LEFT JOIN named USING (role_id, host, copy)""", recursive=True))
def _(spark, d):
    chosen = placement.release_candidates(v.placement(spark, d), RELEASE_N)
    return placement.containers_to_release(v.containers(spark, d), chosen)


def trans(spark, d):
    return lifecycle.transitions(v.lifecycle(spark, d), SHORT_MS)


@query("placement_cells", with_views(TRANS, """
    moves AS (SELECT *,
        CASE effect WHEN 'ASSIGNED' THEN 1 WHEN 'STARTED' THEN -1 WHEN 'START_FAILED' THEN -1
                    WHEN 'FAILED_SHORT' THEN -1 ELSE 0 END AS ds,
        CASE effect WHEN 'STARTED' THEN 1 WHEN 'RELEASED' THEN -1 WHEN 'FAILED' THEN -1 ELSE 0 END AS dl,
        CASE effect WHEN 'RELEASING' THEN 1 WHEN 'RELEASED' THEN -1 ELSE 0 END AS dr
      FROM transitions WHERE effect IN ('ASSIGNED', 'STARTED', 'RELEASING', 'START_FAILED', 'FAILED_SHORT', 'RELEASED', 'FAILED')),
    sums AS (SELECT *, sum(ds) OVER w AS ss, sum(dl) OVER w AS sl, sum(dr) OVER w AS sr FROM moves
             WINDOW w AS (PARTITION BY role_id, host ORDER BY seq)),
    walk AS (SELECT *, CAST(ss - least(0, min(ss) OVER w) AS BIGINT) AS starting,
                    CAST(sl - least(0, min(sl) OVER w) AS BIGINT) AS live,
                    CAST(sr - least(0, min(sr) OVER w) AS BIGINT) AS releasing
             FROM sums WINDOW w AS (PARTITION BY role_id, host ORDER BY seq))
    SELECT role_id, host, CAST(0 AS BIGINT) AS requested, arg_max(starting, seq) AS starting,
           count(*) FILTER (effect IN ('START_FAILED', 'FAILED_SHORT')) AS start_failed,
           count(*) FILTER (effect IN ('START_FAILED', 'FAILED_SHORT', 'FAILED')) AS failed,
           arg_max(live, seq) AS live, arg_max(releasing, seq) AS releasing,
           max(ts) FILTER (effect IN ('RELEASED', 'FAILED') AND live = releasing AND starting = 0) AS last_used
    FROM walk GROUP BY role_id, host""", recursive=True))
def _(spark, d):
    return placement.placement_cells(trans(spark, d))


@query("placement_sums", with_views(TRANS, """
    SELECT role_id, host,
           count(*) FILTER (effect = 'ASSIGNED') - count(*) FILTER (effect IN ('STARTED', 'START_FAILED', 'FAILED_SHORT')) AS starting,
           count(*) FILTER (effect = 'STARTED') - count(*) FILTER (effect IN ('RELEASED', 'FAILED')) AS live,
           count(*) FILTER (effect = 'RELEASING') - count(*) FILTER (effect = 'RELEASED') AS releasing,
           count(*) FILTER (effect IN ('START_FAILED', 'FAILED', 'FAILED_SHORT')) AS failed
    FROM transitions GROUP BY role_id, host"""))
def _(spark, d):
    return placement.placement_sums(trans(spark, d))


# --- life cycle --------------------------------------------------------------

STATE_SQL = """
    SELECT container_id, role_id, host,
           CASE WHEN e IS NOT NULL AND s IS NOT NULL THEN 5 WHEN s IS NOT NULL THEN 3 ELSE 1 END AS state,
           r IS NOT NULL AS released, create_ts, start_ts,
           CASE WHEN e IS NOT NULL AND s IS NOT NULL THEN exit_code END AS exit_code,
           CASE WHEN e IS NOT NULL AND s IS NOT NULL THEN diagnostics
                WHEN f IS NOT NULL THEN start_diagnostics END AS diagnostics
    FROM summary WHERE a IS NOT NULL"""


def state(spark, d):
    return lifecycle.container_state(v.lifecycle(spark, d))


@query("container_state", with_views(SUMMARY, STATE_SQL))
def _(spark, d):
    return state(spark, d)


@query("transitions", with_views(TRANS, "SELECT container_id, seq, effect FROM transitions"))
def _(spark, d):
    return trans(spark, d).select("container_id", "seq", "effect")


@query("start_errors", with_views(TRANS, """
    SELECT container_id, seq, CASE WHEN a IS NULL OR seq < a OR coalesce(seq > e, FALSE) OR coalesce(seq > f, FALSE)
                                   THEN 'not an active container' ELSE 'already started' END AS problem
    FROM transitions WHERE effect = 'START_ERROR'"""))
def _(spark, d):
    return lifecycle.start_errors(v.lifecycle(spark, d))


@query("classify_completion", with_views(TRANS, """
    SELECT container_id, role_id, seq, exit_code, kind AS result FROM transitions WHERE event = 'COMPLETED'"""))
def _(spark, d):
    return lifecycle.classify_completion(v.lifecycle(spark, d))


@query("short_lived", with_views(TRANS, f"""
    SELECT container_id, seq, lived AS lived_ms, start_ts IS NULL OR lived < {SHORT_MS} AS short_lived
    FROM transitions WHERE kind = 'failed'"""))
def _(spark, d):
    return lifecycle.short_lived(v.lifecycle(spark, d), SHORT_MS)


ROLE_STATS = f"""
    c AS (SELECT role_id, count(*) FILTER (effect IN ('ASSIGNED', 'SURPLUS')) AS allocated,
                 count(*) FILTER (effect = 'RELEASED') AS completed,
                 count(*) FILTER (kind = 'failed' OR effect = 'START_FAILED') AS failed,
                 count(*) FILTER (effect = 'STARTED') AS started,
                 count(*) FILTER (effect = 'START_FAILED' OR (kind = 'failed' AND (start_ts IS NULL OR lived < 60))) AS start_failed
          FROM transitions GROUP BY role_id),
    l AS (SELECT role_id, count(*) FILTER (e IS NULL) AS live FROM summary WHERE a IS NOT NULL GROUP BY role_id),
    stats AS (SELECT role_id, greatest(requested - coalesce(allocated, 0), 0) AS active_requests,
                     coalesce(completed, 0) AS completed, desired, coalesce(failed, 0) AS failed,
                     coalesce(live, 0) AS live, requested, coalesce(started, 0) AS started,
                     coalesce(start_failed, 0) AS start_failed
              FROM lifecycle_roles LEFT JOIN c USING (role_id) LEFT JOIN l USING (role_id))"""


def stats(spark, d):
    return lifecycle.role_statistics(v.lifecycle(spark, d), v.lifecycle_roles(spark, d))


@query("role_statistics", with_views(TRANS + " lifecycle_roles", ROLE_STATS + " SELECT * FROM stats", recursive=True))
def _(spark, d):
    return stats(spark, d)


APPLICATION_SQL = """
    SELECT count(*) FILTER (event = 'COMPLETED' AND kind <> 'surplus') AS completed,
           count(*) FILTER (kind = 'failed' OR effect = 'START_FAILED') AS failed,
           count(*) FILTER (event = 'STARTED') AS started, count(*) FILTER (effect = 'START_FAILED') AS start_failed,
           count(*) FILTER (effect = 'SURPLUS') AS surplus, count(*) FILTER (kind = 'unknown') AS unknown_completed
    FROM transitions"""


@query("application_statistics", with_views(TRANS, APPLICATION_SQL))
def _(spark, d):
    return lifecycle.application_statistics(v.lifecycle(spark, d))


@query("progress", with_views("placement roles", """
    SELECT CASE WHEN sum(desired) = 0 THEN 100.0 ELSE CAST(sum(actual) AS DOUBLE) / CAST(sum(desired) AS DOUBLE) END AS progress
    FROM roles"""))
def _(spark, d):
    return lifecycle.progress(v.roles(spark, d))


@query("role_delta", with_views("placement roles", """
    SELECT role_id, CASE WHEN desired < actual + requested THEN least(desired - actual - requested + releasing, 0)
                         ELSE desired - actual - requested END AS delta FROM roles"""))
def _(spark, d):
    return lifecycle.role_delta(v.roles(spark, d))


@query("last_failure", with_views(TRANS, """
    SELECT role_id, 'Failure ' || arg_max(container_id, seq) || ' on host ' || arg_max(host, seq) AS message
    FROM transitions WHERE kind = 'failed' GROUP BY role_id"""))
def _(spark, d):
    return lifecycle.last_failure(v.lifecycle(spark, d))


@query("unstable_roles", with_views(TRANS, """
    SELECT role_id, count(*) FILTER (kind = 'failed' OR effect = 'START_FAILED') AS failed,
           count(*) FILTER (effect = 'START_FAILED' OR (kind = 'failed' AND (start_ts IS NULL OR lived < 60))) AS start_failed,
           'Failure ' || arg_max(container_id, seq) FILTER (kind = 'failed') || ' on host '
             || arg_max(host, seq) FILTER (kind = 'failed') AS message
    FROM transitions GROUP BY role_id
    HAVING count(*) FILTER (kind = 'failed' OR effect = 'START_FAILED') > 5"""))
def _(spark, d):
    return lifecycle.unstable_roles(v.lifecycle(spark, d))


@query("admit_allocations", with_views("placement roles requests located offers", """
    ranked AS (SELECT o.role_id, o.container_id, o.host, l.request_id IS NOT NULL AS requested,
                      row_number() OVER (PARTITION BY o.role_id ORDER BY (l.request_id IS NOT NULL) DESC,
                                         p.last_used DESC NULLS LAST, o.container_id) AS position
               FROM offers o LEFT JOIN located l ON l.role_id = o.role_id AND l.host = o.host
               LEFT JOIN placement p ON p.role_id = o.role_id AND p.host = o.host)
    SELECT role_id, container_id, host, ranked.requested, position,
           CASE WHEN actual + position <= desired THEN 'assigned' ELSE 'surplus' END AS decision
    FROM ranked JOIN roles USING (role_id)""", recursive=True))
def _(spark, d):
    cells = durable(v.placement(spark, d))
    return lifecycle.admit_allocations(v.offers(spark, d), v.roles(spark, d, cells), v.requests(spark, d), cells)


@query("decide_allocations", with_views("placement roles requests located offers", """
    ranked AS (SELECT o.role_id, o.container_id, o.host, l.request_id IS NOT NULL AS requested,
                      row_number() OVER (PARTITION BY o.role_id ORDER BY (l.request_id IS NOT NULL) DESC,
                                         p.last_used DESC NULLS LAST, o.container_id) AS position
               FROM offers o LEFT JOIN located l ON l.role_id = o.role_id AND l.host = o.host
               LEFT JOIN placement p ON p.role_id = o.role_id AND p.host = o.host)
    SELECT role_id, container_id, host, ranked.requested,
           CASE WHEN actual + position <= desired THEN 'assigned' ELSE 'surplus' END AS decision
    FROM ranked JOIN roles USING (role_id)""", recursive=True))
def _(spark, d):
    cells = durable(v.placement(spark, d))
    return lifecycle.decide_allocations(v.offers(spark, d), v.roles(spark, d, cells), v.requests(spark, d), cells)


@query("rebuild_from_live", with_views("containers", """
    SELECT role_id, count(*) AS live, count(DISTINCT host) AS hosts FROM containers WHERE NOT releasing GROUP BY role_id"""))
def _(spark, d):
    live = v.containers(spark, d).filter(~F.col("releasing")).withColumn("ts", F.lit(CUTOFF).cast("timestamp_ntz"))
    rebuilt = lifecycle.container_state(lifecycle.rebuild_from_live(live))
    return lifecycle.live_in_role(rebuilt).groupBy("role_id").agg(
        F.count("*").alias("live"), F.count_distinct("host").alias("hosts"))


@query("instances_by_role", with_views(SUMMARY, f"""
    st AS ({STATE_SQL}),
    r AS (SELECT role_id, container_id, row_number() OVER (PARTITION BY role_id ORDER BY container_id) AS rank FROM st)
    SELECT role_id, (rank - 1) // 100 AS page, string_agg(container_id, ',' ORDER BY container_id) AS container_ids
    FROM r GROUP BY ALL""", recursive=True))
def _(spark, d):
    return lifecycle.instances_by_role(state(spark, d), page=100).withColumn(
        "container_ids", F.array_join("container_ids", ","))


@query("instance_records", with_views(SUMMARY, f"""
    st AS ({STATE_SQL}),
    r AS (SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY container_id) AS rank FROM st)
    SELECT role_id, (rank - 1) // 100 AS page,
           string_agg(container_id || '@' || host || '/' || state || '/' || coalesce(epoch_us(start_ts) // 1000, -1), ',' ORDER BY container_id) AS records
    FROM r GROUP BY ALL""", recursive=True))
def _(spark, d):
    text = lambda r: F.concat(r.container_id, F.lit("@"), r.record.host, F.lit("/"), r.record.state, F.lit("/"),
                              F.coalesce(r.record.start_time, F.lit(-1)))
    return lifecycle.instance_records(state(spark, d), page=100).withColumn(
        "records", F.array_join(F.transform("records", text), ","))


@query("live_in_role", with_views(SUMMARY, f"SELECT container_id, role_id, host FROM ({STATE_SQL}) WHERE state = 3"))
def _(spark, d):
    return lifecycle.live_in_role(state(spark, d)).select("container_id", "role_id", "host")


def wanted_ids(spark, d):
    e = v.lifecycle(spark, d)
    return e.filter(F.col("event") == "RELEASED").select("container_id")


@query("by_ids", with_views(SUMMARY, f"""
    SELECT container_id, role_id, state FROM ({STATE_SQL})
    WHERE container_id IN (SELECT container_id FROM lifecycle WHERE event = 'RELEASED')"""))
def _(spark, d):
    return lifecycle.by_ids(state(spark, d), wanted_ids(spark, d)).select("container_id", "role_id", "state")


@query("missing_ids", with_views(SUMMARY, f"""
    SELECT DISTINCT container_id FROM lifecycle WHERE event = 'RELEASED'
      AND container_id NOT IN (SELECT container_id FROM ({STATE_SQL}))"""))
def _(spark, d):
    return lifecycle.missing_ids(state(spark, d), wanted_ids(spark, d))


@query("first_live", with_views(SUMMARY, """
    SELECT role_id, live_ts, coalesce((epoch_us(live_ts) // 1000) - (epoch_us(begun_ts) // 1000) <= 7200000, FALSE) AS in_time
    FROM (SELECT role_id, min(ts) AS begun_ts FROM lifecycle GROUP BY role_id)
    LEFT JOIN (SELECT role_id, min(start_ts) AS live_ts FROM summary GROUP BY role_id) USING (role_id)"""))
def _(spark, d):
    return lifecycle.first_live(v.lifecycle(spark, d), 7_200_000)


# --- status reports ----------------------------------------------------------

@query("status_by_role", with_views(TRANS + " lifecycle_roles", ROLE_STATS + f""",
    st AS ({STATE_SQL}),
    up AS (SELECT role_id, count(*) AS actual, count(*) FILTER (released) AS releasing FROM st WHERE state <= 3 GROUP BY role_id)
    SELECT role_id, name, stats.desired, coalesce(actual, 0) AS actual, active_requests AS requested,
           coalesce(releasing, 0) AS releasing, failed, start_failed
    FROM lifecycle_roles JOIN stats USING (role_id) LEFT JOIN up USING (role_id)""", recursive=True))
def _(spark, d):
    events, roles = v.lifecycle(spark, d), v.lifecycle_roles(spark, d)
    summary = durable(lifecycle.container_summary(events))
    counters = lifecycle.role_counters(lifecycle.transitions(events, summary=summary))
    return status.status_by_role(
        lifecycle.container_state(events, summary), lifecycle.role_statistics(events, roles, counters), roles)


def documents(spark, d):
    events, roles = v.lifecycle(spark, d), v.lifecycle_roles(spark, d)
    summary = durable(lifecycle.container_summary(events))
    counters = durable(lifecycle.role_counters(lifecycle.transitions(events, summary=summary)))
    return status.status_document(
        lifecycle.container_state(events, summary), lifecycle.role_statistics(events, roles, counters), roles,
        lifecycle.application_statistics(events, counters), {"status": "live", "version": "2"}, {"version": "1", "owner": "ops"})


@query("status_document")
def _(spark, d):
    return documents(spark, d)


def _rows_sql(section, keys, source, role="role_id"):
    return " UNION ALL ".join(f"SELECT {role} AS role_id, '{section}' AS section, '{k}' AS key, CAST({c} AS VARCHAR) AS value FROM {source}"
                              for c, k in keys.items())


@query("status_document_entries", with_views(TRANS + " lifecycle_roles", ROLE_STATS + f""",
    st AS ({STATE_SQL}),
    up AS (SELECT role_id, count(*) AS actual, count(*) FILTER (released) AS releasing FROM st WHERE state <= 3 GROUP BY role_id),
    s AS (SELECT role_id, name, stats.desired, coalesce(actual, 0) AS actual, active_requests AS requested,
                 coalesce(releasing, 0) AS releasing, failed, start_failed
          FROM lifecycle_roles JOIN stats USING (role_id) LEFT JOIN up USING (role_id)),
    app AS (SELECT *, (SELECT count(*) FROM st WHERE state <= 3) AS live FROM ({APPLICATION_SQL}))
    {_rows_sql("role", {c: c for c in status._ROLE}, "s")} UNION ALL {_rows_sql("statistics", status.STATISTIC_KEYS, "stats")}
    UNION ALL {_rows_sql("statistics", status.APPLICATION_KEYS, "app", "CAST(NULL AS INTEGER)")}
    UNION ALL SELECT CAST(NULL AS INTEGER), 'info', k, v FROM (VALUES ('status', 'live'), ('version', '2'), ('owner', 'ops')) AS i(k, v)""",
    recursive=True))
def _(spark, d):
    return status.status_entries(documents(spark, d))


RECORD_SQL = """role_id, container_id, host, state, released, epoch_us(create_ts) // 1000 AS create_time,
           epoch_us(start_ts) // 1000 AS start_time, exit_code, diagnostics"""


@query("status_document_records", with_views(SUMMARY, f"SELECT {RECORD_SQL} FROM ({STATE_SQL}) WHERE state <= 3"))
def _(spark, d):
    return status.status_records(documents(spark, d)).withColumn("host", F.col("host").cast("long"))


def dimension_roles(spark, d):
    """Role names from the nations: more of them than there are life-cycle roles."""
    return v.table(spark, d, "nation").select(
        F.col("n_nationkey").cast("int").alias("role_id"), F.lower("n_name").alias("name"))


@query("status_by_name", with_views(TRANS + " lifecycle_roles", ROLE_STATS + """
    SELECT lower(n_name) AS name, stats.* FROM nation JOIN stats ON n_nationkey = role_id""", recursive=True))
def _(spark, d):
    return status.status_by_name(dimension_roles(spark, d), stats(spark, d))


@query("roles_without_stats", with_views(TRANS + " lifecycle_roles", ROLE_STATS + """
    SELECT CAST(n_nationkey AS INTEGER) AS role_id, lower(n_name) AS name FROM nation
    WHERE n_nationkey NOT IN (SELECT role_id FROM stats)""", recursive=True))
def _(spark, d):
    return status.roles_without_stats(dimension_roles(spark, d), stats(spark, d))


@query("container_listing", with_views(SUMMARY, f"""
    SELECT role_id, container_id, host, 'http://' || s_name || '/node/container/' || container_id AS link
    FROM ({STATE_SQL}) LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = host"""))
def _(spark, d):
    addresses = v.table(spark, d, "supplier").filter(F.col("s_acctbal") > 0).select(
        F.col("s_suppkey").alias("host"), F.col("s_name").alias("address"))
    return status.container_listing(state(spark, d), addresses)


# --- application registry ----------------------------------------------------

APP = "app_id, name, state"


@query("list_apps", with_views("registry", f"""SELECT {APP} FROM registry WHERE type = '2-HIGH' AND "user" = 3"""))
def _(spark, d):
    return registry.list_apps(v.registry(spark, d), "2-HIGH", 3).select("app_id", "name", "state")


@query("find_apps", with_views("registry", f"SELECT {APP} FROM registry WHERE type = '2-HIGH' AND name = 'app-7'"))
def _(spark, d):
    return registry.find_apps(v.registry(spark, d), "2-HIGH", "app-7").select("app_id", "name", "state")


@query("live_apps", with_views("registry", f"SELECT {APP} FROM registry WHERE state IN ('ACCEPTED', 'RUNNING')"))
def _(spark, d):
    return registry.live_apps(v.registry(spark, d)).select("app_id", "name", "state")


PICK = """
    SELECT name, app_id, state, start_ts, state <> 'FINISHED' AS live FROM registry
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY state <> 'FINISHED' DESC, start_ts DESC, app_id DESC) = 1"""


@query("pick_app", with_views("registry", PICK))
def _(spark, d):
    return registry.pick_app(v.registry(spark, d))


@query("exists_app", with_views("registry", f"""
    SELECT name, CASE WHEN live IS NULL THEN 'unknown' WHEN live THEN 'running' ELSE 'not running' END AS status
    FROM (SELECT DISTINCT 'app-' || c_custkey AS name FROM customer) LEFT JOIN ({PICK}) USING (name)"""))
def _(spark, d):
    names = v.table(spark, d, "customer").select(F.concat(F.lit("app-"), v.text("c_custkey")).alias("name"))
    return registry.exists_app(names, v.registry(spark, d))


@query("reached_state", with_views("app_history", """
    SELECT app_id, CASE WHEN (epoch_us(hit) // 1000) - (epoch_us(first_ts) // 1000) <= 2592000000 THEN hit END AS reached_ts
    FROM (SELECT app_id, min(ts) AS first_ts, min(ts) FILTER (state IN ('RUNNING', 'FINISHED')) AS hit
          FROM app_history GROUP BY app_id)"""))
def _(spark, d):
    return registry.reached_state(v.app_history(spark, d), "RUNNING", 30 * 86_400_000)


@query("duplicate_running", with_views("registry", """
    SELECT "user", name, count(*) AS running FROM registry WHERE state = 'RUNNING' GROUP BY ALL HAVING count(*) > 1"""))
def _(spark, d):
    return registry.duplicate_running(v.registry(spark, d))


@query("app_containers", with_views("registry", """
    SELECT app_id, name, l_suppkey AS host,
           l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS container_id
    FROM registry JOIN lineitem ON app_id = l_orderkey"""))
def _(spark, d):
    return registry.app_containers(v.registry(spark, d), v.node_reports(spark, d))


@query("app_report_text", with_views("registry", """
    SELECT app_id, concat_ws(chr(10), 'application ' || name || '/' || type, 'state: ' || state, 'URL: ' || url,
             'Started ' || strftime(start_ts, '%-d %b %Y %H:%M:%S') || ' GMT',
             'Finished ' || strftime(finish_ts, '%-d %b %Y %H:%M:%S') || ' GMT',
             'RPC :' || rpc_host || ':' || rpc_port,
             CASE WHEN diagnostics <> '' THEN 'Diagnostics :' || diagnostics END) AS report
    FROM registry"""))
def _(spark, d):
    return registry.app_report_text(v.registry(spark, d))


# --- configuration -----------------------------------------------------------

@query("resolve_config", with_views("part_keys config resolved", "SELECT * FROM resolved"))
def _(spark, d):
    return config.resolve_config(v.config(spark, d))


def merge_sql(value: str, over: str = "config_over", base: str = "config_base") -> str:
    return with_views("part_keys config_base config_over", f"""
      SELECT coalesce(b.doc, o.doc) AS doc, coalesce(b.section, o.section) AS section,
             coalesce(b.component, o.component) AS component, coalesce(b.key, o.key) AS key, {value} AS value
      FROM {base} b FULL JOIN {over} o ON b.doc = o.doc AND b.section = o.section AND b.key = o.key
        AND coalesce(b.component, '') = coalesce(o.component, '')""")


@query("merge_config_overwrite", merge_sql("coalesce(o.value, b.value)"))
def _(spark, d):
    return config.merge_config(v.config_base(spark, d), v.config_over(spark, d))


@query("merge_config_keep", merge_sql("""
    CASE WHEN b.section = 'metadata' THEN coalesce(o.value, b.value) ELSE coalesce(b.value, o.value) END"""))
def _(spark, d):
    return config.merge_config_keep(v.config_base(spark, d), v.config_over(spark, d))


@query("merge_prefixed", merge_sql(
    "coalesce(o.value, b.value)",
    "(SELECT * FROM config_over WHERE section = 'component' AND starts_with(key, 'site.'))"))
def _(spark, d):
    return config.merge_prefixed(v.config_base(spark, d), v.config_over(spark, d), "site.", True)


@query("propagate_globals", merge_sql(
    "coalesce(o.value, b.value)", "(SELECT * FROM config_over WHERE section = 'global' AND starts_with(key, 'env.'))"))
def _(spark, d):
    return config.propagate_globals(v.config_base(spark, d), v.config_over(spark, d), "env.")


@query("site_options", with_views("part_keys config", """
    SELECT doc, section, component, substr(key, 12) AS key, replace(replace(value, '1', 'one'), '2', 'two') AS value
    FROM config WHERE starts_with(key, 'site.promo.') AND length(key) > 11"""))
def _(spark, d):
    return config.site_options(v.config(spark, d), "promo", {"1": "one", "2": "two"})


@query("env_options", with_views("part_keys config", """
    SELECT doc, section, component, substr(key, 5) AS key, value FROM config
    WHERE starts_with(key, 'env.') AND length(key) > 4"""))
def _(spark, d):
    return config.env_options(v.config(spark, d))


VAR = r"\$\{[^}$\x0020]+\}"


@query("substitute_vars", with_views("linked_entries", rf"""
    walk AS (SELECT doc, component, key, value, 0 AS round, FALSE AS stopped FROM linked_entries
      UNION ALL
      SELECT w.doc, w.component, w.key,
             CASE WHEN r.key IS NULL THEN w.value
                  ELSE substr(w.value, 1, instr(w.value, '${{' || w.name || '}}') - 1) || r.value
                       || substr(w.value, instr(w.value, '${{' || w.name || '}}') + length(w.name) + 3) END,
             w.round + 1, r.key IS NULL
      FROM (SELECT *, substr(regexp_extract(value, '{VAR}'), 3, length(regexp_extract(value, '{VAR}')) - 3) AS name
            FROM walk WHERE NOT stopped AND round < 19 AND regexp_matches(value, '{VAR}')) w
      LEFT JOIN linked_entries r ON r.doc = w.doc AND r.key = w.name)
    SELECT doc, component, key, value FROM walk
    QUALIFY row_number() OVER (PARTITION BY doc, component, key ORDER BY round DESC) = 1""", recursive=True))
def _(spark, d):
    return config.substitute_vars(v.linked_entries(spark, d), scope=("doc",)).select("doc", "component", "key", "value")


def lookup_requests(spark, d):
    over = v.config_over(spark, d).filter(F.col("section") != "metadata")
    n = F.col("value").cast("int") % 4
    return over.select("doc", "component", "key", F.when(n == 0, "0x1F").when(n == 1, "010").when(
        n == 2, "abc").otherwise(F.col("value")).alias("default"))


@query("config_lookup", with_views("part_keys config_base config_over", """
    asked AS (SELECT doc, component, key, CASE CAST(value AS INTEGER) % 4 WHEN 0 THEN '0x1F' WHEN 1 THEN '010'
                     WHEN 2 THEN 'abc' ELSE value END AS dflt FROM config_over WHERE section <> 'metadata'),
    found AS (SELECT a.doc, a.component, a.key, coalesce(b.value, a.dflt) AS value
              FROM asked a LEFT JOIN config_base b ON b.doc = a.doc AND b.key = a.key AND b.section <> 'metadata'
               AND coalesce(b.component, '') = coalesce(a.component, ''))
    SELECT *, CASE value WHEN '0x1F' THEN 31 WHEN '010' THEN 8 ELSE TRY_CAST(value AS INTEGER) END AS int_value
    FROM found""", recursive=True))
def _(spark, d):
    return config.config_lookup(v.config_base(spark, d), lookup_requests(spark, d))


@query("missing_mandatory", with_views("part_keys config_base config_over", """
    SELECT doc, component, key FROM config_over o WHERE section = 'component' AND NOT EXISTS (
      SELECT 1 FROM config_base b WHERE b.section = 'component' AND b.doc = o.doc AND b.component = o.component AND b.key = o.key)
    UNION ALL
    SELECT DISTINCT doc, component, NULL FROM config_over o WHERE section = 'component' AND NOT EXISTS (
      SELECT 1 FROM config_base b WHERE b.section = 'component' AND b.doc = o.doc AND b.component = o.component)"""))
def _(spark, d):
    own = v.config_over(spark, d).filter(F.col("section") == "component").select("doc", "component", "key")
    whole = own.select("doc", "component", F.lit(None).cast("string").alias("key")).distinct()
    return config.missing_mandatory(v.config_base(spark, d), own.unionByName(whole))


@query("audit_config", with_views("part_keys config audit_rules", """
    joined AS (SELECT *, CAST(value AS INTEGER) AS number
               FROM config JOIN audit_rules ON key = key_suffix OR ends_with(key, '.' || key_suffix))
    SELECT doc, section, component, key, value, rule,
           CASE WHEN rule IN ('int', 'count') AND number < min THEN 'below ' || min
                WHEN rule IN ('int', 'count') AND number > max THEN 'above ' || max
                WHEN rule = 'name' THEN 'bad name' ELSE 'unsupported version' END AS detail
    FROM joined
    WHERE rule IN ('name', 'schema') OR (rule IN ('int', 'count') AND (number < min OR number > max))""", recursive=True))
def _(spark, d):
    return config.audit_config(v.config(spark, d), durable(v.audit_rules(spark, d)))


@query("resource_requirement", with_views("resource_entries", """
    SELECT doc, component,
           coalesce(max(CASE WHEN key <> 'yarn.vcores' THEN NULL WHEN value = 'max' THEN 64
                             WHEN starts_with(value, '0x') THEN 64 + CAST(substr(value, 4) AS INTEGER)
                             ELSE TRY_CAST(value AS INTEGER) END), 1) AS cores,
           coalesce(max(CASE WHEN key <> 'yarn.memory' THEN NULL WHEN value = 'max' THEN 4096
                             WHEN starts_with(value, '0x') THEN 64 + CAST(substr(value, 4) AS INTEGER)
                             ELSE TRY_CAST(value AS INTEGER) END), 256) AS memory
    FROM resource_entries GROUP BY doc, component"""))
def _(spark, d):
    return config.resource_requirement(v.resource_entries(spark, d), 64, 4096)


@query("flatten_trees", with_views("part_keys config_trees", """
    roles AS (SELECT doc, tree, component, key, value FROM config_trees WHERE section = 'component'
              UNION ALL
              SELECT n.doc, n.tree, n.component, g.key, g.value
              FROM (SELECT DISTINCT doc, tree, component FROM config_trees WHERE section = 'component') n
              JOIN config_trees g ON g.doc = n.doc AND g.tree = n.tree AND g.section = 'global'
              WHERE NOT EXISTS (SELECT 1 FROM config_trees c WHERE c.section = 'component' AND c.doc = n.doc
                                AND c.tree = n.tree AND c.component = n.component AND c.key = g.key)),
    everything AS (SELECT * FROM roles UNION ALL
                   SELECT doc, tree, NULL, key, value FROM config_trees WHERE section = 'global')
    SELECT doc, component, key, value, tree FROM everything
    QUALIFY row_number() OVER (PARTITION BY doc, component, key ORDER BY
      CASE tree WHEN 'internal' THEN 1 WHEN 'app_conf' THEN 2 ELSE 3 END) = 1""", recursive=True))
def _(spark, d):
    return config.flatten_trees(v.config_trees(spark, d))


def desired_counts(spark, d, small: bool):
    p = v.table(spark, d, "part")
    p = p.filter(F.col("p_size") <= 25) if small else p.filter(F.col("p_size") > 25)
    return p.groupBy(F.concat_ws("/", "p_brand", "p_type").alias("name")).agg(F.count("*").alias("desired"))


@query("diff_desired", """
    WITH o AS (SELECT p_brand || '/' || p_type AS name, count(*) AS n FROM part WHERE p_size <= 25 GROUP BY 1),
         w AS (SELECT p_brand || '/' || p_type AS name, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1)
    SELECT coalesce(o.name, w.name) AS name, coalesce(o.n, 0) AS old_desired, coalesce(w.n, 0) AS new_desired,
           o.name IS NULL AS is_new
    FROM o FULL JOIN w ON o.name = w.name WHERE o.name IS NULL OR coalesce(o.n, 0) <> coalesce(w.n, 0)""")
def _(spark, d):
    return config.diff_desired(desired_counts(spark, d, True), desired_counts(spark, d, False))


@query("override_audit", with_views("part_keys config resolved", """
    SELECT r.doc, r.component, r.key, r.value, origin, origin = 'component' AND g.value IS NOT NULL AS overrides
    FROM resolved r LEFT JOIN config g ON g.section = 'global' AND g.doc = r.doc AND g.key = r.key"""))
def _(spark, d):
    return config.override_audit(v.config(spark, d))


@query("config_doc_json", with_views("part_keys config", """
    SELECT doc, count(*) FILTER (section = 'component') AS in_components, count(*) FILTER (section = 'global') AS in_global,
           count(*) FILTER (section = 'metadata') AS in_metadata FROM config GROUP BY doc"""))
def _(spark, d):
    """What the lines of every document hold, counted in the JSON text itself."""
    lines = config.config_doc_json(v.config(spark, d), line_entries=300)
    size = lambda *path: F.coalesce(F.size(F.from_json(F.get_json_object("json", "$." + ".".join(path)), "map<string,string>")), F.lit(0))
    inner = F.map_values(F.from_json(F.get_json_object("json", "$.components"), "map<string,map<string,string>>"))
    inside = F.aggregate(F.transform(inner, F.size), F.lit(0), lambda a, x: a + x)
    return lines.groupBy(F.get_json_object("json", "$.doc").alias("doc")).agg(
        F.sum(F.coalesce(inside, F.lit(0))).alias("in_components"), F.sum(size("global")).alias("in_global"),
        F.sum(size("metadata")).alias("in_metadata"))


@query("config_docs_read", with_views("part_keys config", """
    SELECT 'accepted' AS reason, count(DISTINCT doc) AS docs, count(*) AS entries FROM config
    UNION ALL SELECT 'not JSON', count(DISTINCT doc), 0 FROM config
    UNION ALL SELECT 'unsupported version', count(DISTINCT doc), 0 FROM config
    UNION ALL SELECT 'version undefined', count(DISTINCT doc), 0 FROM config"""))
def _(spark, d):
    """Lines of all documents with three spoilt ones for each; every line is read or reported."""
    from fleetlens.sources.config_docs import config_entries, parse_lines, rejected_docs

    names = v.config(spark, d).select("doc").distinct()
    spoilt = names.select(F.explode(F.array(
        F.concat(F.lit('{"doc": "'), "doc", F.lit('", ')), F.concat(F.lit('{"doc": "old'), "doc", F.lit('", "schema": "1"}')),
        F.concat(F.lit('{"doc": "none'), "doc", F.lit('"}')))).alias("value"))
    trees = parse_lines(config.config_doc_json(v.config(spark, d), line_entries=300).select(F.col("json").alias("value")).union(spoilt))
    bad = rejected_docs(trees).groupBy("reason").agg(F.count("*").alias("docs"), F.lit(0).cast("long").alias("entries"))
    good = config_entries(trees).agg(F.lit("accepted").alias("reason"), F.countDistinct("doc").alias("docs"), F.count("*").alias("entries"))
    return good.unionByName(bad)


@query("config_doc_entries", with_views("part_keys config", "SELECT * FROM config"))
def _(spark, d):
    """JSON trees written and read back are the entries again."""
    from fleetlens.sources.config_docs import config_entries, parse_lines

    lines = config.config_doc_json(v.config(spark, d), line_entries=100)
    return config_entries(parse_lines(lines.select(F.col("json").alias("value"))))


@query("config_files_read", with_views("part_keys config", "SELECT section, component, key, value FROM config"))
def _(spark, d):
    """Files with many trees each, one behind the other; all of them are read."""
    from fleetlens.sources.config_docs import read_config_docs

    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/config-{uuid.uuid4()}"
    trees = config.config_doc_json(v.config(spark, d), line_entries=100).select(F.col("json").alias("value"))
    trees.write.option("maxRecordsPerFile", 100).text(folder)
    return read_config_docs(spark, folder).select("section", "component", "key", "value")


# --- snapshots ---------------------------------------------------------------

ENTRY_COLS = ("saved", "saved_ms", "host", "role_id", "active", "last_used")


@query("history_snapshot", with_views("placement", """
    SELECT '000000e8d4a51000' AS saved, 'entry' AS kind, CAST(host AS VARCHAR) AS host, role_id, live > 0 AS active,
           (epoch_us(last_used) // 1000) AS last_used, CAST(NULL AS BIGINT) AS count FROM placement
    UNION ALL SELECT '000000e8d4a51000', 'header', NULL, NULL, NULL, NULL, NULL
    UNION ALL SELECT '000000e8d4a51000', 'footer', NULL, NULL, NULL, NULL, (SELECT count(*) FROM placement)"""))
def _(spark, d):
    cells = v.placement(spark, d).withColumn("last_used", lifecycle.millis(F.col("last_used")))
    return history.history_snapshot(cells, 10**12).select("saved", "kind", "host", "role_id", "active", "last_used", "count")


@query("check_snapshots", with_views("months checked", "SELECT * FROM checked"))
def _(spark, d):
    return history.check_snapshots(v.snapshot_records(spark, d))


@query("latest_valid_snapshot", with_views("months checked entries", """
    SELECT saved, saved_ms, host, role_id, active, last_used FROM entries JOIN checked USING (saved_ms)
    WHERE saved = (SELECT max(saved) FROM checked WHERE valid)"""))
def _(spark, d):
    return history.latest_valid_snapshot(v.snapshot_records(spark, d)).select(*ENTRY_COLS)


@query("latest_saved_snapshot", with_views("months checked entries", """
    SELECT saved, saved_ms, host, role_id, active, last_used FROM entries JOIN checked USING (saved_ms)
    WHERE saved = (SELECT max(saved) FROM checked WHERE valid)"""))
def _(spark, d):
    """The snapshots saved to files; the manifest names the newest, and only its partition is read."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/history-{uuid.uuid4()}"
    history.write_history(v.snapshot_records(spark, d), folder)
    return history.latest_valid_snapshot(history.read_history(spark, folder), history.read_manifest(spark, folder)).select(*ENTRY_COLS)


@query("read_history", with_views("months entries", """
    SELECT printf('%016x', saved_ms) AS saved, 'entry' AS kind, CAST(NULL AS INTEGER) AS version, host, role_id, active, last_used,
           CAST(NULL AS BIGINT) AS count FROM entries
    UNION ALL SELECT printf('%016x', saved_ms), 'header', CASE WHEN n % 7 = 0 THEN 2 ELSE 1 END, NULL, NULL, NULL, NULL, NULL FROM months
    UNION ALL SELECT printf('%016x', saved_ms), CASE WHEN opens % 3 = 0 THEN 'broken' ELSE 'footer' END, NULL, NULL, NULL, NULL, NULL,
                     CASE WHEN opens % 3 <> 0 THEN n - CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END END FROM months"""))
def _(spark, d):
    """Snapshot records as JSON lines, the lost ones cut short, parsed again."""
    kind = F.col("kind")
    name = F.when(kind == "header", "Header").when(kind == "footer", "Footer").otherwise("Entry")
    body = F.struct("version", F.col("saved_ms").alias("saved"), "host", F.col("role_id").alias("role"), "active", "last_used", "count")
    line = F.concat(F.lit('{"entry":'), F.to_json(F.create_map(name, body)), F.lit("}"))
    lines = v.snapshot_records(spark, d).select("saved", F.when(kind == "lost", '{"entry":').otherwise(line).alias("value"))
    return history.parse_records(lines).select("saved", "kind", "version", "host", "role_id", "active", "last_used", "count")


@query("expired_snapshots", with_views("months checked", """
    SELECT saved FROM checked WHERE saved < (SELECT max(saved) FROM checked WHERE valid)"""))
def _(spark, d):
    return history.expired_snapshots(durable(history.check_snapshots(v.snapshot_records(spark, d))))


@query("restore_history", with_views("entries", """
    SELECT role_id, host, CASE WHEN active THEN saved_ms ELSE last_used END AS last_used FROM entries"""))
def _(spark, d):
    return history.restore_history(v.snapshot_records(spark, d).filter(F.col("kind") == "entry"))


# --- heartbeats and agents ---------------------------------------------------

@query("flatten_props", """
    SELECT user_id AS label, event_id AS response_id, (epoch_us(ts) // 1000) AS timestamp, 0 AS position, 'k' AS key,
           CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events""")
def _(spark, d):
    messages = v.table(spark, d, "events").select(
        F.col("user_id").alias("hostname"), F.col("event_id").alias("responseId"),
        lifecycle.millis(F.col("ts")).alias("timestamp"),
        F.map_entries(F.from_json("props", "map<string,bigint>")).alias("reports"))
    return heartbeats.flatten_heartbeats(messages, "reports")


@query("read_heartbeats", """
    SELECT CAST(user_id AS VARCHAR) AS label, event_id AS response_id, position, event_type AS role, event_id + position AS task_id,
           CAST(NULL AS VARCHAR) AS line
    FROM events, (VALUES (0), (1)) AS p(position) WHERE event_id % 10 <> 0
    UNION ALL
    SELECT NULL, NULL, NULL, NULL, NULL, '{"hostname": "' || user_id || '", "responseId": ' FROM events WHERE event_id % 10 = 0""")
def _(spark, d):
    """Messages as JSON text, every tenth cut short, parsed with the full schema; cut lines are reported."""
    e, host = v.table(spark, d, "events"), F.col("user_id").cast("string")
    report = lambda k: F.struct(F.col("event_type").alias("role"), (F.col("event_id") + k).alias("taskId"))
    message = F.to_json(F.struct(host.alias("hostname"), F.col("event_id").alias("responseId"), F.array(report(0), report(1)).alias("reports")))
    cut = F.concat(F.lit('{"hostname": "'), host, F.lit('", "responseId": '))
    messages = heartbeats.parse_messages(e.select(F.when(F.col("event_id") % 10 == 0, cut).otherwise(message).alias("value")))
    rows = heartbeats.flatten_heartbeats(messages, "reports").select(
        "label", "response_id", "position", "role", F.col("taskId").alias("task_id"), F.lit(None).cast("string").alias("line"))
    return rows.unionByName(heartbeats.rejected_messages(messages), allowMissingColumns=True)


@query("check_registrations", with_views("lifecycle", """
    SELECT label, container_id, role, CASE WHEN known IS NULL THEN 'FAILED' ELSE 'OK' END AS status,
           CASE WHEN known IS NULL THEN 'Label not recognized.' END AS log
    FROM (SELECT container_id || '___' || role_id AS label, container_id, CAST(role_id AS VARCHAR) AS role
          FROM lifecycle WHERE event = 'STARTED')
    LEFT JOIN (SELECT DISTINCT container_id || '___' || role_id AS label, TRUE AS known
               FROM lifecycle WHERE event = 'ALLOCATED') USING (label)"""))
def _(spark, d):
    e = v.lifecycle(spark, d).withColumn("label", F.concat("container_id", F.lit("___"), v.text("role_id")))
    return agents.check_registrations(
        e.filter(F.col("event") == "STARTED").select("label"), e.filter(F.col("event") == "ALLOCATED").select("label"))


@query("sequence_breaks", with_views("heartbeat", """
    SELECT label, seq, response_id, previous_id
    FROM (SELECT *, lag(response_id) OVER (PARTITION BY label ORDER BY seq) AS previous_id FROM heartbeat)
    WHERE response_id <> previous_id + 1"""))
def _(spark, d):
    return agents.sequence_breaks(v.heartbeat(spark, d))


def streamed(df: DataFrame, stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Result of a stream over the rows of ``df``, all of them read and then stopped; lies in the checkpoint folder."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4()}"
    df.write.parquet(f"{folder}/in")
    streams.use_rocksdb(spark)
    out = stream(spark.readStream.schema(df.schema).parquet(f"{folder}/in"))
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


# the last hour stays behind the watermark, which goes by whole slots
@query("sequence_breaks_stream", with_views("heartbeat", f"""
    t AS (SELECT *, epoch_us(ts) // 1000 AS at_ms FROM heartbeat),
    passed AS (SELECT * FROM t WHERE at_ms < (SELECT (max(at_ms) - 3600000) // {3600000 // streams.SLOTS} * {3600000 // streams.SLOTS} FROM t))
    SELECT CAST(label AS VARCHAR) AS label, seq, response_id, previous_id
    FROM (SELECT *, lag(response_id) OVER (PARTITION BY label ORDER BY seq) AS previous_id FROM passed)
    WHERE response_id <> previous_id + 1""", recursive=True))
def _(spark, d):
    beats = v.heartbeat(spark, d).select(F.col("label").cast("string").alias("label"), "seq", "ts", "response_id")
    return streamed(beats, lambda df: streams.stream_sequence_breaks(df, delay="1 hour", retention_ms=None))


COMPONENT_SQL = """
    n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq) AS i FROM reports),
    walk AS (
      SELECT DISTINCT label, CAST(0 AS BIGINT) AS i, 'INIT' AS state, 0 AS failures, CAST(0 AS BIGINT) AS illegal,
             CAST(NULL AS BIGINT) AS last_seq FROM reports
      UNION ALL
      SELECT w.label, n.i,
        CASE WHEN n.kind = 'issue' AND w.failures < 3 AND n.command = 'INSTALL' AND w.state IN ('INIT', 'INSTALL_FAILED') THEN 'INSTALLING'
             WHEN n.kind = 'issue' AND w.failures < 3 AND n.command = 'START' AND w.state = 'INSTALLED' THEN 'STARTING'
             WHEN n.result = 'COMPLETED' AND w.state = 'INSTALLING' THEN 'INSTALLED'
             WHEN n.result = 'COMPLETED' AND w.state = 'STARTING' THEN 'STARTED'
             WHEN n.result = 'FAILED' AND w.state = 'INSTALLING' THEN 'INSTALL_FAILED'
             WHEN n.result = 'FAILED' AND w.state = 'STARTING' THEN 'INSTALLED' ELSE w.state END,
        CASE WHEN n.result = 'COMPLETED' AND w.state IN ('INSTALLING', 'STARTING') THEN 0
             WHEN n.result = 'FAILED' AND w.state IN ('INSTALLING', 'STARTING') THEN w.failures + 1 ELSE w.failures END,
        w.illegal + CASE
             WHEN n.kind = 'issue' AND w.failures < 3 AND n.command = 'INSTALL' AND w.state IN ('INIT', 'INSTALL_FAILED') THEN 0
             WHEN n.kind = 'issue' AND w.failures < 3 AND n.command = 'START' AND w.state = 'INSTALLED' THEN 0
             WHEN n.kind = 'issue' AND n.command = 'NOP'
                  AND NOT (w.failures < 3 AND w.state IN ('INIT', 'INSTALL_FAILED', 'INSTALLED')) THEN 0
             WHEN n.kind = 'result' AND w.state IN ('INSTALLING', 'STARTING') THEN 0 ELSE 1 END,
        n.seq
      FROM walk w JOIN n ON n.label = w.label AND n.i = w.i + 1),
    final AS (SELECT label, state, failures, illegal, i AS reports, last_seq FROM walk
              QUALIFY row_number() OVER (PARTITION BY label ORDER BY i DESC) = 1)"""


@query("component_state", with_views("reports", COMPONENT_SQL + " SELECT * FROM final", recursive=True))
def _(spark, d):
    return agents.component_state(v.reports(spark, d))


@query("next_command", with_views("reports", COMPONENT_SQL + """
    SELECT label, state, failures,
           CASE WHEN reports < 3 OR failures >= 3 THEN 'NOP' WHEN state IN ('INIT', 'INSTALL_FAILED') THEN 'INSTALL'
                WHEN state = 'INSTALLED' THEN 'START' ELSE 'NOP' END AS command
    FROM final""", recursive=True))
def _(spark, d):
    states = agents.component_state(v.reports(spark, d))
    seen = v.reports(spark, d).groupBy("label").agg(F.count("*").alias("response_id"))
    return agents.next_command(states, seen, wait_for=3)


LATEST = """
    SELECT * FROM task_reports QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) = 1"""


@query("latest_task_status", with_views("task_reports", LATEST))
def _(spark, d):
    return agents.latest_task_status(v.task_reports(spark, d))


@query("drain_reports", with_views("task_reports", f"""
    SELECT task_id, CASE command_type WHEN 'STATUS' THEN 'componentStatus' ELSE 'reports' END AS part, status,
           CASE WHEN status = 'IN_PROGRESS' THEN 777 ELSE exit_code END AS exit_code, stdout,
           status <> 'IN_PROGRESS' AS forgotten
    FROM ({LATEST})"""))
def _(spark, d):
    return agents.drain_reports(v.task_reports(spark, d))


@query("report_status", with_views("task_reports", """
    SELECT task_id, seq, CASE exit_code WHEN 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status,
           CASE stdout WHEN '' THEN 'None' ELSE stdout END AS stdout, 'None' AS stderr
    FROM task_reports"""))
def _(spark, d):
    results = v.task_reports(spark, d).withColumn("stderr", F.lit(""))
    return agents.report_status(results).select("task_id", "seq", "status", "stdout", "stderr")


@query("mount_like_lines", with_views("clean log", r"""
    SELECT doc_id, line_no, parts[1] AS device, parts[7] AS mountpoint
    FROM (SELECT doc_id, line_no, regexp_split_to_array(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[ \t\n\x0b\f\r]+') AS parts
          FROM log) WHERE len(parts) = 7"""))
def _(spark, d):
    return agents.mount_like_lines(logs.log_lines(v.table(spark, d, "documents")))


@query("mount_inventory", with_views("clean", r"""
    lines AS (SELECT doc_id AS host, regexp_split_to_array(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[ \t\n\x0b\f\r]+') AS p
              FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
    SELECT host, p[1] AS device, p[2] AS type, TRY_CAST(p[3] AS BIGINT) AS size, TRY_CAST(p[4] AS BIGINT) AS used,
           TRY_CAST(p[5] AS BIGINT) AS available, p[6] AS percent, p[7] AS mountpoint
    FROM lines WHERE len(p) = 7""", recursive=True))
def _(spark, d):
    raw = v.table(spark, d, "documents").select(
        F.col("doc_id").alias("host"), F.col("n_chars").alias("ts"), F.col("text").alias("output"))
    return agents.mount_inventory(raw)


@query("host_facts", r"""
    SELECT page_id AS host, regexp_extract(url, 'http://([^/]+)/', 1) AS domain,
           regexp_extract(url, '/([a-z]{2})/', 1) AS lang, regexp_extract(url, 'page=([0-9]+)', 1) AS page,
           array_to_string(regexp_extract_all(url, '[?&]([a-z]+)=', 1), ',') AS params
    FROM pages""")
def _(spark, d):
    raw = v.table(spark, d, "pages").select(F.col("page_id").alias("host"), F.col("url").alias("output"))
    return agents.host_facts(
        raw, {"domain": "http://([^/]+)/", "lang": "/([a-z]{2})/", "page": "page=([0-9]+)"}, {"params": "[?&]([a-z]+)="})


@query("live_status", """
    WITH c AS (SELECT c_custkey AS host, c_mktsegment AS service, 'comp-' || c_nationkey AS component,
                      CASE WHEN c_acctbal < 0 THEN 'UNKNOWN' END AS forced FROM customer),
         k AS (SELECT DISTINCT c_mktsegment AS service, 'comp-' || c_nationkey AS component, n_regionkey = 0 AS is_client
               FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 4),
         p AS (SELECT o_custkey AS host, 'comp-' || c_nationkey AS component, bool_or(o_orderstatus = 'O') AS alive
               FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT host, service, component,
           CASE WHEN forced IS NOT NULL THEN forced WHEN is_client THEN 'INSTALLED' WHEN is_client IS NULL THEN NULL
                WHEN coalesce(alive, FALSE) THEN 'STARTED' ELSE 'INSTALLED' END AS status
    FROM c LEFT JOIN k USING (service, component) LEFT JOIN p USING (host, component)""")
def _(spark, d):
    customer, nation = v.table(spark, d, "customer"), v.table(spark, d, "nation")
    name = F.concat(F.lit("comp-"), v.text("c_nationkey")).alias("component")
    service = F.col("c_mktsegment").alias("service")
    components = customer.select(F.col("c_custkey").alias("host"), service, name,
                                 F.when(F.col("c_acctbal") < 0, "UNKNOWN").alias("forced"))
    kinds = customer.join(nation.filter("n_regionkey <> 4"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        service, name, (F.col("n_regionkey") == 0).alias("is_client")).distinct()
    processes = v.table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("host"), name, (F.col("o_orderstatus") == "O").alias("alive"))
    return agents.live_status(components, kinds, processes)


# --- health ------------------------------------------------------------------

def labelled(spark, d):
    return health.label_phases(v.probes(spark, d), BOOT_MS)


@query("probe_phase", with_views(PROBE, """
    SELECT service, arg_max(phase, seq) AS phase, min(ts) FILTER (phase = 'BOOTSTRAPPING') AS bootstrapping_ts,
           min(ts) FILTER (phase = 'LIVE') AS live_ts, min(ts) FILTER (phase = 'TERMINATING') AS terminating_ts
    FROM labelled GROUP BY service"""))
def _(spark, d):
    return health.probe_phase(v.probes(spark, d), BOOT_MS)


@query("label_phases", with_views(PROBE, "SELECT service, probe, seq, phase, booted FROM labelled"))
def _(spark, d):
    return labelled(spark, d).select("service", "probe", "seq", "phase", "booted")


@query("reported_outcome", with_views(PROBE + " told", "SELECT * FROM told"))
def _(spark, d):
    return health.reported_outcome(labelled(spark, d))


@query("silence_alerts", with_views("statuses", """
    SELECT key, seq, ts, phase, silence_ms
    FROM (SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY key ORDER BY seq)) // 1000) - (epoch_us(ts) // 1000) AS silence_ms FROM statuses)
    WHERE silence_ms >= CASE phase WHEN 'LIVE' THEN 14400000 WHEN 'BOOTSTRAPPING' THEN 28800000 END"""))
def _(spark, d):
    return health.silence_alerts(v.statuses(spark, d), 14_400_000, 28_800_000)


@query("bootstrap_timeout", with_views("probes cycles passed booted", f"""
    late AS (SELECT b.service, count(*) AS missing FROM booted b JOIN passed p USING (service)
             WHERE p.boot_start_ts IS NOT NULL
               AND (booted_ts IS NULL OR (epoch_us(booted_ts) // 1000) > (epoch_us(boot_start_ts) // 1000) + {BOOT_MS}) GROUP BY b.service),
    bad AS (SELECT service, arg_max(probe, seq) AS last_probe, arg_max(message, seq) AS last_message
            FROM probes JOIN passed USING (service)
            WHERE kind = 'monitor' AND NOT success AND cycle > dep_done
              AND (epoch_us(ts) // 1000) <= (epoch_us(boot_start_ts) // 1000) + {BOOT_MS} GROUP BY service)
    SELECT service, missing, last_probe, last_message FROM late LEFT JOIN bad USING (service)""", recursive=True))
def _(spark, d):
    return health.bootstrap_timeout(v.probes(spark, d), BOOT_MS)


COUNTS = """
    SELECT service, probe, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) FILTER (success) AS successes,
           count(*) FILTER (NOT success) AS failures FROM probes GROUP BY ALL"""


@query("probe_counts", with_views("probes", COUNTS))
def _(spark, d):
    return health.probe_counts(v.probes(spark, d), "1 day")


@query("probe_totals", with_views("probes", f"""
    SELECT service, probe, window_start, CAST(sum(successes) OVER w AS BIGINT) AS successes,
           CAST(sum(failures) OVER w AS BIGINT) AS failures
    FROM ({COUNTS}) WINDOW w AS (PARTITION BY service, probe ORDER BY window_start)"""))
def _(spark, d):
    return health.probe_totals(health.probe_counts(v.probes(spark, d), "1 day"))


@query("http_outcome", """
    SELECT event_id, CAST(100 + floor(value * 10) AS BIGINT) AS code, 100 + floor(value * 10) BETWEEN 200 AND 299 AS success
    FROM events""")
def _(spark, d):
    accesses = v.table(spark, d, "events").select(
        "event_id", (F.floor(F.col("value") * 10) + 100).alias("code"))
    return health.http_outcome(accesses)


@query("health_log_line", with_views(PROBE + " told", """
    SELECT service, probe, seq, 'Probe Status, time="' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '", phase="' || phase
           || '", outcome="' || CASE WHEN success THEN 'success' ELSE 'failure' END || '"'
           || CASE WHEN success <> real_outcome THEN ', originaloutcome="'
                   || CASE WHEN real_outcome THEN 'success' ELSE 'failure' END || '"' ELSE '' END
           || ', message="' || message || '"' AS line
    FROM told"""))
def _(spark, d):
    return health.health_log_line(health.reported_outcome(labelled(spark, d)))


# --- log text ----------------------------------------------------------------

@query("log_lines", with_views("clean log", "SELECT * FROM log"))
def _(spark, d):
    return logs.log_lines(v.table(spark, d, "documents"))


STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("grep_context", with_views("clean", f"""
    p AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM clean),
    h AS (SELECT *, list_position(list_transform(lines, lambda x: contains(lower(x), 'que')), TRUE) AS hit FROM p)
    SELECT doc_id, CASE WHEN hit IS NOT NULL AND hit > 0
        THEN trim(array_to_string(lines[greatest(hit - 3, 1):hit + 3], chr(10)), {STRIP}) END AS fragment
    FROM h""", recursive=True))
def _(spark, d):
    return logs.grep_context(v.table(spark, d, "documents"), "QUE", 3, 3)


@query("tail_lines", with_views("clean", """
    SELECT doc_id, array_to_string(parts[greatest(len(parts) - 3 + 1, 1):], chr(10)) AS tail
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM clean)"""))
def _(spark, d):
    return logs.tail_lines(v.table(spark, d, "documents"), 3)


@query("drop_lines", with_views("clean", f"""
    SELECT doc_id, trim(coalesce(array_to_string(list_filter(string_split(text, chr(10)),
                   lambda x: NOT contains(lower(x), 'the')), chr(10)), ''), {STRIP}) AS text FROM clean"""))
def _(spark, d):
    return logs.drop_lines(v.table(spark, d, "documents"), "The")


@query("strip_markup", r"""
    SELECT doc_id, regexp_replace(text, '\x1b\[[\d;]{1,4}m', '', 'g') AS text FROM documents""")
def _(spark, d):
    return logs.strip_markup(v.table(spark, d, "documents"))
