"""Telemetry views over the star-schema tables, each written for Spark and in SQL.

The Spark form is what the registered queries read; the SQL form is the start of their
oracle. Both use the same keys and tie-breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.ordered import rank_in_group


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- life cycle, from events -------------------------------------------------

def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind, value = F.col("event_type"), F.col("value")
    exit_code = (F.floor("value") % 3).cast("int")
    return e.select(
        F.concat(text("user_id"), F.lit("#"), text(F.to_date("ts"))).alias("container_id"),
        (F.col("user_id") % 5).cast("int").alias("role_id"), (F.col("user_id") % 20).alias("host"),
        F.when((kind == "signup") & (value < 4), "SURPLUS").when(kind == "signup", "ALLOCATED")
        .when((kind == "view") & (value < 4), "START_FAILED").when(kind == "view", "STARTED")
        .when(kind == "purchase", "RELEASED").when(kind == "error", "COMPLETED")
        .otherwise("HEARTBEAT").alias("event"),
        "ts", F.col("event_id").alias("seq"), exit_code.alias("exit_code"),
        F.concat(F.lit("exit "), text(exit_code)).alias("diagnostics"))


def lifecycle_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role definitions for the life-cycle view: desired and requested per role."""
    return lifecycle(spark, sf_dir).groupBy("role_id").agg(
        F.concat(F.lit("role-"), text("role_id")).alias("name"),
        F.count_if(F.col("event") == "STARTED").alias("desired"),
        F.count_if(F.col("event").isin("ALLOCATED", "COMPLETED")).alias("requested"))


LIFECYCLE = {
    "lifecycle": """
      SELECT user_id || '#' || strftime(ts, '%Y-%m-%d') AS container_id, CAST(user_id % 5 AS INTEGER) AS role_id,
             user_id % 20 AS host,
             CASE WHEN event_type = 'signup' AND value < 4 THEN 'SURPLUS' WHEN event_type = 'signup' THEN 'ALLOCATED'
                  WHEN event_type = 'view' AND value < 4 THEN 'START_FAILED' WHEN event_type = 'view' THEN 'STARTED'
                  WHEN event_type = 'purchase' THEN 'RELEASED' WHEN event_type = 'error' THEN 'COMPLETED'
                  ELSE 'HEARTBEAT' END AS event,
             ts, event_id AS seq, CAST(floor(value) AS INTEGER) % 3 AS exit_code,
             'exit ' || (CAST(floor(value) AS INTEGER) % 3) AS diagnostics
      FROM events""",
    "lifecycle_roles": """
      SELECT role_id, 'role-' || role_id AS name, count(*) FILTER (event = 'STARTED') AS desired,
             count(*) FILTER (event IN ('ALLOCATED', 'COMPLETED')) AS requested
      FROM lifecycle GROUP BY role_id""",
    "opened": """
      SELECT container_id, min(seq) FILTER (event = 'ALLOCATED') AS a, min(seq) FILTER (event = 'SURPLUS') AS u
      FROM lifecycle GROUP BY container_id""",
    "firsts": """
      SELECT container_id, a, u, arg_min(role_id, seq) AS role_id, arg_min(host, seq) AS host,
             min(seq) FILTER (event = 'STARTED' AND seq > a) AS s0,
             min(seq) FILTER (event = 'START_FAILED' AND seq > a) AS f0,
             min(seq) FILTER (event = 'RELEASED' AND seq > a) AS r0,
             min(seq) FILTER (event = 'COMPLETED' AND (seq > a OR seq > u)) AS e
      FROM lifecycle JOIN opened USING (container_id) WHERE event <> 'HEARTBEAT' GROUP BY container_id, a, u""",
    "steps": """
      SELECT *, CASE WHEN s0 < coalesce(e, 1e18) AND f IS NULL THEN s0 END AS s,
             CASE WHEN r0 < coalesce(e, 1e18) AND r0 < coalesce(f, 1e18) THEN r0 END AS r
      FROM (SELECT *, CASE WHEN f0 < coalesce(s0, 1e18) AND f0 < coalesce(e, 1e18) THEN f0 END AS f FROM firsts)""",
    "summary": """
      SELECT k.*, ca.ts AS create_ts, cs.ts AS start_ts, ce.ts AS end_ts, ce.exit_code, ce.diagnostics,
             cf.diagnostics AS start_diagnostics,
             CASE WHEN e IS NULL THEN NULL WHEN r IS NOT NULL THEN 'released' WHEN u < e THEN 'surplus'
                  ELSE 'failed' END AS outcome
      FROM steps k LEFT JOIN lifecycle ca ON ca.seq = k.a LEFT JOIN lifecycle cs ON cs.seq = k.s
      LEFT JOIN lifecycle ce ON ce.seq = k.e LEFT JOIN lifecycle cf ON cf.seq = k.f""",
    "kinds": """
      SELECT l.*, c.a, c.u, c.s, c.f, c.r, c.e, c.start_ts,
             CASE WHEN l.event <> 'COMPLETED' THEN NULL WHEN l.seq = c.e THEN c.outcome
                  WHEN l.seq > c.e AND (c.outcome = 'failed' OR c.f IS NOT NULL) THEN 'failed'
                  ELSE 'unknown' END AS kind,
             (epoch_us(l.ts) // 1000) - (epoch_us(c.start_ts) // 1000) AS lived
      FROM lifecycle l JOIN summary c USING (container_id) WHERE l.event <> 'HEARTBEAT'""",
    "transitions": """
      SELECT *, CASE event
        WHEN 'ALLOCATED' THEN CASE WHEN seq = a THEN 'ASSIGNED' ELSE 'IGNORED' END
        WHEN 'SURPLUS' THEN CASE WHEN seq = u THEN 'SURPLUS' ELSE 'IGNORED' END
        WHEN 'STARTED' THEN CASE WHEN seq = s THEN 'STARTED' ELSE 'START_ERROR' END
        WHEN 'START_FAILED' THEN CASE WHEN seq = f THEN 'START_FAILED' ELSE 'IGNORED' END
        WHEN 'RELEASED' THEN CASE WHEN seq = r THEN 'RELEASING' ELSE 'RELEASE_ERROR' END
        ELSE CASE kind WHEN 'released' THEN 'RELEASED' WHEN 'surplus' THEN 'SURPLUS_ENDED'
             WHEN 'failed' THEN CASE WHEN start_ts IS NULL OR lived < {short} THEN 'FAILED_SHORT' ELSE 'FAILED' END
             ELSE 'UNKNOWN' END END AS effect
      FROM kinds""",
}
SHORT_MS = 6 * 3600 * 1000
LIFECYCLE["transitions"] = LIFECYCLE["transitions"].replace("{short}", str(SHORT_MS))


# --- heartbeats, reports and probes, from events -----------------------------

def heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered heartbeats per label; the ones sent during an error never arrive."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("label"), F.col("event_id").alias("seq"), "ts", "event_type", "props")
    return rank_in_group(e, ["label"], [F.col("seq").asc()], "response_id").filter(F.col("event_type") != "error")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.concat(text("user_id"), F.lit("___"), text(F.to_date("ts"))).alias("label"),
        F.col("event_id").alias("seq"), F.when(kind.isin("signup", "purchase"), "issue").otherwise("result").alias("kind"),
        F.when(kind == "signup", "INSTALL").when((kind == "purchase") & (F.col("event_id") % 5 == 0), "NOP")
        .when(kind == "purchase", "START").alias("command"),
        F.when(kind == "view", "COMPLETED").when(kind == "click", "IN_PROGRESS").when(kind == "error", "FAILED").alias("result"))


def task_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        (F.col("user_id") * 31 + F.dayofmonth("ts")).alias("task_id"), F.col("event_id").alias("seq"),
        F.when(kind == "signup", "STATUS").otherwise("EXECUTION").alias("command_type"),
        F.when(kind.isin("view", "signup"), "COMPLETED").when(kind == "error", "FAILED").otherwise("IN_PROGRESS").alias("status"),
        (F.floor("value") % 3).cast("int").alias("exit_code"),
        F.when(kind == "purchase", "").otherwise(F.regexp_replace("props", " ", "\n")).alias("stdout"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe results: ten services, hourly cycles, the first probes are dependencies."""
    e = table(spark, sf_dir, "events")
    probe = F.floor(F.col("user_id") / 10)
    return e.select(
        (F.col("user_id") % 10).alias("service"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("cycle"),
        F.col("event_id").alias("seq"), "ts", probe.alias("probe"),
        F.when(probe < 3, "dependency").otherwise("monitor").alias("kind"),
        (F.col("event_type") != "error").alias("success"), F.col("props").alias("message"))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "ts",
        F.when(kind == "signup", "DEPENDENCY_CHECKING").when(kind == "purchase", "BOOTSTRAPPING")
        .otherwise("LIVE").alias("phase"))


BOOT_MS = 12 * 3600 * 1000
EVENT_VIEWS = {
    "heartbeat": """
      SELECT * FROM (SELECT user_id AS label, event_id AS seq, ts, event_type, props,
                            row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS response_id FROM events)
      WHERE event_type <> 'error'""",
    "reports": """
      SELECT user_id || '___' || strftime(ts, '%Y-%m-%d') AS label, event_id AS seq,
             CASE WHEN event_type IN ('signup', 'purchase') THEN 'issue' ELSE 'result' END AS kind,
             CASE WHEN event_type = 'signup' THEN 'INSTALL' WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'NOP'
                  WHEN event_type = 'purchase' THEN 'START' END AS command,
             CASE event_type WHEN 'view' THEN 'COMPLETED' WHEN 'click' THEN 'IN_PROGRESS' WHEN 'error' THEN 'FAILED' END AS result
      FROM events""",
    "task_reports": """
      SELECT user_id * 31 + day(ts) AS task_id, event_id AS seq,
             CASE event_type WHEN 'signup' THEN 'STATUS' ELSE 'EXECUTION' END AS command_type,
             CASE WHEN event_type IN ('view', 'signup') THEN 'COMPLETED' WHEN event_type = 'error' THEN 'FAILED'
                  ELSE 'IN_PROGRESS' END AS status,
             CAST(floor(value) AS INTEGER) % 3 AS exit_code,
             CASE event_type WHEN 'purchase' THEN '' ELSE replace(props, ' ', chr(10)) END AS stdout
      FROM events""",
    "probes": """
      SELECT user_id % 10 AS service, (epoch_us(ts) // 1000) // 3600000 AS cycle, event_id AS seq, ts, user_id // 10 AS probe,
             CASE WHEN user_id // 10 < 3 THEN 'dependency' ELSE 'monitor' END AS kind,
             event_type <> 'error' AS success, props AS message
      FROM events""",
    "statuses": """
      SELECT user_id AS key, event_id AS seq, ts,
             CASE event_type WHEN 'signup' THEN 'DEPENDENCY_CHECKING' WHEN 'purchase' THEN 'BOOTSTRAPPING'
                  ELSE 'LIVE' END AS phase
      FROM events""",
    "cycles": """
      SELECT service, cycle, min(seq) AS first_seq, arg_min(ts, seq) AS start_ts, arg_max(ts, seq) AS end_ts,
             count(*) FILTER (kind = 'dependency') AS deps, count(*) FILTER (kind = 'dependency' AND NOT success) AS dep_failed,
             count(*) FILTER (kind = 'monitor') AS mons, count(*) FILTER (kind = 'monitor' AND NOT success) AS mon_failed
      FROM probes GROUP BY service, cycle""",
    "passed": """
      SELECT service, min(cycle) FILTER (deps > 0 AND dep_failed = 0) AS dep_done,
             arg_min(end_ts, cycle) FILTER (deps > 0 AND dep_failed = 0) AS boot_start_ts
      FROM cycles GROUP BY service""",
    "marks": f"""
      SELECT *, CASE WHEN late <= coalesce(boot_done0, 1e18) THEN NULL ELSE boot_done0 END AS boot_done,
             CASE WHEN late <= coalesce(boot_done0, 1e18) THEN late_seq END AS timeout_seq
      FROM (SELECT service, dep_done, boot_start_ts,
                   min(cycle) FILTER (cycle > dep_done AND mons > 0 AND mon_failed = 0) AS boot_done0,
                   min(cycle) FILTER (cycle > dep_done AND (epoch_us(start_ts) // 1000) > (epoch_us(boot_start_ts) // 1000) + {BOOT_MS}) AS late,
                   min(first_seq) FILTER (cycle > dep_done AND (epoch_us(start_ts) // 1000) > (epoch_us(boot_start_ts) // 1000) + {BOOT_MS}) AS late_seq
            FROM cycles JOIN passed USING (service) GROUP BY service, dep_done, boot_start_ts)""",
    "booted": """
      SELECT service, probe, min(seq) FILTER (success AND cycle > dep_done) AS booted_seq,
             min(ts) FILTER (success AND cycle > dep_done) AS booted_ts
      FROM probes JOIN passed USING (service) WHERE kind = 'monitor' GROUP BY service, probe""",
    "phased": """
      SELECT p.*, m.dep_done, m.boot_done, m.timeout_seq, coalesce(b.booted_seq < p.seq, FALSE) AS booted,
             coalesce(p.cycle > m.dep_done AND (m.boot_done IS NULL OR p.cycle <= m.boot_done), FALSE) AS in_boot,
             coalesce(p.cycle > m.boot_done, FALSE) AS is_live
      FROM probes p JOIN marks m USING (service) LEFT JOIN booted b ON b.service = p.service AND b.probe = p.probe""",
    "fatal": """
      SELECT service, min(seq) AS fatal_seq FROM phased
      WHERE kind = 'monitor' AND NOT success AND ((in_boot AND booted) OR is_live) GROUP BY service""",
    "labelled": """
      SELECT p.*, CASE WHEN p.seq > f.fatal_seq OR p.seq >= p.timeout_seq THEN 'TERMINATING' WHEN is_live THEN 'LIVE'
                       WHEN in_boot THEN 'BOOTSTRAPPING' ELSE 'DEPENDENCY_CHECKING' END AS phase
      FROM phased p LEFT JOIN fatal f USING (service)""",
    "told": """
      SELECT service, probe, seq, ts, phase, message, success AS real_outcome,
             success OR phase = 'DEPENDENCY_CHECKING' OR (phase = 'BOOTSTRAPPING' AND NOT booted) AS success
      FROM labelled
      WHERE (phase = 'DEPENDENCY_CHECKING' AND kind = 'dependency')
         OR (phase IN ('BOOTSTRAPPING', 'LIVE') AND kind = 'monitor')""",
}


# --- placement, roles, requests and offers, from lineitem and orders ---------

def placement(spark: SparkSession, sf_dir: str, host: str = "l_partkey") -> DataFrame:
    """One cell per (line number, part): host is the part, role is the line number."""
    up, back, few = F.col("l_linestatus") == "O", F.col("l_returnflag"), F.col("l_quantity") <= 3
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_linenumber").alias("role_id"), F.col(host).alias("host")).agg(
        F.count_if(up).alias("live"), F.count_if(up & (back == "R")).alias("releasing"),
        F.count_if(~up & (back == "N") & few).alias("requested"), F.count_if(~up & (back == "A") & few).alias("starting"),
        F.max("l_shipdate").alias("last_used"))


def roles(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None) -> DataFrame:
    """Odd roles are short of instances, even ones have too many."""
    sums = (placement(spark, sf_dir) if cells is None else cells).groupBy("role_id").agg(
        F.sum("live").alias("actual"), F.sum("releasing").alias("releasing"), F.sum("requested").alias("requested"))
    role = F.col("role_id")
    return sums.select(
        "role_id", F.concat(F.lit("role-"), text("role_id")).alias("name"),
        F.when(role % 2 == 0, F.floor(F.col("actual") / 2)).otherwise(
            F.col("actual") + F.col("requested") + 50 * role).cast("long").alias("desired"),
        "actual", "requested", "releasing",
        F.when(role == 7, 1).when(role == 3, 2).otherwise(0).alias("policy"))


def container_key() -> Column:
    return F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    urgent = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_orderdate")
    return lines.join(urgent, lines.l_orderkey == urgent.o_orderkey).select(
        F.col("l_linenumber").alias("role_id"),
        F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("host"),
        F.col("l_orderkey").alias("request_id"), F.col("o_orderdate").alias("requested_at"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "N").select(
        container_key().alias("container_id"), F.col("l_linenumber").alias("role_id"),
        F.col("l_partkey").alias("host")).distinct()


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == "O").groupBy(
        container_key().alias("container_id"), F.col("l_linenumber").alias("role_id"),
        F.col("l_partkey").alias("host")).agg(F.max(F.col("l_returnflag") == "R").alias("releasing"))


def demand(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None) -> DataFrame:
    return roles(spark, sf_dir, cells).select("role_id", (F.col("role_id") * 40).cast("long").alias("k"), "policy")


PLACEMENT = {
    "placement": """
      SELECT l_linenumber AS role_id, l_partkey AS host, count(*) FILTER (l_linestatus = 'O') AS live,
             count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'R') AS releasing,
             count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'N' AND l_quantity <= 3) AS requested,
             count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'A' AND l_quantity <= 3) AS starting,
             max(l_shipdate) AS last_used
      FROM lineitem GROUP BY l_linenumber, l_partkey""",
    "roles": """
      SELECT role_id, 'role-' || role_id AS name,
             CASE WHEN role_id % 2 = 0 THEN actual // 2 ELSE actual + requested + 50 * role_id END AS desired,
             actual, requested, releasing, CASE role_id WHEN 7 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS policy
      FROM (SELECT role_id, CAST(sum(live) AS BIGINT) AS actual, CAST(sum(releasing) AS BIGINT) AS releasing,
                   CAST(sum(requested) AS BIGINT) AS requested FROM placement GROUP BY role_id)""",
    "requests": """
      SELECT l_linenumber AS role_id, CASE WHEN l_returnflag <> 'R' THEN l_partkey END AS host,
             l_orderkey AS request_id, o_orderdate AS requested_at
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'""",
    "offers": """
      SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS container_id,
             l_linenumber AS role_id, l_partkey AS host
      FROM lineitem WHERE l_returnflag = 'N'""",
    "containers": """
      SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS container_id,
             l_linenumber AS role_id, l_partkey AS host, bool_or(l_returnflag = 'R') AS releasing
      FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL""",
    "demand": "SELECT role_id, CAST(role_id * 40 AS BIGINT) AS k, policy FROM roles",
    "free": "SELECT * FROM placement WHERE live = releasing AND requested = 0 AND starting = 0",
    "located": """
      SELECT role_id, host, max(request_id) AS request_id, arg_max(requested_at, request_id) AS requested_at
      FROM requests WHERE host IS NOT NULL GROUP BY role_id, host""",
    "copies": """
      SELECT role_id, host, live - releasing AS active, i AS copy,
             CASE WHEN i < live - releasing THEN 0 WHEN live - releasing = 1 THEN 1 ELSE 2 END AS phase
      FROM (SELECT *, unnest(range(1, live - releasing + 1)) AS i FROM placement WHERE live > releasing)""",
    "chosen": """
      SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY phase, active DESC, host, copy) AS rank FROM copies""",
}


# --- application registry, from orders and lineitem --------------------------

def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.col("o_orderstatus")
    done = state == "F"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("app_id"), F.col("o_orderpriority").alias("type"),
        (F.col("o_custkey") % 20).alias("user"),
        F.concat(F.lit("app-"), text(F.col("o_orderkey") % 300)).alias("name"),
        F.when(state == "P", "ACCEPTED").when(state == "O", "RUNNING").otherwise("FINISHED").alias("state"),
        F.col("o_orderdate").alias("start_ts"),
        F.when(done, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("finish_ts"),
        F.concat(F.lit("http://rm/"), text("o_orderkey")).alias("url"),
        F.concat(F.lit("h"), text("o_custkey")).alias("rpc_host"),
        (F.col("o_custkey") % 1000 + 1024).alias("rpc_port"),
        F.when(done, "ended").otherwise("").alias("diagnostics"))


def app_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("app_id"),
        F.when(flag == "N", "ACCEPTED").when(flag == "R", "RUNNING").otherwise("FINISHED").alias("state"),
        F.col("l_shipdate").alias("ts"))


def node_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each host says it runs, one small list per report."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("host"), F.array(F.struct(
            F.col("l_orderkey").alias("app_id"), container_key().alias("container_id"))).alias("containers"))


REGISTRY = {
    "registry": """
      SELECT o_orderkey AS app_id, o_orderpriority AS type, o_custkey % 20 AS "user", 'app-' || (o_orderkey % 300) AS name,
             CASE o_orderstatus WHEN 'P' THEN 'ACCEPTED' WHEN 'O' THEN 'RUNNING' ELSE 'FINISHED' END AS state,
             o_orderdate AS start_ts, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS finish_ts,
             'http://rm/' || o_orderkey AS url, 'h' || o_custkey AS rpc_host, o_custkey % 1000 + 1024 AS rpc_port,
             CASE WHEN o_orderstatus = 'F' THEN 'ended' ELSE '' END AS diagnostics
      FROM orders""",
    "app_history": """
      SELECT l_orderkey AS app_id, CASE l_returnflag WHEN 'N' THEN 'ACCEPTED' WHEN 'R' THEN 'RUNNING'
             ELSE 'FINISHED' END AS state, l_shipdate AS ts FROM lineitem""",
}


# --- configuration, from part ------------------------------------------------

def part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, colour = F.lower("p_type"), F.substring_index("p_name", " ", 1)
    size = F.col("p_size") % 3
    prefix = F.when(size == 0, "site.").when(size == 1, "env.").otherwise("")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("d"), text(F.floor(F.col("p_partkey") / 250))).alias("doc"),
        F.element_at(F.array(F.lit("internal"), F.lit("app_conf"), F.lit("resources")),
                     (F.floor(F.col("p_partkey") / 3) % 3 + 1).cast("int")).alias("tree"),
        F.col("p_brand").alias("component"), F.concat(prefix, kind, F.lit("."), colour).alias("key"),
        colour.alias("colour"), "p_size")


def config_trees(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None, by_tree: bool = True) -> DataFrame:
    """Entries grouped out of the parts: per component the largest size, globally the smallest."""
    p = part_keys(spark, sf_dir) if keys is None else keys
    tree = ["tree"] if by_tree else []
    none = F.lit(None).cast("string").alias("component")
    own = p.groupBy("doc", *tree, "component", "key").agg(text(F.max("p_size")).alias("value")).select(
        "doc", *tree, F.lit("component").alias("section"), "component", "key", "value")
    shared = p.groupBy("doc", *tree, "key").agg(text(F.min("p_size")).alias("value")).select(
        "doc", *tree, F.lit("global").alias("section"), none, "key", "value")
    about = p.groupBy("doc", *tree).agg(text(F.count("*")).alias("value")).select(
        "doc", *tree, F.lit("metadata").alias("section"), none, F.lit("parts").alias("key"), "value")
    return own.unionByName(shared).unionByName(about)


def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_trees(spark, sf_dir, by_tree=False)


def config_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower layer of every document: the parts of up to size 25."""
    return config_trees(spark, sf_dir, part_keys(spark, sf_dir).filter(F.col("p_size") <= 25), by_tree=False)


def config_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper layer of every document: the larger parts."""
    return config_trees(spark, sf_dir, part_keys(spark, sf_dir).filter(F.col("p_size") > 25), by_tree=False)


def linked_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose values name the entries of neighbouring parts."""
    letters = lambda c: F.translate(text(c), "0123456789", "abcdefghij")
    key = F.col("p_partkey")
    ref = lambda c: F.concat(F.lit("${k"), letters(c), F.lit("}"))
    size = F.col("p_size") % 5
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("d"), text(F.floor(key / 250))).alias("doc"), F.lit("component").alias("section"),
        F.col("p_brand").alias("component"), F.concat(F.lit("k"), letters(key)).alias("key"),
        F.when(size == 0, F.col("p_name")).when(size == 1, F.concat(ref(key + 1), F.lit("/x")))
        .when(size == 2, F.concat(F.lit("a"), ref(key + 1), F.lit("b"), ref(key + 2)))
        .when(size == 3, F.concat(F.lit("${none}"), ref(key + 1))).otherwise(ref(key + 1)).alias("value"))


def resource_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, size = F.col("p_type"), F.max("p_size")
    return table(spark, sf_dir, "part").groupBy(
        F.concat(F.lit("d"), text(F.floor(F.col("p_partkey") / 250))).alias("doc"), F.col("p_brand").alias("component"),
        F.when(kind == "LARGE", "yarn.memory").when(kind == "SMALL", "yarn.vcores").otherwise(kind).alias("key"),
    ).agg(F.when(size >= 45, "max").when(size >= 40, F.concat(F.lit("0x"), text(size))).otherwise(text(size)).alias("value")
          ).withColumn("section", F.lit("component"))


def audit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per colour, its kind by the length of the colour."""
    kind = F.length("colour") % 4
    keys = part_keys(spark, sf_dir)
    plain = keys.groupBy(F.col("colour").alias("key_suffix")).agg(
        F.first(F.when(kind == 0, "int").when(kind == 1, "count").when(kind == 2, "heap").otherwise("name")).alias("rule"),
        (F.min("p_size") + 9).alias("min"), F.lit(40).alias("max"))
    # suffixes of two parts, the type and the colour
    dotted = keys.groupBy(F.concat_ws(".", F.element_at(F.split("key", r"\."), -2), "colour").alias("key_suffix")).agg(
        F.when(F.max("p_size") % 2 == 0, "int").otherwise("schema").alias("rule"), (F.min("p_size") + 3).alias("min"), F.lit(30).alias("max"))
    return plain.unionByName(dotted)


def _entries_sql(source: str, tree: bool) -> str:
    t = "tree, " if tree else ""
    return f"""
      SELECT doc, {t}'component' AS section, component, key, CAST(max(p_size) AS VARCHAR) AS value FROM {source} GROUP BY ALL
      UNION ALL SELECT doc, {t}'global', NULL, key, CAST(min(p_size) AS VARCHAR) FROM {source} GROUP BY ALL
      UNION ALL SELECT doc, {t}'metadata', NULL, 'parts', CAST(count(*) AS VARCHAR) FROM {source} GROUP BY ALL"""


CONFIG = {
    "part_keys": """
      SELECT 'd' || (p_partkey // 250) AS doc,
             CASE (p_partkey // 3) % 3 WHEN 0 THEN 'internal' WHEN 1 THEN 'app_conf' ELSE 'resources' END AS tree,
             p_brand AS component, split_part(p_name, ' ', 1) AS colour, p_size,
             CASE p_size % 3 WHEN 0 THEN 'site.' WHEN 1 THEN 'env.' ELSE '' END || lower(p_type) || '.'
               || split_part(p_name, ' ', 1) AS key
      FROM part""",
    "config_trees": _entries_sql("part_keys", True),
    "config": _entries_sql("part_keys", False),
    "config_base": _entries_sql("(SELECT * FROM part_keys WHERE p_size <= 25)", False),
    "config_over": _entries_sql("(SELECT * FROM part_keys WHERE p_size > 25)", False),
    "linked_entries": """
      SELECT 'd' || (p_partkey // 250) AS doc, 'component' AS section, p_brand AS component,
             'k' || translate(CAST(p_partkey AS VARCHAR), '0123456789', 'abcdefghij') AS key,
             CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN n1 || '/x' WHEN 2 THEN 'a' || n1 || 'b' || n2
                  WHEN 3 THEN '${none}' || n1 ELSE n1 END AS value
      FROM (SELECT *, '${k' || translate(CAST(p_partkey + 1 AS VARCHAR), '0123456789', 'abcdefghij') || '}' AS n1,
                      '${k' || translate(CAST(p_partkey + 2 AS VARCHAR), '0123456789', 'abcdefghij') || '}' AS n2 FROM part)""",
    "resource_entries": """
      SELECT doc, component, key, CASE WHEN size >= 45 THEN 'max' WHEN size >= 40 THEN '0x' || size
                                       ELSE CAST(size AS VARCHAR) END AS value
      FROM (SELECT 'd' || (p_partkey // 250) AS doc, p_brand AS component,
                   CASE p_type WHEN 'LARGE' THEN 'yarn.memory' WHEN 'SMALL' THEN 'yarn.vcores' ELSE p_type END AS key,
                   max(p_size) AS size FROM part GROUP BY ALL)""",
    "audit_rules": """
      SELECT colour AS key_suffix, CASE length(colour) % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'count' WHEN 2 THEN 'heap'
             ELSE 'name' END AS rule, min(p_size) + 9 AS min, 40 AS max
      FROM part_keys GROUP BY colour
      UNION ALL
      SELECT split_part(key, '.', -2) || '.' || colour, CASE WHEN max(p_size) % 2 = 0 THEN 'int' ELSE 'schema' END,
             min(p_size) + 3, 30
      FROM part_keys GROUP BY 1, colour""",
    "resolved": """
      SELECT doc, component, key, value, 'component' AS origin FROM config WHERE section = 'component'
      UNION ALL
      SELECT n.doc, n.component, g.key, g.value, 'global'
      FROM (SELECT DISTINCT doc, component FROM config WHERE section = 'component') n
      JOIN config g ON g.doc = n.doc AND g.section = 'global'
      WHERE NOT EXISTS (SELECT 1 FROM config c WHERE c.section = 'component' AND c.doc = n.doc
                          AND c.component = n.component AND c.key = g.key)""",
}


# --- snapshots, from orders by month -----------------------------------------

def snapshot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month of orders as a snapshot; some have no footer, some an old version."""
    o = table(spark, sf_dir, "orders")
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    ms = F.floor(F.unix_micros(month) / 1000).cast("long")
    saved = F.lower(F.lpad(F.hex(ms), 16, "0"))
    open_orders = F.col("o_orderstatus") == "O"
    entries = o.select(
        saved.alias("saved"), ms.alias("saved_ms"), F.lit("entry").alias("kind"), F.lit(None).cast("int").alias("version"),
        text("o_orderkey").alias("host"), (F.col("o_custkey") % 5).cast("int").alias("role_id"),
        open_orders.alias("active"), F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("long").alias("last_used"),
        F.lit(None).cast("long").alias("count"))
    months = o.groupBy(saved.alias("saved"), ms.alias("saved_ms")).agg(
        F.count("*").alias("n"), F.count_if(open_orders).alias("opens"))
    ends = months.select("saved", "saved_ms", F.inline(F.array(
        F.struct(F.lit("header").alias("kind"), F.when(F.col("n") % 7 == 0, 2).otherwise(1).alias("version"),
                 F.lit(None).cast("long").alias("count")),
        F.struct(F.when(F.col("opens") % 3 == 0, "lost").otherwise("footer").alias("kind"),
                 F.lit(None).cast("int").alias("version"),
                 (F.col("n") - F.when(F.col("n") % 2 == 0, 1).otherwise(0)).alias("count")))))
    return entries.unionByName(ends.select(
        "saved", "saved_ms", "kind", "version", F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("int").alias("role_id"), F.lit(None).cast("boolean").alias("active"),
        F.lit(None).cast("long").alias("last_used"), "count"))


SNAPSHOTS = {
    "months": """
      SELECT (epoch_us(date_trunc('month', o_orderdate)::TIMESTAMP) // 1000) AS saved_ms, count(*) AS n,
             count(*) FILTER (o_orderstatus = 'O') AS opens
      FROM orders GROUP BY 1""",
    "checked": """
      SELECT printf('%016x', saved_ms) AS saved, saved_ms, n AS entries, n % 7 <> 0 AND opens % 3 <> 0 AS valid,
             opens % 3 <> 0 AND n % 2 <> 0 AS footer_ok FROM months""",
    "entries": """
      SELECT (epoch_us(date_trunc('month', o_orderdate)::TIMESTAMP) // 1000) AS saved_ms, CAST(o_orderkey AS VARCHAR) AS host,
             CAST(o_custkey % 5 AS INTEGER) AS role_id, o_orderstatus = 'O' AS active, (epoch_us(o_orderdate) // 1000) AS last_used
      FROM orders""",
}

LOG = {
    "clean": "SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM documents",
    "log": """
      SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS line_no, unnest(parts) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM clean WHERE text <> '')""",
}

PLACEMENT["order_placement"] = PLACEMENT["placement"].replace("l_partkey", "l_orderkey")
ALL_SQL: dict[str, str] = {**LIFECYCLE, **EVENT_VIEWS, **PLACEMENT, **REGISTRY, **CONFIG, **SNAPSHOTS, **LOG}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """A statement with the named views (in this order) in front of it."""
    ctes = ", ".join(f"{n} AS ({ALL_SQL[n]})" for n in names.split())
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ctes + (", " if recursive else " ") + body) if names else body
