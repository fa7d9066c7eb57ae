"""Application registry: listing, choosing and checking application instances.

``apps(app_id, type, user, name, state, start_ts, finish_ts, ...)``, state as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.ordered import join_one

# fixed values: application states in life-cycle order
STATES = ("NEW", "NEW_SAVING", "SUBMITTED", "ACCEPTED", "RUNNING", "FINISHED", "FAILED", "KILLED")
RUNNING = STATES.index("RUNNING")


def state_order(state: Column) -> Column:
    """Ordinal of a state name, null for an unknown one."""
    position = F.array_position(F.array(*[F.lit(s) for s in STATES]), state) - 1
    return F.when(position >= 0, position.cast("int"))


def is_live() -> Column:
    return state_order(F.col("state")) <= RUNNING


def list_apps(apps: DataFrame, type: str, user=None) -> DataFrame:
    found = apps.filter(F.col("type") == type)
    return found if user is None else found.filter(F.col("user") == user)


def find_apps(apps: DataFrame, type: str, name, user=None) -> DataFrame:
    return list_apps(apps, type, user).filter(F.col("name") == name)


def live_apps(apps: DataFrame, name=None, user=None) -> DataFrame:
    live = apps.filter(is_live())
    if user is not None:
        live = live.filter(F.col("user") == user)
    return live if name is None else live.filter(F.col("name") == name)


def pick_app(apps: DataFrame) -> DataFrame:
    """One application per name: the newest live one, else the newest.

    An aggregate rather than a ranking, so each name's rows are combined map-side.
    """
    live = F.coalesce(is_live(), F.lit(False))
    best = F.max(F.struct(live.alias("live"), "start_ts", "app_id", "state"))
    return apps.groupBy("name").agg(best.alias("_b")).select(
        "name", "_b.app_id", "_b.state", "_b.start_ts", "_b.live")


def exists_app(names: DataFrame, apps: DataFrame) -> DataFrame:
    """For each asked name: unknown, not running or running."""
    picked = pick_app(apps).select("name", "live")
    asked = names.select("name").distinct()
    return asked.join(picked, "name", "left").select(
        "name", F.when(F.col("live").isNull(), "unknown").when(F.col("live"), "running")
        .otherwise("not running").alias("status"))


def reached_state(history: DataFrame, state: str, limit_ms: int) -> DataFrame:
    """First time each application was at least in ``state``; null when too late.

    ``history(app_id, state, ts)``; the limit counts from the first report.
    """
    wanted = STATES.index(state)
    hit = F.min(F.when(state_order(F.col("state")) >= wanted, F.col("ts")))
    seen = history.groupBy("app_id").agg(F.min("ts").alias("first_ts"), hit.alias("hit_ts"))
    took = (F.unix_micros(F.col("hit_ts").cast("timestamp"))
            - F.unix_micros(F.col("first_ts").cast("timestamp"))) / 1000
    return seen.select("app_id", F.when(took <= limit_ms, F.col("hit_ts")).alias("reached_ts"))


def duplicate_running(apps: DataFrame) -> DataFrame:
    """Names with more than one running instance of the same user."""
    return apps.filter(F.col("state") == "RUNNING").groupBy("user", "name").agg(
        F.count("*").alias("running")).filter(F.col("running") > 1)


def app_containers(apps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Containers of each application over the hosts that run them.

    ``nodes(host, containers array<struct<app_id, container_id>>)``; ``apps`` has one row per id.
    """
    placed = nodes.select("host", F.inline("containers"))
    return join_one(placed, apps.select("app_id", "name"), ["app_id"], ["host", "container_id"]).select(
        "app_id", "name", "host", "container_id")


def gmt(ts: Column) -> Column:
    """``d Mon yyyy hh:mm:ss GMT`` text of a timestamp."""
    return F.concat(F.date_format(ts, "d MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def app_report_text(apps: DataFrame, separator: str = "\n") -> DataFrame:
    """Summary text per application.

    The finish line needs a finish time, the diagnostics line needs a text.
    """
    text = F.concat_ws(
        separator,
        F.concat(F.lit("application "), F.col("name").cast("string"), F.lit("/"), F.col("type")),
        F.concat(F.lit("state: "), F.col("state")),
        F.concat(F.lit("URL: "), F.coalesce("url", F.lit("null"))),
        F.concat(F.lit("Started "), gmt(F.col("start_ts"))),
        F.concat(F.lit("Finished "), gmt(F.col("finish_ts"))),
        F.concat(F.lit("RPC :"), F.coalesce("rpc_host", F.lit("null")), F.lit(":"), F.col("rpc_port").cast("string")),
        F.when(F.col("diagnostics") != "", F.concat(F.lit("Diagnostics :"), F.col("diagnostics"))))
    return apps.select("app_id", text.alias("report"))
