"""Status reports: per-role documents, name listings and container listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.ordered import join_one
from fleetlens.operators.lifecycle import STATE_LIVE, instance_records

# fixed values: statistic names in a status document
STATISTIC_KEYS = {
    "active_requests": "containers.active.requests",
    "completed": "containers.completed",
    "desired": "containers.desired",
    "failed": "containers.failed",
    "live": "containers.live",
    "requested": "containers.requested",
    "started": "containers.start.started",
    "start_failed": "containers.start.failed",
}

APPLICATION_KEYS = {
    "completed": "containers.completed",
    "failed": "containers.failed",
    "live": "containers.live",
    "started": "containers.start.started",
    "start_failed": "containers.start.failed",
    "surplus": "containers.surplus",
    "unknown_completed": "containers.unknown.completed",
}

_ROLE = "name desired actual requested releasing failed start_failed".split()
_RECORD = ("host:string,state:int,released:boolean,create_time:bigint,start_time:bigint,exit_code:int,"
           "diagnostics:string")
_DOCUMENT = ("role struct<name:string,desired:bigint,actual:bigint,requested:bigint,releasing:bigint,failed:bigint,"
             "start_failed:bigint>, statistics map<string,bigint>, info map<string,string>, instances array<string>, "
             f"live map<string,struct<{_RECORD}>>")


def _role_rows(state: DataFrame, stats: DataFrame, roles: DataFrame) -> DataFrame:
    running = state.filter(F.col("state") <= STATE_LIVE).groupBy("role_id").agg(
        F.count("*").alias("actual"), F.count_if("released").alias("releasing"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return roles.select("role_id", "name").join(stats, "role_id").join(running, "role_id", "left").withColumns(
        {"actual": zero("actual"), "releasing": zero("releasing")})


def status_by_role(state: DataFrame, stats: DataFrame, roles: DataFrame) -> DataFrame:
    """Flat status: the instance count and six counters of each role."""
    return _role_rows(state, stats, roles).select(
        "role_id", "name", "desired", "actual", F.col("active_requests").alias("requested"), "releasing",
        "failed", "start_failed")


def _named(keys: dict[str, str]):
    return F.create_map(*[x for c, k in keys.items() for x in (F.lit(k), F.col(c))]).alias("statistics")


def status_document(state: DataFrame, stats: DataFrame, roles: DataFrame, application: DataFrame | None = None,
                    provider_status: dict[str, str] | None = None, application_info: dict[str, str] | None = None,
                    page: int = 1000) -> DataFrame:
    """JSON status ``role_id, page, json``; all pages together are the whole document.

    Page 0 of a role has its options and statistics, and every page the ids and records of up to
    ``page`` of its live instances, so that a large role does not have to fit into one document.
    With ``application`` (one row of ``lifecycle.application_statistics``) a document without a role
    has the statistics of the application, live instances included, and the info map, in which
    ``application_info`` does not replace what ``provider_status`` says.
    """
    live = state.filter(F.col("state") <= STATE_LIVE)
    records = F.col("records")
    pages = instance_records(live, page).select(
        "role_id", "page", F.transform(records, lambda r: r.container_id).alias("instances"),
        F.map_from_entries(F.transform(records, lambda r: F.struct(r.container_id, r.record))).alias("live"))
    heads = _role_rows(state, stats, roles).select(
        "role_id", F.lit(0).cast("long").alias("page"),
        F.struct(*[F.col("active_requests" if c == "requested" else c).alias(c) for c in _ROLE]).alias("role"),
        _named(STATISTIC_KEYS))
    documents = heads.join(pages, ["role_id", "page"], "full").select(
        "role_id", "page", F.to_json(F.struct("role", "statistics", "instances", "live")).alias("json"))
    if application is None:
        return documents
    merged = {**(application_info or {}), **(provider_status or {})}
    info = F.create_map(*[F.lit(x) for kv in merged.items() for x in kv]).cast("map<string,string>").alias("info")
    whole = application.withColumn("live", live.agg(F.count("*")).scalar())
    return documents.unionByName(whole.select(
        F.lit(None).cast(documents.schema["role_id"].dataType).alias("role_id"), F.lit(0).cast("long").alias("page"),
        F.to_json(F.struct(_named(APPLICATION_KEYS), info)).alias("json")))


def parse_status(documents: DataFrame) -> DataFrame:
    """``role_id, page`` and the parts ``role, statistics, info, instances, live`` of status documents."""
    return documents.select("role_id", "page", F.from_json("json", _DOCUMENT).alias("d")).select("role_id", "page", "d.*")


def status_entries(documents: DataFrame) -> DataFrame:
    """Options, statistics and info of status documents as rows ``role_id, section, key, value``.

    ``role_id`` is null for the application.
    """
    def entries(section: str, values):
        return F.transform(F.map_entries(F.coalesce(values, F.create_map().cast("map<string,string>"))), lambda e: F.struct(
            F.lit(section).alias("section"), e["key"].alias("key"), e["value"].alias("value")))
    options = F.create_map(*[x for c in _ROLE for x in (F.lit(c), F.col("role")[c].cast("string"))])
    return parse_status(documents).select("role_id", F.inline(F.concat(
        entries("role", F.when(F.col("role").isNotNull(), options)),
        entries("statistics", F.col("statistics").cast("map<string,string>")), entries("info", F.col("info")))))


def status_records(documents: DataFrame) -> DataFrame:
    """Records of the live instances in status documents, one row each; hosts come back as text."""
    return parse_status(documents).select("role_id", F.explode("live").alias("container_id", "r")).select(
        "role_id", "container_id", "r.*")


def status_by_name(roles: DataFrame, stats: DataFrame) -> DataFrame:
    """Roles joined to their statistics, sorted by role name."""
    return roles.select("role_id", "name").join(stats, "role_id").orderBy("name")


def roles_without_stats(roles: DataFrame, stats: DataFrame) -> DataFrame:
    return roles.select("role_id", "name").join(stats, "role_id", "left_anti")


def container_listing(state: DataFrame, addresses: DataFrame) -> DataFrame:
    """Containers per role by name, nulls first; a link only where the host has an address, one per host."""
    link = F.concat(F.lit("http://"), F.col("address"), F.lit("/node/container/"), F.col("container_id"))
    return join_one(state, addresses.select("host", "address"), ["host"], ["container_id"], "left").select(
        "role_id", "container_id", "host", link.alias("link")).orderBy(
        "role_id", F.col("container_id").asc_nulls_first())
