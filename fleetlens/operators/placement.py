"""Placement history: which hosts to use again, which to release, which to forget.

A cell is one (role_id, host) row with ``live, releasing, requested, starting`` counts
and ``last_used``. Roles are few and hosts are many, so nothing here ranks a whole role
in one task; see ``functions.ordered``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.functions.ordered import clamped_totals, first_in_group, first_k_in_group, join_one, rank_in_group
from fleetlens.operators.lifecycle import millis
from fleetlens.session import durable

# fixed values: bits of a role's placement policy
EXCLUDE_FROM_FLEXING = 1
NO_LOCALITY = 2

SLOT_BLOCK = 100_000


def active() -> Column:
    """Instances of a cell that could be released."""
    return (F.col("live") - F.col("releasing")).cast("long")


def is_available() -> Column:
    return (active() == 0) & (F.col("requested") == 0) & (F.col("starting") == 0)


def placement_cells(transitions: DataFrame) -> DataFrame:
    """Fold container transitions into one row per (role_id, host).

    Input is the result of ``lifecycle.transitions``. The three running counters are
    floored at zero step by step; ``last_used`` is the time of the last completion
    that left the cell free.
    """
    effect = F.col("effect")
    short = effect.isin("START_FAILED", "FAILED_SHORT")
    ended = effect.isin("RELEASED", "FAILED")
    moves = transitions.filter(
        effect.isin("ASSIGNED", "STARTED", "RELEASING") | short | ended
    ).select(
        "role_id", "host", "ts", "seq", "effect",
        F.when(effect == "ASSIGNED", 1).when((effect == "STARTED") | short, -1).otherwise(0).alias("d_starting"),
        F.when(effect == "STARTED", 1).when(ended, -1).otherwise(0).alias("d_live"),
        F.when(effect == "RELEASING", 1).when(effect == "RELEASED", -1).otherwise(0).alias("d_releasing"),
    )
    # written once: they come out of a join, and cells are counted before they are walked through
    walked = clamped_totals(durable(moves), ["role_id", "host"], [F.col("seq").asc()], {
        "starting": "d_starting", "live": "d_live", "releasing": "d_releasing"})
    freed = ended & (F.col("live") - F.col("releasing") == 0) & (F.col("starting") == 0)
    return walked.groupBy("role_id", "host").agg(
        F.lit(0).cast("long").alias("requested"),
        F.max_by("starting", "seq").alias("starting"),
        F.count_if(short).alias("start_failed"),
        F.count_if(short | (effect == "FAILED")).alias("failed"),
        F.max_by("live", "seq").alias("live"),
        F.max_by("releasing", "seq").alias("releasing"),
        F.max_by("ts", F.when(freed, F.col("seq"))).alias("last_used"),
    )


def placement_sums(transitions: DataFrame) -> DataFrame:
    """Unfloored counters as plain sums: one pass, works on streams as well."""
    effect = F.col("effect")
    return transitions.groupBy("role_id", "host").agg(
        (F.count_if(effect == "ASSIGNED")
         - F.count_if(effect.isin("STARTED", "START_FAILED", "FAILED_SHORT"))).alias("starting"),
        (F.count_if(effect == "STARTED") - F.count_if(effect.isin("RELEASED", "FAILED"))).alias("live"),
        (F.count_if(effect == "RELEASING") - F.count_if(effect == "RELEASED")).alias("releasing"),
        F.count_if(effect.isin("START_FAILED", "FAILED", "FAILED_SHORT")).alias("failed"),
    )


def available_cells(cells: DataFrame) -> DataFrame:
    return cells.filter(is_available())


def _recent() -> list[Column]:
    return [F.col("last_used").desc_nulls_last(), F.col("host").asc()]


def recency(cells: DataFrame) -> Column:
    """``last_used`` as a number that grows with it."""
    kind = cells.schema["last_used"].dataType.typeName()
    return millis(F.col("last_used")) if kind.startswith(("date", "timestamp")) else F.col("last_used")


def recency_rank(cells: DataFrame, name: str = "recency") -> DataFrame:
    """Hosts of each role, most recently used first."""
    return rank_in_group(cells, ["role_id"], _recent(), name)


def pick_hosts(cells: DataFrame, demand: DataFrame) -> DataFrame:
    """Hosts to ask for: the ``k`` most recent free hosts of each role.

    ``demand(role_id, k[, policy])`` has one row per role. Slots beyond the free hosts,
    and all slots of a role with the no-locality bit, have a null host (anywhere).
    Free hosts that a histogram of the role shows to be used too long ago are not sorted.
    """
    if "policy" not in demand.columns:
        demand = demand.withColumn("policy", F.lit(0))
    wanted = durable(demand.filter(F.col("k") > 0).select("role_id", F.col("k").cast("long").alias("k"), "policy"))
    located = wanted.filter(F.col("policy").bitwiseAND(NO_LOCALITY) == 0).select("role_id", "k")
    free = join_one(available_cells(cells).select("role_id", "host", "last_used"), located, ["role_id"], ["host"], written=True)
    ranked = first_in_group(free, ["role_id"], recency(cells), _recent(), "k", "slot")
    # slots are dealt out in blocks, so that a role asking for very many is not one task
    k, block = F.col("k"), F.col("_block")
    blocks = wanted.select("role_id", "k", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((k - 1) / SLOT_BLOCK))).alias("_block")).repartition("role_id", "_block")
    slots = blocks.select("role_id", F.explode(F.sequence(
        block * SLOT_BLOCK + 1, F.least(F.col("k"), (block + 1) * SLOT_BLOCK))).alias("slot"))
    return slots.join(ranked.select("role_id", "slot", "host"), ["role_id", "slot"], "left").select(
        "role_id", "slot", "host")


def busiest_hosts(cells: DataFrame) -> DataFrame:
    """Active hosts ranked by load; equal loads share a rank.

    The rank comes from a histogram (role, load) -> hosts, whose size is the number of
    distinct loads, so the hosts themselves are never sorted in one place.
    """
    busy = cells.withColumn("active", active()).filter(F.col("active") > 0)
    loads = busy.groupBy("role_id", "active").agg(F.count("*").alias("_n"))
    above = W.partitionBy("role_id").orderBy(F.col("active").desc()).rowsBetween(W.unboundedPreceding, -1)
    ranks = loads.select("role_id", "active",
                         (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).cast("long").alias("rank"))
    return busy.join(ranks, ["role_id", "active"]).select("role_id", "host", "active", "rank")


def _copies(cells: DataFrame, limit: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per releasable instance in the order classes described below.

    Phase 0 holds every instance above one per host; the last instance of a host comes
    in phase 1 when the host had only one and in phase 2 otherwise. A host never needs
    more than ``limit`` phase-0 rows because they would already fill the answer.
    """
    act, block = F.col("active"), F.col("_block")
    busy = cells.withColumn("active", active()).filter((F.col("active") > 0) & (limit > 0)).withColumn(
        "_above", F.least(F.col("active") - 1, limit.cast("long")))
    # a host with very many instances is unrolled block by block, never as one long array
    blocks = busy.select("role_id", "host", "active", "_above", *keep, F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.floor((F.col("_above") - 1) / SLOT_BLOCK), F.lit(0)))).alias("_block"))
    shape = "array<struct<phase:int,copy:bigint>>"
    none = F.array().cast(shape)
    above = F.when(F.col("_above") > 0, F.transform(
        F.sequence(block * SLOT_BLOCK + 1, F.least(F.col("_above"), (block + 1) * SLOT_BLOCK)),
        lambda i: F.struct(F.lit(0).alias("phase"), i.alias("copy"))).cast(shape)).otherwise(none)
    last = F.when(block == 0, F.array(F.struct(
        F.when(act > 1, 2).otherwise(1).alias("phase"), act.alias("copy"))).cast(shape)).otherwise(none)
    return blocks.select("role_id", "host", "active", *keep, F.inline(F.concat(above, last)))


def _release_order() -> list[Column]:
    return [F.col("phase").asc(), F.col("active").desc(), F.col("host").asc(), F.col("copy").asc()]


def release_candidates(cells: DataFrame, n: int) -> DataFrame:
    """Which host to release an instance from, ``n`` per role; a host may repeat."""
    if n < 0:
        raise ValueError("number of instances to release must not be negative")
    return first_k_in_group(_copies(cells, F.lit(n)), ["role_id"], _release_order(), n)


def release_by_role(cells: DataFrame, demand: DataFrame) -> DataFrame:
    """``release_candidates`` with a separate number ``n`` for every role.

    A histogram (role, load) -> hosts tells how many instances each class (phase, load) has and so
    where it begins in the order. In a class all hosts give the same number of instances, so the
    hosts that are reached are the first few by name; only these are ranked and unrolled.
    """
    wanted = durable(demand.filter(F.col("n") > 0).select("role_id", F.col("n").cast("long").alias("n")))
    busy = cells.withColumn("active", active()).filter(F.col("active") > 0).select("role_id", "host", "active")
    loads = join_one(busy.groupBy("role_id", "active").agg(F.count("*").alias("_hosts")), wanted, ["role_id"], ["active"], written=True)
    act = F.col("active")
    classes = loads.select("role_id", "n", "active", "_hosts", F.inline(F.array(
        F.struct(F.lit(0).alias("phase"), F.least(act - 1, F.col("n")).alias("_each")),
        F.struct(F.when(act > 1, 2).otherwise(1).alias("phase"), F.lit(1).cast("long").alias("_each"))))).filter("_each > 0")
    earlier = W.partitionBy("role_id").orderBy("phase", F.col("active").desc()).rowsBetween(W.unboundedPreceding, -1)
    begun = classes.withColumn("_left", F.col("n") - F.coalesce(F.sum(F.col("_hosts") * F.col("_each")).over(earlier), F.lit(0)))
    reached = durable(begun.filter(F.col("_left") > 0).select(
        "role_id", "active", "phase", "n", "_each", "_left", F.ceil(F.col("_left") / F.col("_each")).alias("_need")))
    phases = reached.groupBy("role_id", "active").agg(F.collect_list(F.struct("phase", "n", "_each", "_left", "_need")).alias("_p"))  # two at most
    hosts = join_one(busy, phases, ["role_id", "active"], ["host"], written=True).select("role_id", "host", "active", F.inline("_p"))
    most = reached.agg(F.max(F.least("_need", "n"))).first()[0] or 0
    taken = first_k_in_group(hosts, ["role_id", "active", "phase"], [F.col("host").asc()], most, "_place").filter(
        F.col("_place") <= F.col("_need"))
    # unrolled in blocks, so that a host with very many instances is not one long array
    done = (F.col("_place") - 1) * F.col("_each")
    size, block = F.least(F.col("_each"), F.col("_left") - done), F.col("_block")
    blocks = taken.withColumns({"_done": done, "_size": size}).withColumn("_block", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / SLOT_BLOCK))))
    copies = blocks.withColumn("_i", F.explode(F.sequence(block * SLOT_BLOCK + 1, F.least(F.col("_size"), (block + 1) * SLOT_BLOCK))))
    return copies.select("role_id", "host", "active", "phase", F.when(F.col("phase") == 0, F.col("_i")).otherwise(act).alias("copy"),
                         (F.col("n") - F.col("_left") + F.col("_done") + F.col("_i")).alias("rank"))


def purge_cells(cells: DataFrame, cutoff) -> DataFrame:
    """Cells kept when free cells not used since ``cutoff`` are forgotten."""
    stale = is_available() & (F.col("last_used") < F.lit(cutoff))
    return cells.filter(~F.coalesce(stale, F.lit(False)))


def purged_hosts(cells: DataFrame, cutoff) -> DataFrame:
    """Hosts left without any cell after ``purge_cells``."""
    stale = is_available() & (F.col("last_used") < F.lit(cutoff))
    return cells.groupBy("host").agg(
        F.min(F.coalesce(stale, F.lit(False)).cast("int")).alias("_gone"), F.count("*").alias("cells")
    ).filter(F.col("_gone") == 1).select("host", "cells")


def located_requests(requests: DataFrame) -> DataFrame:
    """Host-specific requests; of several for one (role, host) the newest stays."""
    return requests.filter(F.col("host").isNotNull()).groupBy("role_id", "host").agg(
        F.max("request_id").alias("request_id"),
        F.max_by("requested_at", "request_id").alias("requested_at"))


def match_requests(offers: DataFrame, requests: DataFrame) -> DataFrame:
    """Flag offers that answer an outstanding request for that role and host."""
    asked = located_requests(requests).select("role_id", "host", F.lit(True).alias("_hit"))
    return join_one(offers, asked, ["role_id", "host"], ["container_id"], "left").withColumn(
        "requested", F.coalesce("_hit", F.lit(False))).drop("_hit")


def settle_requests(requests: DataFrame, offers: DataFrame, roles: DataFrame) -> DataFrame:
    """What becomes of each outstanding request once the offers have arrived.

    An offer on the same (role, host) satisfies it. When a role reaches its desired
    count through the offers the others are cancelled, and their hosts go back to the
    list of hosts to choose from.
    """
    open_requests = located_requests(requests)
    answered = offers.groupBy("role_id", "host").agg(F.lit(True).alias("_hit"))
    arrived = offers.groupBy("role_id").agg(F.count("*").alias("_offers"))
    full = (roles.join(arrived, "role_id")
            .filter(F.col("desired") <= F.col("actual") + F.col("_offers"))
            .select("role_id", F.lit(True).alias("_full")))
    # both sides of the first join have one row per key; of the second, roles may be very large
    return (
        join_one(open_requests.join(answered, ["role_id", "host"], "left"), full, ["role_id"], ["host"], "left")
        .select("role_id", "host", "request_id",
                F.when(F.col("_hit"), "satisfied").when(F.col("_full"), "cancelled")
                .otherwise("outstanding").alias("status"))
    )


def returned_hosts(settled: DataFrame, cells: DataFrame) -> DataFrame:
    """Hosts of cancelled requests ranked with the free hosts of their role."""
    back = settled.filter(F.col("status") == "cancelled").select("role_id", "host")
    free = available_cells(cells).select("role_id", "host")
    pool = free.unionByName(back).distinct()
    used = cells.select("role_id", "host", "last_used")
    return recency_rank(pool.join(used, ["role_id", "host"], "left"))


def cluster_size(cells: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("host") if approximate else F.count_distinct("host")
    return cells.agg(count.alias("hosts"))


def containers_to_release(containers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Name a container for every chosen (role, host) copy, each container once.

    The chosen copies of a host are numbered 1, 2, ... without a gap: its last copy is
    only reached when all others are taken. Containers already being released are not
    used. Copies without a container left have a null id, which the caller should treat
    as an inconsistency.
    """
    chosen = durable(candidates.select("role_id", "host", "copy", "rank"))
    most = chosen.agg(F.max("copy")).first()[0] or 0
    hosts = chosen.groupBy("role_id", "host").agg(F.max("copy").alias("_copies"))
    free = join_one(containers.filter(~F.col("releasing")).select("role_id", "host", "container_id"), hosts,
                    ["role_id", "host"], ["container_id"], written=True).drop("_copies")
    named = first_k_in_group(free, ["role_id", "host"], [F.col("container_id").asc()], most, "copy")
    return chosen.join(named, ["role_id", "host", "copy"], "left").select(
        "role_id", "rank", "host", "container_id")
