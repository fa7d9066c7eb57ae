import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import lifecycle as lc
from fleetlens.operators import placement as p

CELL = "host string, role_id int, live int, releasing int, requested int, starting int, last_used bigint"


def cells(spark, *sets):
    """Hosts given as (age, live in role 0, 1, 2); role 0 always has a cell, used at its age."""
    rows = []
    for age, *live in sets:
        host = f"age{age}live[{','.join(map(str, live))}]"
        for role, n in enumerate(live):
            if role == 0 or n > 0:
                rows.append((host, role, n, 0, 0, 0, age if role == 0 else 0))
    return spark.createDataFrame(rows, CELL)


RELEASE = ((2, 2, 0, 0), (4, 1, 0, 0), (1, 4, 0, 0), (3, 0, 0, 0))
NEW = ((2, 2, 0, 1), (2, 0, 0, 0), (4, 1, 0, 0), (1, 4, 0, 0), (3, 0, 0, 0))
SHORT = {"age1live[4,0,0]": "A1", "age2live[2,0,0]": "A2", "age4live[1,0,0]": "A4"}


def ordered(df, col="rank"):
    return [SHORT.get(r.host, r.host) for r in df.filter("role_id = 0").orderBy(col).collect()]


def test_busiest(spark):
    assert ordered(p.busiest_hosts(cells(spark, *RELEASE))) == ["A1", "A2", "A4"]


def test_busiest_shares_rank(spark):
    got = p.busiest_hosts(spark.createDataFrame(
        [("a", 0, 3, 0, 0, 0, 1), ("b", 0, 4, 1, 0, 0, 1), ("c", 0, 1, 0, 0, 0, 1), ("d", 0, 2, 2, 0, 0, 1)], CELL))
    assert sorted((r.host, r["rank"]) for r in got.collect()) == [("a", 1), ("b", 1), ("c", 3)]


@pytest.mark.parametrize("n, expected", [
    (0, []), (1, ["A1"]), (2, ["A1", "A1"]), (3, ["A1", "A1", "A1"]), (4, ["A1", "A1", "A1", "A2"]),
    (5, ["A1", "A1", "A1", "A2", "A4"]), (6, ["A1", "A1", "A1", "A2", "A4", "A1"]),
    (7, ["A1", "A1", "A1", "A2", "A4", "A1", "A2"]), (8, ["A1", "A1", "A1", "A2", "A4", "A1", "A2"])])
def test_release_candidates(spark, n, expected):
    base = cells(spark, *RELEASE)
    assert ordered(p.release_candidates(base, n)) == expected
    demand = spark.createDataFrame([(0, n)], "role_id int, n int")
    assert ordered(p.release_by_role(base, demand)) == expected


def test_release_large_limit_takes_range_layout(spark):
    assert ordered(p.release_candidates(cells(spark, *RELEASE), 5000)) == ["A1", "A1", "A1", "A2", "A4", "A1", "A2"]


def test_release_negative(spark):
    with pytest.raises(ValueError):
        p.release_candidates(cells(spark, *RELEASE), -1)


@pytest.mark.parametrize("cutoff, removed", [(3, 0), (4, 1), (5, 1)])
def test_purge(spark, cutoff, removed):
    base = cells(spark, *RELEASE)
    assert p.purged_hosts(base, cutoff).count() == removed
    assert p.purge_cells(base, cutoff).select("host").distinct().count() == 4 - removed


def test_recency(spark):
    got = p.recency_rank(cells(spark, *RELEASE)).orderBy("recency").collect()
    assert [r.last_used for r in got] == [4, 3, 2, 1]


def test_pick_hosts(spark):
    base = cells(spark, *NEW)
    demand = spark.createDataFrame([(0, 3), (2, 4)], "role_id int, k int")
    got = p.pick_hosts(base, demand).orderBy("role_id", "slot").collect()
    assert [r.host for r in got if r.role_id == 0] == ["age3live[0,0,0]", "age2live[0,0,0]", None]
    assert [r.host for r in got if r.role_id == 2] == [None] * 4


def test_pick_hosts_without_locality(spark):
    demand = spark.createDataFrame([(0, 2, p.NO_LOCALITY)], "role_id int, k int, policy int")
    assert [r.host for r in p.pick_hosts(cells(spark, *NEW), demand).collect()] == [None, None]


def test_available_order(spark):
    got = p.recency_rank(p.available_cells(cells(spark, *NEW)).filter("role_id = 0")).orderBy("recency").collect()
    assert [r.last_used for r in got] == [3, 2]


REQ = "role_id int, host string, request_id bigint, requested_at bigint"
OFFER = "container_id string, role_id int, host string"
ROLE = "role_id int, desired int, actual int"


def test_settle(spark):
    requests = spark.createDataFrame([(0, "host1", 1, 1), (0, "host2", 2, 1), (1, "host1", 3, 1), (1, None, 4, 1)], REQ)
    offers = spark.createDataFrame([("c1", 1, "host1"), ("c2", 0, "host9")], OFFER)
    roles = spark.createDataFrame([(0, 1, 0), (1, 5, 0)], ROLE)
    got = {(r.role_id, r.host): r.status for r in p.settle_requests(requests, offers, roles).collect()}
    assert got == {(1, "host1"): "satisfied", (0, "host1"): "cancelled", (0, "host2"): "cancelled"}
    roles = spark.createDataFrame([(0, 2, 0), (1, 5, 0)], ROLE)
    got = {(r.role_id, r.host): r.status for r in p.settle_requests(requests, offers, roles).collect()}
    assert got[(0, "host1")] == "outstanding"


def test_located_keeps_newest(spark):
    requests = spark.createDataFrame([(0, "h", 1, 10), (0, "h", 2, 20), (0, None, 3, 30)], REQ)
    assert [tuple(r) for r in p.located_requests(requests).collect()] == [(0, "h", 2, 20)]


def test_admission_prefers_requested_then_recent(spark):
    offers = spark.createDataFrame([("c1", 0, "a"), ("c2", 0, "b"), ("c3", 0, "c"), ("c4", 1, "a")], OFFER)
    requests = spark.createDataFrame([(0, "c", 1, 1)], REQ)
    roles = spark.createDataFrame([(0, 2, 0), (1, 0, 0)], ROLE)
    base = spark.createDataFrame([("a", 0, 0, 0, 0, 0, 5), ("b", 0, 0, 0, 0, 0, 9)], CELL)
    got = {r.container_id: (r.position, r.decision) for r in lc.admit_allocations(offers, roles, requests, base).collect()}
    assert got == {"c3": (1, "assigned"), "c2": (2, "assigned"), "c1": (3, "surplus"), "c4": (1, "surplus")}


def test_containers_to_release_uses_each_once(spark):
    chosen = p.release_candidates(spark.createDataFrame([("a", 0, 3, 0, 0, 0, 1)], CELL), 2)
    have = spark.createDataFrame([("x", 0, "a", False), ("y", 0, "a", True), ("z", 0, "a", False)],
                                 "container_id string, role_id int, host string, releasing boolean")
    assert sorted(r.container_id for r in p.containers_to_release(have, chosen).collect()) == ["x", "z"]


EVENT = ("container_id string, role_id int, host string, event string, ts timestamp_ntz, seq bigint, "
         "exit_code int, diagnostics string")
T0 = dt.datetime(2024, 1, 1)


def script(spark, *steps):
    """Events from (container, event, seconds); all in role 0 on host h."""
    return spark.createDataFrame(
        [(c, 0, "h", e, T0 + dt.timedelta(seconds=s), i, 1, "bad") for i, (c, e, s) in enumerate(steps)], EVENT)


def counts(spark, events, desired=1):
    roles = spark.createDataFrame([(0, desired, 1)], "role_id int, desired int, requested int")
    return lc.role_statistics(events, roles).first()


def cell(events):
    return p.placement_cells(lc.transitions(events)).first()


def free(events):
    return p.available_cells(p.placement_cells(lc.transitions(events))).count() == 1


def test_short_lived_failure(spark):
    ev = script(spark, ("c", "ALLOCATED", 0), ("c", "STARTED", 1), ("c", "COMPLETED", 1))
    got = counts(spark, ev)
    assert (got.failed, got.start_failed, got.live) == (1, 1, 0)
    assert not free(ev)


def test_long_running_failure(spark):
    ev = script(spark, ("c", "ALLOCATED", 0), ("c", "STARTED", 1), ("c", "COMPLETED", 3601))
    got = counts(spark, ev)
    assert (got.failed, got.start_failed) == (1, 0)
    assert free(ev) and cell(ev).last_used == T0 + dt.timedelta(seconds=3601)


def test_start_failure(spark):
    ev = script(spark, ("c", "ALLOCATED", 0), ("c", "START_FAILED", 1))
    got = counts(spark, ev)
    assert (got.failed, got.start_failed) == (1, 1)
    c = cell(ev)
    assert (c.failed, c.start_failed, c.starting, c.last_used) == (1, 1, 0, None)


def test_failure_threshold(spark):
    steps = [(f"c{i}", e, i) for i in range(6) for e in ("ALLOCATED", "START_FAILED")]
    assert lc.unstable_roles(script(spark, *steps)).first().failed == 6
    assert lc.unstable_roles(script(spark, *steps[:10])).count() == 0


def test_release_is_not_a_failure_and_happens_once(spark):
    ev = script(spark, ("c", "ALLOCATED", 0), ("c", "STARTED", 1), ("c", "RELEASED", 5), ("c", "RELEASED", 6),
                ("c", "COMPLETED", 9), ("c", "COMPLETED", 10), ("x", "COMPLETED", 11), ("s", "SURPLUS", 12), ("s", "COMPLETED", 13))
    got = {r.seq: r.effect for r in lc.transitions(ev).collect()}
    assert [got[i] for i in range(9)] == ["ASSIGNED", "STARTED", "RELEASING", "RELEASE_ERROR", "RELEASED", "UNKNOWN",
                                          "UNKNOWN", "SURPLUS", "SURPLUS_ENDED"]
    stats = lc.application_statistics(ev).first()
    assert (stats.completed, stats.failed, stats.surplus, stats.unknown_completed) == (3, 0, 1, 2)
    c = cell(ev)
    assert (c.live, c.releasing, c.failed) == (0, 0, 0)


def test_start_errors(spark):
    ev = script(spark, ("c", "STARTED", 0), ("c", "ALLOCATED", 1), ("c", "STARTED", 2), ("c", "STARTED", 3))
    assert {r.seq: r.problem for r in lc.start_errors(ev).collect()} == {
        0: "not an active container", 3: "already started"}


def test_container_state(spark):
    ev = script(spark, ("a", "ALLOCATED", 0), ("b", "ALLOCATED", 0), ("b", "STARTED", 1), ("c", "ALLOCATED", 0),
                ("c", "STARTED", 1), ("c", "COMPLETED", 2))
    got = {r.container_id: (r.state, r.exit_code) for r in lc.container_state(ev).collect()}
    assert got == {"a": (lc.STATE_SUBMITTED, None), "b": (lc.STATE_LIVE, None), "c": (lc.STATE_DESTROYED, 1)}


def test_restart_counts_reported_containers(spark):
    live = spark.createDataFrame([("a", 0, "h", T0), ("b", 0, "h", T0)],
                                 "container_id string, role_id int, host string, ts timestamp_ntz")
    c = p.placement_cells(lc.transitions(lc.rebuild_from_live(live))).first()
    assert (c.live, c.starting) == (2, 0)


def test_scale_plan_skips_excluded(spark):
    roles = spark.createDataFrame([(0, 1, 7, 0, 0, 0), (1, 2, 0, 0, 0, 0), (2, 0, 1, 0, 0, p.EXCLUDE_FROM_FLEXING)],
                                  "role_id int, desired int, actual int, requested int, releasing int, policy int")
    got = lc.scale_plan(roles, cells(spark, *RELEASE)).orderBy("role_id", "step").collect()
    assert [SHORT[r.host] for r in got if r.role_id == 0] == ["A1", "A1", "A1", "A2", "A4", "A1"]
    assert [(r.operation, r.host) for r in got if r.role_id == 1] == [("request", None)] * 2
    assert not [r for r in got if r.role_id == 2]


def test_delta_and_progress(spark):
    roles = spark.createDataFrame([(0, 1, 3, 0, 1), (1, 1, 3, 0, 5), (2, 5, 1, 1, 0)],
                                  "role_id int, desired int, actual int, requested int, releasing int")
    assert {r.role_id: r.delta for r in lc.role_delta(roles).collect()} == {0: -1, 1: 0, 2: 3}
    assert lc.progress(roles).first().progress == 1.0
    assert lc.progress(roles.withColumn("desired", F.lit(0))).first().progress == 100.0


def test_only_reached_cells_are_ranked(spark, monkeypatch):
    """Few hosts are asked for or released: the rest is ruled out by histograms before any ranking."""
    from fleetlens.functions import ordered
    cells = spark.range(20_000).select(
        (F.col("id") % 2).cast("int").alias("role_id"), F.col("id").alias("host"),
        F.when(F.col("id") % 4 < 2, 0).otherwise(F.col("id") % 90 + 1).cast("long").alias("live"), F.lit(0).cast("long").alias("releasing"),
        F.lit(0).cast("long").alias("requested"), F.lit(0).cast("long").alias("starting"),
        F.pmod(F.xxhash64("id"), F.lit(10**6)).alias("last_used"))
    demand = spark.createDataFrame([(0, 40, 300), (1, 30, 200)], "role_id int, k int, n int")
    ranked = []
    real = ordered.rank_in_group

    def spy(df, *rest):
        ranked.append(df.count())
        return real(df, *rest)
    monkeypatch.setattr(ordered, "rank_in_group", spy)
    monkeypatch.setattr(p, "rank_in_group", spy)
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ordered, "HOT_ROWS", 100)
    picked = {(r.role_id, r.slot): r.host for r in p.pick_hosts(cells, demand).collect()}
    released = sorted((r.role_id, r.rank, r.host, r.copy, r.phase) for r in p.release_by_role(cells, demand).collect())
    assert ranked and max(ranked) < 500
    rows = cells.collect()
    for role, k, n in ((0, 40, 300), (1, 30, 200)):
        free = sorted((r for r in rows if r.role_id == role and r.live == 0), key=lambda r: (-r.last_used, r.host))
        assert [picked[role, i + 1] for i in range(k)] == [r.host for r in free[:k]]
        copies = sorted((0 if i < r.live else 1 if r.live == 1 else 2, -r.live, r.host, i)
                        for r in rows if r.role_id == role for i in range(1, r.live + 1))
        assert [x for x in released if x[0] == role] == [(role, i + 1, c[2], c[3], c[0]) for i, c in enumerate(copies[:n])]
