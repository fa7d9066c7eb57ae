"""Status documents: golden case and parse-back."""

import json

from fleetlens.operators import lifecycle, status

STATE = ("container_id string, role_id int, host long, state int, released boolean, create_ts timestamp_ntz, "
         "start_ts timestamp_ntz, exit_code int, diagnostics string")


def frames(spark):
    import datetime as dt
    at = dt.datetime(1970, 1, 1, 0, 0, 1, 500_999)
    state = spark.createDataFrame([(f"c{i}", 1, i, 3, i == 2, at, None, None, None) for i in range(5)]
                                  + [("gone", 1, 9, 5, False, at, at, 3, "bye"), ("b0", 2, 7, 1, False, at, at, 1, 'say "x"')], STATE)
    stats = spark.createDataFrame([(r, 1, 2, 3, 4, 5, 6, 7, 8) for r in (1, 2, 3)], "role_id int, " + ", ".join(
        f"{c} long" for c in status.STATISTIC_KEYS))
    roles = spark.createDataFrame([(1, "worker"), (2, "master"), (3, "idle")], "role_id int, name string")
    counters = spark.createDataFrame([], "role_id int, " + ", ".join(
        f"{c} long" for c in "completions failed start_events failed_starts surplus unknown_completed".split()))
    return state, stats, roles, lifecycle.application_statistics(None, counters)


def test_status_document(spark):
    state, stats, roles, app = frames(spark)
    docs = status.status_document(state, stats, roles, app, {"a": "1", "b": "2"}, {"b": "not this", "c": "3"}, page=2)
    got = {(r.role_id, r.page): json.loads(r.json) for r in docs.collect()}
    assert sorted(got, key=str) == sorted([(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (None, 0)], key=str)
    assert got[1, 0]["role"] == {"name": "worker", "desired": 3, "actual": 5, "requested": 1, "releasing": 1, "failed": 4, "start_failed": 8}
    assert got[1, 0]["statistics"]["containers.requested"] == 6
    assert [got[1, p]["instances"] for p in range(3)] == [["c0", "c1"], ["c2", "c3"], ["c4"]]
    assert got[1, 1]["live"]["c2"] == {"host": 2, "state": 3, "released": True, "create_time": 1500}
    assert "role" not in got[1, 1] and got[2, 0]["live"]["b0"]["diagnostics"] == 'say "x"'
    assert got[3, 0]["role"]["actual"] == 0 and "live" not in got[3, 0]
    assert got[None, 0] == {"info": {"a": "1", "b": "2", "c": "3"}, "statistics": {
        **dict.fromkeys(status.APPLICATION_KEYS.values(), 0), "containers.live": 6}}


def test_documents_are_read_back(spark):
    state, stats, roles, app = frames(spark)
    docs = status.status_document(state, stats, roles, app, {"a": "1"}, page=2)
    records = sorted(tuple(r) for r in status.status_records(docs).collect())
    assert records == sorted([(1, f"c{i}", str(i), 3, i == 2, 1500, None, None, None) for i in range(5)]
                             + [(2, "b0", "7", 1, False, 1500, 1500, 1, 'say "x"')])
    entries = [tuple(r) for r in status.status_entries(docs).collect()]
    assert len(entries) == 3 * (7 + 8) + 7 + 1
    assert (None, "info", "a", "1") in entries and (2, "role", "name", "master") in entries


def test_empty_page_and_null_id(spark):
    state = spark.createDataFrame([(None, 1, 1, 3, False, None, None, None, None), ("a", None, 1, 3, False, None, None, None, None)], STATE)
    got = lifecycle.instance_records(state, 10).collect()
    assert [(r.role_id, r.page, [x.container_id for x in r.records]) for r in got] == [(None, 0, ["a"])]
