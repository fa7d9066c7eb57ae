import pytest
from pyspark.sql import functions as F

from fleetlens.operators import agents as a
from fleetlens.operators import health as h
from fleetlens.operators import logs

REPORT = "label string, seq bigint, kind string, command string, result string"
ISSUE, DONE, BUSY, FAIL = "issue", "COMPLETED", "IN_PROGRESS", "FAILED"


def reports(spark, *steps):
    rows = [("c", i, "issue", cmd, None) if what == ISSUE else ("c", i, "result", cmd, what)
            for i, (what, cmd) in enumerate(steps)]
    return spark.createDataFrame(rows, REPORT)


I, S = "INSTALL", "START"
CASES = [
    ([(ISSUE, I), (BUSY, I), (DONE, I), (ISSUE, S), (BUSY, S), (DONE, S)], ("STARTED", 0, 0), "NOP"),
    ([(ISSUE, I), (FAIL, I)], ("INSTALL_FAILED", 1, 0), "INSTALL"),
    ([(ISSUE, I), (FAIL, I), (ISSUE, I), (DONE, I), (ISSUE, S), (FAIL, S)], ("INSTALLED", 1, 0), "START"),
    ([(ISSUE, I), (FAIL, I), (ISSUE, I), (DONE, I), (ISSUE, S), (FAIL, S), (ISSUE, S), (DONE, S)], ("STARTED", 0, 0), "NOP"),
    ([(ISSUE, I), (FAIL, I)] * 3, ("INSTALL_FAILED", 3, 0), "NOP"),
    ([(ISSUE, I), (FAIL, I)] * 2 + [(ISSUE, I), (DONE, I)] + [(ISSUE, S), (FAIL, S)] * 2, ("INSTALLED", 2, 0), "START"),
    ([(ISSUE, S), (DONE, I), (ISSUE, I), (ISSUE, I), (DONE, S), (DONE, None)], ("INSTALLED", 0, 4), "START"),
    ([(ISSUE, I), (FAIL, I)] * 3 + [(ISSUE, I)], ("INSTALL_FAILED", 3, 1), "NOP"),
]


@pytest.mark.parametrize("steps, final, command", CASES)
def test_component(spark, steps, final, command):
    states = a.component_state(reports(spark, *steps))
    r = states.first()
    assert (r.state, r.failures, r.illegal) == final
    assert a.next_command(states).first().command == command


def test_component_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(a, "CHUNK_BITS", 3)
    steps = [s for steps, _, _ in CASES for s in steps] * 5
    df = reports(spark, *steps).repartition(5)
    state, failures, illegal = "INIT", 0, 0
    for what, cmd in steps:
        state, failures, bad = a.step_state(state, failures, "issue" if what == ISSUE else "result", cmd,
                                            None if what == ISSUE else what)
        illegal += bad
    r = a.component_state(df).first()
    assert (r.state, r.failures, r.illegal, r.reports) == (state, failures, illegal, len(steps))


def test_wait_for_heartbeats(spark):
    states = spark.createDataFrame([("c", "INIT", 0)], "label string, state string, failures int")
    seen = spark.createDataFrame([("c", 1)], "label string, response_id int")
    assert a.next_command(states, seen, 2).first().command == "NOP"
    assert a.next_command(states, seen, 1).first().command == "INSTALL"


def test_labels(spark):
    regs = spark.createDataFrame([("c1___master",), ("c2___a___b",), ("odd",)], "label string")
    known = spark.createDataFrame([("c1___master",), ("c1___master",)], "label string")
    got = {r.label: (r.container_id, r.role, r.status, r.log) for r in a.check_registrations(regs, known).collect()}
    assert got == {"c1___master": ("c1", "master", "OK", None),
                   "c2___a___b": ("c2", "a___b", "FAILED", "Label not recognized."),
                   "odd": ("odd", None, "FAILED", "Label not recognized.")}


def test_sequence(spark):
    df = spark.createDataFrame([("l", 1, 1), ("l", 2, 2), ("l", 3, 4), ("m", 1, 9)], "label string, seq int, response_id int")
    assert [(r.response_id, r.previous_id) for r in a.sequence_breaks(df).collect()] == [(4, 2)]


def test_drain(spark):
    text = "\n".join(f"\x1b[0;36mline {i}\x1b[0m" for i in range(12))
    df = spark.createDataFrame([
        (1, 1, "EXECUTION", "IN_PROGRESS", None, text), (2, 2, "EXECUTION", "IN_PROGRESS", None, "x"),
        (2, 3, "EXECUTION", "FAILED", 5, "y"), (3, 4, "STATUS", "IN_PROGRESS", 0, "z")],
        "task_id int, seq int, command_type string, status string, exit_code int, stdout string")
    got = {r.task_id: (r.part, r.exit_code, r.stdout, r.forgotten) for r in a.drain_reports(df).collect()}
    assert got[1] == ("reports", 777, "\n".join(f"line {i}" for i in range(2, 12)), False)
    assert got[2] == ("reports", 5, "y", True)
    assert got[3] == ("componentStatus", 0, "z", True)


def test_mounts(spark):
    out = "Filesystem Type Size Used Avail Use% Mounted on\n/dev/sda1 ext4 100 40 60 40% /\nshort line\ntmpfs tmpfs x 0 5 0% /run\n"
    df = spark.createDataFrame([("h", 1, "a b c d e f g"), ("h", 2, out)], "host string, ts int, output string")
    got = sorted(map(tuple, a.mount_inventory(df).collect()), key=repr)
    assert got == [("h", "/dev/sda1", "ext4", 100, 40, 60, "40%", "/"), ("h", "tmpfs", "tmpfs", None, 0, 5, "0%", "/run")]


def test_facts(spark):
    df = spark.createDataFrame([("h", "eth0 Link encap:Ethernet\n inet addr:10.0.0.1\nlo Link encap:Local")], "host string, output string")
    r = a.host_facts(df, {"ip": r"(?: inet addr:)(\d+\.\d+\.\d+\.\d+)", "mask": r"Mask:(\d+)"},
                     {"interfaces": r"(\w+)(?:.*Link encap:)"}).first()
    assert (r.ip, r.mask, r.interfaces) == ("10.0.0.1", "", "eth0,lo")
    assert df.select(a.kb_to_gb_text(F.lit("1572864"))).first()[0] == "1.50 GB"


GOOD = "\n".join(["debug: one", "info: two", "debug: three", "notice: four", "debug: five"])
BAD = "\n".join(["debug: one", "info: two", "debug: Executing", "err: failed", "debug: after", "debug: later", "notice: done"])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("good", f"\n{GOOD}\n"), ("bad", BAD), ("empty", ""), ("none", None)], "doc_id string, text string")


def col(df, name):
    return {r.doc_id: r[name] for r in df.collect()}


def test_grep(docs):
    got = col(logs.grep_context(docs, "Err", 2, 2), "fragment")
    assert got == {"good": None, "empty": None, "none": None, "bad": "\n".join(BAD.split("\n")[1:6])}
    assert col(logs.grep_context(docs, "err", 1000, 1000), "fragment")["bad"] == BAD
    assert col(logs.grep_context(docs, "debug", 3, 0), "fragment")["bad"] == "debug: one"


def test_tail(docs):
    assert col(logs.tail_lines(docs, 2), "tail") == {"good": "notice: four\ndebug: five", "empty": "", "none": None,
                                                     "bad": "debug: later\nnotice: done"}
    assert col(logs.tail_lines(docs, 1000), "tail")["good"] == GOOD


def test_drop(docs):
    assert col(logs.drop_lines(docs, "DEBUG"), "text") == {
        "good": "info: two\nnotice: four", "bad": "info: two\nerr: failed\nnotice: done", "empty": "", "none": None}


def test_line_ends(spark):
    df = spark.createDataFrame([("d", "a\r\nb\rc\n\nd")], "doc_id string, text string")
    assert [(r.line_no, r.line) for r in logs.log_lines(df).collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, ""), (4, "d")]
    assert logs.tail_lines(df, 4).first().tail == "b\rc\n\nd"


def test_markup(spark):
    df = spark.createDataFrame([("d", "\x1b[0;36mnotice: created\x1b[0m")], "doc_id string, text string")
    assert logs.strip_markup(df).first().text == "notice: created"


def test_status_and_live(spark):
    res = spark.createDataFrame([(0, "", "e"), (2, "o", "")], "exit_code int, stdout string, stderr string")
    assert sorted(map(tuple, a.report_status(res).collect())) == [(0, "None", "e", "COMPLETED"), (2, "o", "None", "FAILED")]
    comps = spark.createDataFrame([("h", "s", c, f) for c, f in [("x", "DOWN"), ("cl", None), ("up", None), ("dead", None), ("?", None)]],
                                  "host string, service string, component string, forced string")
    kinds = spark.createDataFrame([("s", "cl", True), ("s", "up", False), ("s", "dead", False)], "service string, component string, is_client boolean")
    procs = spark.createDataFrame([("h", "up", True), ("h", "cl", True)], "host string, component string, alive boolean")
    assert {r.component: r.status for r in a.live_status(comps, kinds, procs).collect()} == {
        "x": "DOWN", "cl": "INSTALLED", "up": "STARTED", "dead": "INSTALLED", "?": None}


# --- health ---

PROBE = "service int, cycle bigint, seq bigint, ts timestamp_ntz, probe int, kind string, success boolean, message string"


def probes(spark, *cycles):
    """Cycles of (kind, probe, success) lists, one minute apart."""
    import datetime as dt
    rows, seq = [], 0
    for n, cycle in enumerate(cycles):
        for kind, probe, ok in cycle:
            rows.append((0, n, seq, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n, seconds=seq % 5), probe,
                         "dependency" if kind == "d" else "monitor", ok, f"m{seq}"))
            seq += 1
    return spark.createDataFrame(rows, PROBE)


def phases(df, ms=10**9):
    return [(r.phase, r.booted) for r in h.label_phases(df, ms).orderBy("seq").collect()]


def test_phase_walk(spark):
    df = probes(spark, [("d", 0, False)], [("d", 0, True)], [("m", 1, True), ("m", 2, False)],
                [("m", 1, True), ("m", 2, True)], [("m", 1, False), ("m", 2, True)], [("m", 1, True)])
    assert phases(df) == [("DEPENDENCY_CHECKING", False)] * 2 + [
        ("BOOTSTRAPPING", False), ("BOOTSTRAPPING", False), ("BOOTSTRAPPING", True), ("BOOTSTRAPPING", False),
        ("LIVE", True), ("TERMINATING", True), ("TERMINATING", True)]
    out = h.reported_outcome(h.label_phases(df, 10**9)).orderBy("seq").collect()
    assert [(r.success, r.real_outcome) for r in out] == [
        (True, False), (True, True), (True, True), (True, False), (True, True), (True, True), (False, False)]
    assert h.probe_phase(df, 10**9).first().phase == "TERMINATING"


def test_booted_probe_failing_ends_bootstrap(spark):
    df = probes(spark, [("d", 0, True)], [("m", 1, True), ("m", 2, False)], [("m", 1, False), ("m", 2, True)], [("m", 1, True)])
    assert [p for p, _ in phases(df)][-3:] == ["BOOTSTRAPPING", "TERMINATING", "TERMINATING"]


def test_bootstrap_times_out(spark):
    df = probes(spark, [("d", 0, True)], [("m", 1, False)], [("m", 1, False)], [("m", 1, False)])
    assert [p for p, _ in phases(df, 150_000)] == ["DEPENDENCY_CHECKING", "BOOTSTRAPPING", "BOOTSTRAPPING", "TERMINATING"]
    got = h.bootstrap_timeout(df, 150_000).first()
    assert (got.missing, got.last_probe, got.last_message) == (1, 1, "m2")


def test_no_bootstrap_and_no_dependencies(spark):
    df = probes(spark, [("d", 0, True)], [("m", 1, True)])
    assert [p for p, _ in phases(df, 0)] == ["DEPENDENCY_CHECKING", "LIVE"]
    df = probes(spark, [("m", 1, True)], [("m", 1, True)], [("m", 1, True)])
    assert [p for p, _ in phases(df)] == ["DEPENDENCY_CHECKING", "BOOTSTRAPPING", "LIVE"]


def test_phases_ignore_hot_limit(spark, monkeypatch):
    from fleetlens.functions import ordered
    df = probes(spark, *[[("d", 0, i > 1), ("m", i % 3, i % 4 != 3)] for i in range(40)])
    want = phases(df)
    real = ordered.join_counted
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(h, "join_counted", lambda *x, **k: real(*x, **{**k, "hot_rows": 3}))
    assert phases(df) == want


def test_hot_dependency_probe_has_shares(spark):
    """The table that the rows are joined to knows how many rows each dependency probe has."""
    df = probes(spark, *[[("d", 0, True), ("d", 0, True), ("m", 1, True)] for _ in range(20)])
    marks = h._probe_marks(df, h._service_milestones(df, 60_000))
    assert sorted((r.probe, r.probe_rows, r.monitor_rows) for r in marks.collect()) == [(0, 40, 0), (1, 20, 20)]


def test_silence(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, i, t + dt.timedelta(seconds=s), ph) for i, (s, ph) in enumerate([
        (0, "LIVE"), (59, "LIVE"), (119, "DEPENDENCY_CHECKING"), (900, "BOOTSTRAPPING"), (990, "LIVE")])],
        "key int, seq int, ts timestamp_ntz, phase string")
    assert [r.seq for r in h.silence_alerts(df, 60_000, -1).collect()] == [1]
    assert sorted(r.seq for r in h.silence_alerts(df, 60_000, 90_000, t + dt.timedelta(hours=1)).collect()) == [1, 3, 4]


def test_http_and_text(spark):
    df = spark.createDataFrame([(200,), (299,), (300,), (None,)], "code int")
    assert [r.success for r in h.http_outcome(df).collect()] == [True, True, False, False]
    ms = spark.createDataFrame([(0,), (1500,), (-1500,), (7,)], "ms bigint").select(h.human_millis(F.col("ms")).alias("t"))
    assert [r.t for r in ms.collect()] == ["0", "1.500s", "-1.500s", "0.007s"]
    line = spark.sql("select 1 service, 2 probe, 3 seq, timestamp'2024-01-01 00:00:00' ts, 'LIVE' phase, true success, "
                     "false real_outcome, cast(null as string) message")
    assert h.health_log_line(line).first().line == (
        'Probe Status, time="2024-01-01 00:00:00", phase="LIVE", outcome="success", originaloutcome="failure", message=null')


@pytest.mark.parametrize("state, failures, illegal", [
    ("INIT", 0, True), ("INIT", 3, False), ("INSTALLING", 0, False), ("STARTED", 0, False), ("INSTALLED", 1, True), ("INSTALL_FAILED", 2, True)])
def test_no_command_is_legal_when_expected(state, failures, illegal):
    assert a.step_state(state, failures, "issue", "NOP", None) == (state, failures, illegal)
