"""Agent heartbeats: sequence checks, component states, commands and host facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.ordered import POS, SEG, join_one, order_segments, previous_in_group
from fleetlens.functions.text import lines_with_ends, strip
from fleetlens.operators.logs import tail_text, without_markup

# fixed values
LABEL_SEPARATOR = "___"
STATES = ("INIT", "INSTALLING", "INSTALLED", "STARTING", "STARTED", "INSTALL_FAILED")
COMMANDS = ("INSTALL", "START")
NO_COMMAND = "NOP"
RESULTS = ("IN_PROGRESS", "COMPLETED", "FAILED")
MAX_FAILURES = 3
IN_PROGRESS_EXIT_CODE = 777
IN_PROGRESS_LINES = 10
LIVE, DEAD = "STARTED", "INSTALLED"

CHUNK_BITS = 14


def split_label(label: Column) -> tuple[Column, Column]:
    """Container and role parts of a label; the role is all after the first separator."""
    at = F.instr(label, LABEL_SEPARATOR)
    container = F.when(at > 0, F.substring(label, F.lit(1), at - 1)).otherwise(label)
    role = F.when(at > 0, F.substring(label, at + len(LABEL_SEPARATOR), F.lit(2147483647)))
    return container, role


def check_registrations(registrations: DataFrame, known: DataFrame) -> DataFrame:
    """OK for labels that are known, FAILED with a message for the others."""
    labels = known.select("label").distinct().withColumn("_known", F.lit(True))
    container, role = split_label(F.col("label"))
    ok = F.col("_known").isNotNull()
    spread = [c for c in registrations.columns if c != "label"] or ["label"]
    return join_one(registrations, labels, ["label"], spread, "left").select(
        "label", container.alias("container_id"), role.alias("role"),
        F.when(ok, "OK").otherwise("FAILED").alias("status"),
        F.when(~ok, "Label not recognized.").alias("log"))


def sequence_breaks(heartbeats: DataFrame) -> DataFrame:
    """Heartbeats whose id is not the previous id of the label plus one.

    ``heartbeats(label, seq, response_id)``; a break makes the agent register again.
    """
    linked = previous_in_group(heartbeats.select("label", "seq", "response_id"), ["label"],
                               [F.col("seq").asc()], {"previous_id": "response_id"})
    return linked.filter(F.col("response_id") != F.col("previous_id") + 1)


def step_state(state: str, failures: int, kind: str, command: str | None,
               result: str | None) -> tuple[str, int, bool]:
    """One move of a component: next state, failures in a row, and whether it was illegal."""
    if kind == "issue":
        allowed = next_command_of(state, failures) or NO_COMMAND
        if command != allowed:
            return state, failures, True
        if command == NO_COMMAND:
            return state, failures, False
        return ("INSTALLING" if command == "INSTALL" else "STARTING"), failures, False
    running = {"INSTALLING": "INSTALL", "STARTING": "START"}.get(state)
    if running is None or (command is not None and command != running) or result not in RESULTS:
        return state, failures, True
    if result == "IN_PROGRESS":
        return state, failures, False
    if result == "COMPLETED":
        return ("INSTALLED" if running == "INSTALL" else "STARTED"), 0, False
    return ("INSTALL_FAILED" if running == "INSTALL" else "INSTALLED"), failures + 1, False


def next_command_of(state: str, failures: int) -> str | None:
    if failures >= MAX_FAILURES:
        return None
    return {"INIT": "INSTALL", "INSTALL_FAILED": "INSTALL", "INSTALLED": "START"}.get(state)


def _situations() -> list[tuple[str, int]]:
    # no command can be issued after the last tolerated failure, so the count stops there
    return [(s, n) for s in STATES for n in range(MAX_FAILURES + 1)]


def _moves() -> list[tuple[str, str | None, str | None]]:
    issues = [("issue", c, None) for c in (*COMMANDS, NO_COMMAND)]
    results = [("result", c, r) for r in RESULTS for c in (*COMMANDS, None)]
    return [*issues, *results, ("bad", None, None)]


def _move_code() -> Column:
    """Index of a report row in ``_moves``; malformed rows are the last one."""
    code = F.lit(len(_moves()) - 1)
    for i, (kind, command, result) in enumerate(_moves()[:-1]):
        match = (F.col("kind") == kind) & F.col("command").eqNullSafe(F.lit(command))
        if kind == "result":
            match = match & F.col("result").eqNullSafe(F.lit(result))
        code = F.when(match, i).otherwise(code)
    return code


def component_state(reports: DataFrame) -> DataFrame:
    """Final state of each component after its ordered commands and results.

    ``reports(label, seq, kind, command, result)`` with kind ``issue`` or ``result``; a
    result without a command belongs to whatever runs. A component has finitely many
    situations (state, failures in a row), so a stretch of reports is summed up by the
    situation it leads to from every start. Stretches are at most 2^14 rows; they are
    chained per partition and then per label, so no label is folded in one place.
    """
    situations = _situations()
    index = {s: i for i, s in enumerate(situations)}
    width = len(situations)
    moved: list[int] = []
    wrong: list[int] = []
    for kind, command, result in _moves():
        for state, failures in situations:
            s, n, bad = (state, failures, True) if kind == "bad" else step_state(
                state, failures, kind, command, result)
            moved.append(index[(s, min(n, MAX_FAILURES))])
            wrong.append(int(bad))
    next_of = F.array(*[F.lit(i) for i in moved])
    bad_of = F.array(*[F.lit(i) for i in wrong])
    every = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.struct(
        i.alias("at"), F.lit(0).cast("long").alias("illegal")))
    only_first = F.slice(every, 1, 1)

    coded = reports.select("label", "seq", _move_code().alias("move"))
    laid = order_segments(coded, ["label"], [F.col("seq").asc()])

    def play(moves: Column, start: Column) -> Column:
        def one(acc: Column, m: Column) -> Column:
            at = lambda s: m["move"] * width + s["at"] + 1
            return F.transform(acc, lambda s: F.struct(
                F.element_at(next_of, at(s)).alias("at"),
                (s["illegal"] + F.element_at(bad_of, at(s))).alias("illegal")))
        return F.aggregate(moves, start, one)

    def chain(pieces: Column) -> Column:
        def one(acc: Column, p: Column) -> Column:
            return F.transform(acc, lambda s: F.struct(
                F.element_at(p["effect"], s["at"] + 1)["at"].alias("at"),
                (s["illegal"] + F.element_at(p["effect"], s["at"] + 1)["illegal"]).alias("illegal")))
        return F.aggregate(pieces, F.slice(every, 1, F.size(pieces[0]["effect"])), one)

    # a stretch that begins inside a chunk is the first of its label, so its start is known;
    # only the one that begins a chunk may be a continuation and needs every start
    begun = F.col("_from").bitwiseAND((1 << CHUNK_BITS) - 1) != 0
    chunk = laid.withColumn("_chunk", F.shiftright(F.col(POS), CHUNK_BITS)).groupBy("label", SEG, "_chunk").agg(
        F.sort_array(F.collect_list(F.struct(POS, "move"))).alias("_m"), F.min(POS).alias("_from"),
        F.count("*").alias("reports"), F.max("seq").alias("last_seq"),
    ).select("label", SEG, "_chunk", "reports", "last_seq",
             play(F.col("_m"), F.when(begun, only_first).otherwise(every)).alias("effect"))

    def level(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.struct(order, "effect"))).alias("_p"),
            F.sum("reports").alias("reports"), F.max("last_seq").alias("last_seq"),
        ).select(*keys, "reports", "last_seq", chain(F.col("_p")).alias("effect"))

    whole = level(level(chunk, ["label", SEG], "_chunk"), ["label"], SEG)
    final = F.element_at("effect", 1)
    names = F.array(*[F.lit(s) for s, _ in situations])
    counts = F.array(*[F.lit(n) for _, n in situations])
    return whole.select(
        "label", F.element_at(names, final["at"] + 1).alias("state"),
        F.element_at(counts, final["at"] + 1).alias("failures"),
        final["illegal"].alias("illegal"), "reports", "last_seq")


def next_command(states: DataFrame, seen: DataFrame | None = None, wait_for: int = 0) -> DataFrame:
    """What to tell each component next.

    ``seen(label, response_id)`` holds the newest heartbeat id; nothing is sent before
    ``wait_for`` is reached.
    """
    if seen is None:
        seen = states.select("label", F.lit(wait_for).alias("response_id"))
    ready = F.coalesce(F.col("response_id") >= wait_for, F.lit(False)) & (F.col("failures") < MAX_FAILURES)
    return states.join(seen.select("label", "response_id"), "label", "left").select(
        "label", "state", "failures",
        F.when(~ready, "NOP").when(F.col("state").isin("INIT", "INSTALL_FAILED"), "INSTALL")
        .when(F.col("state") == "INSTALLED", "START").otherwise("NOP").alias("command"))


def latest_task_status(reports: DataFrame) -> DataFrame:
    """Newest report of each task; an aggregate, so also valid on a stream."""
    rest = [c for c in reports.columns if c not in ("task_id", "seq")]
    newest = F.max_by(F.struct(*rest), "seq").alias("_r")
    return reports.groupBy("task_id").agg(newest, F.max("seq").alias("seq")).select("task_id", "seq", "_r.*")


def drain_reports(reports: DataFrame) -> DataFrame:
    """What the next heartbeat carries, and which tasks are forgotten after it.

    ``reports(task_id, seq, command_type, status, exit_code, stdout)``. A task still in
    progress is sent with exit code 777 and its last output lines, and stays.
    """
    newest = latest_task_status(reports)
    execution = F.col("command_type") == "EXECUTION"
    running = execution & (F.col("status") == "IN_PROGRESS")
    return newest.filter(F.col("command_type").isin("EXECUTION", "STATUS")).select(
        "task_id", F.when(execution, "reports").otherwise("componentStatus").alias("part"), "status",
        F.when(running, IN_PROGRESS_EXIT_CODE).otherwise(F.col("exit_code")).alias("exit_code"),
        F.when(running, without_markup(tail_text(F.col("stdout"), IN_PROGRESS_LINES)))
        .otherwise(F.col("stdout")).alias("stdout"),
        (~running).alias("forgotten"))


def report_status(results: DataFrame) -> DataFrame:
    """COMPLETED for exit code 0, else FAILED; empty output is shown as ``None``."""
    shown = lambda c: F.when(F.col(c) == "", "None").otherwise(F.col(c))
    return results.withColumns({
        "status": F.when(F.col("exit_code") == 0, "COMPLETED").otherwise("FAILED"),
        "stdout": shown("stdout"), "stderr": shown("stderr")})


def mount_fields(line: Column) -> Column:
    """Device, type, size, used, available, percent and mount point; null unless seven fields."""
    parts = F.split(strip(line), r"\s+")
    get = lambda i: F.element_at(parts, i)
    return F.when(F.size(parts) == 7, F.struct(
        get(1).alias("device"), get(2).alias("type"), get(3).try_cast("long").alias("size"),
        get(4).try_cast("long").alias("used"), get(5).try_cast("long").alias("available"),
        get(6).alias("percent"), get(7).alias("mountpoint")))


def mount_inventory(raw: DataFrame) -> DataFrame:
    """Mounts of the newest disk listing of each host; ``raw(host, ts, output)``."""
    newest = raw.groupBy("host").agg(F.max_by("output", "ts").alias("output"))
    lines = newest.select("host", F.explode(lines_with_ends(F.col("output"))).alias("line"))
    return lines.select("host", mount_fields(F.col("line")).alias("m")).filter(
        F.col("m").isNotNull()).select("host", "m.*")


def mount_like_lines(lines: DataFrame) -> DataFrame:
    """Log lines that have the shape of a disk listing line."""
    return lines.select("doc_id", "line_no", mount_fields(F.col("line")).alias("m")).filter(
        F.col("m").isNotNull()).select("doc_id", "line_no", "m.device", "m.mountpoint")


def first_match(text: Column, pattern: str) -> Column:
    """First group of the first match, or empty text."""
    return F.regexp_extract(text, pattern, 1)


def all_matches(text: Column, pattern: str) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), ",")


def kb_to_gb_text(kilobytes: Column) -> Column:
    return F.format_string("%.2f GB", F.round(kilobytes.cast("double") / (1024.0 * 1024.0), 2))


def host_facts(raw: DataFrame, first: dict[str, str], every: dict[str, str]) -> DataFrame:
    """Facts cut out of raw command output by patterns with one group."""
    text = F.col("output")
    return raw.select(
        "host", *[first_match(text, p).alias(n) for n, p in first.items()],
        *[all_matches(text, p).alias(n) for n, p in every.items()])


def live_status(components: DataFrame, kinds: DataFrame, processes: DataFrame) -> DataFrame:
    """Status of each installed component.

    ``components(host, service, component, forced)``; ``kinds(service, component,
    is_client)``; ``processes(host, component, alive)``. A forced status wins, a client
    is never started, anything else is started while its process is alive. Components
    of no known kind have no status.
    """
    alive = processes.groupBy("host", "component").agg(F.max("alive").alias("alive"))
    joined = components.join(kinds, ["service", "component"], "left").join(alive, ["host", "component"], "left")
    return joined.select(
        "host", "service", "component",
        F.when(F.col("forced").isNotNull(), F.col("forced")).when(F.col("is_client"), DEAD)
        .when(F.col("is_client").isNull(), F.lit(None))
        .when(F.coalesce("alive", F.lit(False)), LIVE).otherwise(DEAD).alias("status"))


def latest_profile(registrations: DataFrame) -> DataFrame:
    """Newest registration of each host; an aggregate, so also valid on a stream."""
    rest = [c for c in registrations.columns if c != "hostname"]
    return registrations.groupBy("hostname").agg(
        F.max_by(F.struct(*rest), "timestamp").alias("_r")).select("hostname", "_r.*")


