"""Keyed, time-ordered folds for streams.

Rows of a key are held back until the watermark has passed them, then folded in ``seq``
order, so a stream gives the batch result for any arrival order within the allowed
delay. Waiting rows lie in map state under their time slot and the call that brought them;
a call writes what it brings, reads the slots that are due and touches no others, so its
cost does not depend on the rows that still wait. What is remembered is a small fixed
state, which ends ``retention_ms`` after the last row of a key that has nothing open.
Spark partitions by key, keeps the state and handles recovery.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from fleetlens.operators.agents import MAX_FAILURES, next_command_of, step_state

DAY_MS = 86_400_000
RETENTION_MS = 7 * DAY_MS
SLOT_MS = 10_000
_CASTS = {"bigint": int, "int": int, "string": str, "boolean": bool}


def _fields(schema: str) -> list[tuple[str, type]]:
    return [(n, _CASTS[t]) for n, t in (part.split() for part in schema.split(","))]


class OrderedFold(StatefulProcessor):
    """Base class: subclasses give schemas and ``start``, ``step`` and ``settle``.

    ``row_schema`` must contain ``seq`` and ``at_ms`` (event time in milliseconds). Rows are
    folded when their whole slot of ``slot_ms`` lies behind the watermark. With
    ``retention_ms`` (None: never) a key is forgotten that long after its last row in event
    time, unless ``is_open`` says that something is still expected of it.
    """

    key_schema: str
    row_schema: str
    memory_schema: str
    output_schema: str
    slot_ms = SLOT_MS
    retention_ms: int | None = RETENTION_MS

    def start(self) -> dict:
        raise NotImplementedError

    def step(self, memory: dict, row: dict) -> list[dict]:
        """Change ``memory`` by one row and return output rows."""
        raise NotImplementedError

    def settle(self, memory: dict, now: int) -> list[dict]:
        """Output after the rows of one call; all rows before ``now`` are folded."""
        return []

    def wake_at(self, memory: dict) -> int | None:
        """Another time at which ``settle`` should be called."""
        return None

    def is_open(self, memory: dict) -> bool:
        """Whether the key must be remembered however long nothing comes."""
        return False

    def forget(self) -> None:
        """Clear further state of a key that ends."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot bigint,part bigint", "rows string")
        self.slots = handle.getValueState("slots", "parts string")  # {slot: parts in it}, one entry per waiting slot
        self.memory = handle.getValueState("memory", self.memory_schema + ",touched_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fields = _fields(self.row_schema)
        at = [n for n, _ in fields].index("at_ms")
        brought: dict[int, list] = {}
        for pdf in rows:
            for r in pdf[[n for n, _ in fields]].itertuples(index=False, name=None):
                plain = [None if pd.isna(x) else cast(x) for x, (_, cast) in zip(r, fields)]
                brought.setdefault(plain[at] // self.slot_ms, []).append(plain)
        parts = self._parts()
        for slot, some in brought.items():
            n = parts.get(slot, 0)
            self.waiting.updateValue((slot, n), (json.dumps(some),))
            parts[slot] = n + 1
        return self._advance(key, timerValues.getCurrentWatermarkInMs(), parts, bool(brought))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._advance(key, timerValues.getCurrentWatermarkInMs(), self._parts(), False)

    def close(self) -> None:
        pass

    def _parts(self) -> dict[int, int]:
        return {int(s): n for s, n in json.loads(self.slots.get()[0]).items()} if self.slots.exists() else {}

    def _due(self, parts: dict[int, int], before: int) -> list[dict]:
        """Rows of all slots before ``before``, which leave the state."""
        names = [n for n, _ in _fields(self.row_schema)]
        due = []
        for slot in [s for s in parts if s < before]:
            for n in range(parts.pop(slot)):
                due += [dict(zip(names, r)) for r in json.loads(self.waiting.getValue((slot, n))[0])]
                self.waiting.removeKey((slot, n))
        return sorted(due, key=lambda r: r["seq"])

    def _advance(self, key, watermark: int, parts: dict[int, int], brought: bool) -> Iterator[pd.DataFrame]:
        current = watermark // self.slot_ms
        now = current * self.slot_ms
        due = self._due(parts, current)
        names = [n for n, _ in _fields(self.memory_schema)] + ["touched_ms"]
        known = self.memory.exists()
        memory = dict(zip(names, self.memory.get())) if known else {**self.start(), "touched_ms": None}
        out: list[dict] = []
        for row in due:
            out += self.step(memory, row)
            memory["touched_ms"] = max(row["at_ms"], memory["touched_ms"] or row["at_ms"])
        out += self.settle(memory, now)
        ends = None
        if (known or due) and self.retention_ms is not None and not self.is_open(memory):
            ends = memory["touched_ms"] + self.retention_ms
        if ends is not None and ends < now and not parts:
            self.memory.clear()
            self.forget()
            ends = None
        elif known or due:
            self.memory.update(tuple(memory[n] for n in names))
        if brought or due:
            if parts:
                self.slots.update((json.dumps(parts),))
            else:
                self.slots.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        # timers stand at the end of a slot, when ``now`` has reached the time they wait for
        wakes = [(min(parts) + 1) * self.slot_ms] if parts else []
        for extra in (self.wake_at(memory) if known or due else None, ends):
            if extra is not None and extra >= now:
                wakes.append((extra // self.slot_ms + 1) * self.slot_ms)
        if wakes:
            self.handle.registerTimer(min(wakes))
        keyed = dict(zip([n for n, _ in _fields(self.key_schema)], key))
        columns = [n for n, _ in _fields(self.output_schema)]
        if out:
            frame = {c: [keyed.get(c, r.get(c)) for r in out] for c in columns}
            yield pd.DataFrame({c: pd.Series(x, dtype=object) for c, x in frame.items()})


class ContainerFold(OrderedFold):
    """Effect of each life-cycle event, as in ``lifecycle.transitions``."""

    key_schema = "container_id string"
    row_schema = "event string,role_id int,host bigint,seq bigint,at_ms bigint"
    memory_schema = ("allocated boolean,surplus boolean,started_ms bigint,start_failed boolean,"
                     "releasing boolean,outcome string")
    output_schema = "container_id string,role_id int,host bigint,seq bigint,at_ms bigint,effect string,gone boolean"

    def __init__(self, short_lived_ms: int):
        self.short_lived_ms = short_lived_ms

    def start(self) -> dict:
        return {"allocated": False, "surplus": False, "started_ms": None, "start_failed": False,
                "releasing": False, "outcome": None}

    def step(self, m: dict, row: dict) -> list[dict]:
        event, active = row["event"], m["allocated"] and m["outcome"] is None and not m["start_failed"]
        effect, gone = "IGNORED", False
        if event == "ALLOCATED" and not m["allocated"]:
            m["allocated"], effect = True, "ASSIGNED"
        elif event == "SURPLUS" and not m["surplus"]:
            m["surplus"], effect = True, "SURPLUS"
        elif event == "STARTED":
            effect = "START_ERROR"
            if active and m["started_ms"] is None:
                m["started_ms"], effect = row["at_ms"], "STARTED"
        elif event == "START_FAILED" and active and m["started_ms"] is None:
            m["start_failed"], effect = True, "START_FAILED"
        elif event == "RELEASED":
            effect = "RELEASE_ERROR"
            if active and not m["releasing"]:
                m["releasing"], effect = True, "RELEASING"
        elif event == "COMPLETED":
            before = m["outcome"]
            effect = self._complete(m, row["at_ms"])
            gone = m["allocated"] and before is None and m["outcome"] is not None
        return [{**row, "effect": effect, "gone": gone}]

    def is_open(self, m: dict) -> bool:
        return m["allocated"] and m["outcome"] is None and not m["start_failed"]

    def _complete(self, m: dict, at_ms: int) -> str:
        if m["outcome"] is None and (m["allocated"] or m["surplus"]):
            m["outcome"] = "released" if m["releasing"] else "surplus" if m["surplus"] else "failed"
            kind = m["outcome"]
        elif m["outcome"] == "failed" or (m["outcome"] is not None and m["start_failed"]):
            kind = "failed"
        else:
            kind = "unknown"
        if kind != "failed":
            return {"released": "RELEASED", "surplus": "SURPLUS_ENDED", "unknown": "UNKNOWN"}[kind]
        short = m["started_ms"] is None or at_ms - m["started_ms"] < self.short_lived_ms
        return "FAILED_SHORT" if short else "FAILED"


class CellFold(OrderedFold):
    """Counters of one (role_id, host) cell, as in ``placement.placement_cells``.

    ``seq`` is the last transition counted; the row with the highest one is the newest. A free
    cell that is not used for the retention time is forgotten, as ``placement.purge_cells`` does.
    """

    key_schema = "role_id int,host bigint"
    row_schema = "effect string,seq bigint,at_ms bigint"
    memory_schema = ("starting bigint,start_failed bigint,failed bigint,live bigint,releasing bigint,"
                     "last_used_ms bigint,seq bigint,moved boolean")
    output_schema = ("role_id int,host bigint,starting bigint,start_failed bigint,failed bigint,live bigint,"
                     "releasing bigint,last_used_ms bigint,seq bigint")

    def start(self) -> dict:
        return {"starting": 0, "start_failed": 0, "failed": 0, "live": 0, "releasing": 0,
                "last_used_ms": None, "seq": None, "moved": False}

    def step(self, m: dict, row: dict) -> list[dict]:
        def add(name: str, by: int) -> None:
            m[name] = max(0, m[name] + by)

        effect = row["effect"]
        if effect == "ASSIGNED":
            add("starting", 1)
        elif effect == "STARTED":
            add("starting", -1)
            add("live", 1)
        elif effect == "RELEASING":
            add("releasing", 1)
        elif effect in ("START_FAILED", "FAILED_SHORT"):
            add("starting", -1)
            add("start_failed", 1)
            add("failed", 1)
        elif effect in ("RELEASED", "FAILED"):
            add("releasing", -1 if effect == "RELEASED" else 0)
            add("failed", 1 if effect == "FAILED" else 0)
            add("live", -1)
            if m["live"] == m["releasing"] and m["starting"] == 0:
                m["last_used_ms"] = row["at_ms"]
        else:
            return []
        m["seq"], m["moved"] = row["seq"], True
        return []

    def is_open(self, m: dict) -> bool:
        return m["starting"] > 0 or m["live"] != m["releasing"]

    def settle(self, m: dict, now: int) -> list[dict]:
        moved, m["moved"] = m["moved"], False
        return [dict(m)] if moved else []


class SequenceFold(OrderedFold):
    """Heartbeats whose id does not follow the one before, as in ``agents.sequence_breaks``.

    An agent that is silent for the retention time is forgotten; its next id breaks nothing.
    """

    key_schema = "label string"
    row_schema = "response_id bigint,seq bigint,at_ms bigint"
    memory_schema = "previous_id bigint"
    output_schema = "label string,seq bigint,response_id bigint,previous_id bigint"

    def start(self) -> dict:
        return {"previous_id": None}

    def step(self, m: dict, row: dict) -> list[dict]:
        before, m["previous_id"] = m["previous_id"], row["response_id"]
        if before is None or row["response_id"] is None or row["response_id"] == before + 1:
            return []
        return [{**row, "previous_id": before}]


class ComponentFold(OrderedFold):
    """State of one component, as in ``agents.component_state``."""

    key_schema = "label string"
    row_schema = "kind string,command string,result string,seq bigint,at_ms bigint"
    memory_schema = "state string,failures int,illegal bigint,reports bigint,last_seq bigint,moved boolean"
    output_schema = "label string,state string,failures int,illegal bigint,reports bigint,last_seq bigint,command string"

    def start(self) -> dict:
        return {"state": "INIT", "failures": 0, "illegal": 0, "reports": 0, "last_seq": None, "moved": False}

    def step(self, m: dict, row: dict) -> list[dict]:
        m["state"], m["failures"], bad = step_state(
            m["state"], m["failures"], row["kind"], row["command"], row["result"])
        m["failures"] = min(m["failures"], MAX_FAILURES)
        m["illegal"] += bad
        m["reports"] += 1
        m["last_seq"], m["moved"] = row["seq"], True
        return []

    def settle(self, m: dict, now: int) -> list[dict]:
        moved, m["moved"] = m["moved"], False
        return [{**m, "command": next_command_of(m["state"], m["failures"]) or "NOP"}] if moved else []


class SilenceFold(OrderedFold):
    """Statuses followed by too long a silence; raised once, by the next status or by the watermark."""

    key_schema = "key bigint"
    row_schema = "phase string,seq bigint,at_ms bigint"
    memory_schema = "phase string,seq bigint,at_ms bigint,told boolean"
    output_schema = "key bigint,phase string,seq bigint,at_ms bigint"

    def __init__(self, probe_timeout_ms: int, bootstrap_timeout_ms: int):
        self.limits = {"LIVE": probe_timeout_ms}
        if bootstrap_timeout_ms >= 0:
            self.limits["BOOTSTRAPPING"] = bootstrap_timeout_ms

    def start(self) -> dict:
        return {"phase": None, "seq": None, "at_ms": None, "told": False}

    def wake_at(self, m: dict) -> int | None:
        limit = self.limits.get(m["phase"])
        return None if limit is None or m["told"] else m["at_ms"] + limit

    def is_open(self, m: dict) -> bool:
        return self.wake_at(m) is not None

    def settle(self, m: dict, now: int) -> list[dict]:
        due = self.wake_at(m)
        if due is None or now < due:
            return []
        m["told"] = True
        return [dict(m)]

    def step(self, m: dict, row: dict) -> list[dict]:
        alert = self.settle(m, row["at_ms"])
        m.update(phase=row["phase"], seq=row["seq"], at_ms=row["at_ms"], told=False)
        return alert


class PhaseFold(OrderedFold):
    """Phase of each status of a service, as in ``health.label_phases``.

    A round is complete when the next one begins. Services without dependencies need
    ``has_dependencies=False``, which a stream cannot find out by itself. The booted
    probes of a service are kept as one map, bounded by its number of probes.
    """

    key_schema = "service bigint"
    row_schema = "cycle bigint,probe bigint,kind string,success boolean,seq bigint,at_ms bigint"
    memory_schema = ("phase string,cycle bigint,end_ms bigint,ran bigint,failed bigint,boot_start_ms bigint,"
                     "fatal boolean")
    output_schema = "service bigint,probe bigint,seq bigint,phase string,booted boolean"

    def __init__(self, bootstrap_ms: int, has_dependencies: bool = True):
        self.bootstrap_ms, self.has_dependencies = bootstrap_ms, has_dependencies

    def init(self, handle) -> None:
        super().init(handle)
        self.booted = handle.getMapState("booted", "probe bigint", "seq bigint")

    def forget(self) -> None:
        self.booted.clear()

    def start(self) -> dict:
        return {"phase": "DEPENDENCY_CHECKING", "cycle": None, "end_ms": None, "ran": 0, "failed": 0,
                "boot_start_ms": None, "fatal": False}

    def step(self, m: dict, row: dict) -> list[dict]:
        if row["cycle"] != m["cycle"]:
            self._next_round(m, row)
        watched = "dependency" if m["phase"] == "DEPENDENCY_CHECKING" else "monitor"
        if row["kind"] == watched:
            m["ran"] += 1
            m["failed"] += not row["success"]
        m["end_ms"] = row["at_ms"]
        monitor, key = row["kind"] == "monitor", (row["probe"],)
        booted = monitor and self.booted.containsKey(key)
        if monitor and row["success"] and not booted and m["boot_start_ms"] is not None:
            self.booted.updateValue(key, (row["seq"],))
        phase = "TERMINATING" if m["fatal"] else m["phase"]
        if monitor and not row["success"] and (
                m["phase"] == "LIVE" or (m["phase"] == "BOOTSTRAPPING" and booted)):
            m["fatal"] = True
        return [{"probe": row["probe"], "seq": row["seq"], "phase": phase, "booted": booted}]

    def _next_round(self, m: dict, row: dict) -> None:
        clean = m["cycle"] is not None and m["failed"] == 0
        if m["phase"] == "DEPENDENCY_CHECKING" and clean and (m["ran"] > 0 or not self.has_dependencies):
            m["phase"], m["boot_start_ms"] = "BOOTSTRAPPING", m["end_ms"]
            if self.bootstrap_ms <= 0:
                m["phase"] = "LIVE"
        elif m["phase"] == "BOOTSTRAPPING" and clean and m["ran"] > 0:
            m["phase"] = "LIVE"
        if m["phase"] == "BOOTSTRAPPING" and row["at_ms"] > m["boot_start_ms"] + self.bootstrap_ms:
            m["fatal"] = True
        m.update(cycle=row["cycle"], ran=0, failed=0)


class ReportDrain(StatefulProcessor):
    """Newest report of each task, sent with every trigger that has one.

    A finished or status report is sent once; its number is remembered, so that older reports that
    come late are dropped. A running one is sent again every ``resend_ms`` until something newer
    comes. With ``retention_ms`` a task is forgotten that long after its last report: in event time
    if the rows have ``at_ms``, else by the clock, for which a running task counts as long as it is sent.
    """

    memory_schema = "seq bigint,command_type string,status string,exit_code int,stdout string"
    columns = [n for n, _ in _fields(memory_schema)]
    output_schema = "task_id bigint," + memory_schema

    def __init__(self, resend_ms: int | None, retention_ms: int | None, event_time: bool):
        self.resend_ms, self.retention_ms, self.event_time = resend_ms, retention_ms, event_time

    def init(self, handle) -> None:
        self.handle = handle
        by_clock = self.retention_ms and not self.event_time
        self.held = handle.getValueState("held", self.memory_schema, *([self.retention_ms] if by_clock else []))

    @staticmethod
    def _running(report: tuple) -> bool:
        return report[1] == "EXECUTION" and report[2] == "IN_PROGRESS"

    def _send(self, key, report: tuple) -> pd.DataFrame:
        return pd.DataFrame([[key[0], *report]], columns=["task_id", *self.columns]).astype(object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tops = [pdf.loc[pdf["seq"].idxmax()] for pdf in rows]
        top = max(tops, key=lambda r: r["seq"])
        report = tuple(None if pd.isna(top[n]) else cast(top[n]) for n, cast in _fields(self.memory_schema))
        held = self.held.get() if self.held.exists() else None
        if held is not None and held[0] >= report[0]:
            return
        if self.event_time and self.retention_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max(int(top["at_ms"]), timerValues.getCurrentWatermarkInMs()) + self.retention_ms)
        elif self._running(report) and self.resend_ms and (held is None or not self._running(held)):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.resend_ms)
        self.held.update(report)
        yield self._send(key, report)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.event_time:
            self.held.clear()
        elif self.held.exists() and self._running(self.held.get()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.resend_ms)
            report = self.held.get()
            self.held.update(report)  # begins its retention time anew
            yield self._send(key, report)

    def close(self) -> None:
        pass
