"""Order, linkage, anchor and story of traces. The events of one trace meet in one row; traces are dealt to tasks by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FAILED

CAUSAL, FALLBACK = "causal", "timestamp_fallback"


def _identity(e: dict) -> tuple:
    """Nulls come first."""
    return tuple((e[name] is not None, e[name]) if e[name] is not None else (False,) for name in ("ts_start", "service", "event_id"))


class Graph:
    """Parents and children of a trace's events through the spans of their steps. One parent that no step owns, or that is the event itself, makes the
    whole graph unusable, and so does the lack of edges."""

    def __init__(self, events: list[dict]):
        owner = {span: e["event_id"] for e in events for span in e["spans"] or () if span}
        self.parent: dict[str, str] = {}
        self.children: dict[str, list[dict]] = {}
        self.usable = False
        for e in events:
            if e["parent_span_id"]:
                above = owner.get(e["parent_span_id"])
                if above is None or above == e["event_id"]:
                    return
                self.children.setdefault(above, []).append(e)
                self.parent[e["event_id"]] = above
        self.usable = bool(self.parent)

    def depths(self) -> dict[str, int]:
        """The number of events above each one; in a cycle, and below it, of all that it can reach."""
        out: dict[str, int] = {}
        for start in self.parent:
            place: dict[str, int] = {}
            at = start
            while at in self.parent and at not in out and at not in place:
                place[at] = len(place)
                at = self.parent[at]
            path = list(place)
            ring = path[place[at] :] if at in place else []
            out |= dict.fromkeys(ring, len(ring))
            base = len(ring) or out.get(at, 0)
            for k, e in enumerate(reversed(path[: len(path) - len(ring)])):
                out[e] = base + k + 1
        return out

    def above(self, ids: set[str]) -> set[str]:
        """The events that one of ids is below; in a cycle an event is below itself. Each event is climbed through once, as all above it is found then."""
        found: set[str] = set()
        for start in ids:
            at = self.parent.get(start)
            while at is not None and at not in found:
                found.add(at)
                at = self.parent.get(at)
        return found


def ordered(events: list[dict]) -> tuple[list[dict], str]:
    """Parents before children, siblings by identity, where that reaches every event; else all by identity."""
    by_time = sorted(events, key=_identity)
    graph = Graph(events)
    if not graph.usable:
        return by_time, FALLBACK
    out, seen = [], set()
    stack = [e for e in reversed(by_time) if not e["parent_span_id"]]
    while stack:
        e = stack.pop()
        if e["event_id"] not in seen:
            seen.add(e["event_id"])
            out.append(e)
            stack += sorted(graph.children.get(e["event_id"], ()), key=_identity, reverse=True)
    return (out, CAUSAL) if len(out) == len(events) else (by_time, FALLBACK)


def anchor(events: list[dict], exclude_suppressed: bool = True) -> tuple[dict | None, str]:
    """The deepest failed event with no failed event below it, where the graph is usable and touches a failed event; else the earliest failed one.
    With none failed, the trace's root."""
    may = [e for e in events if not (exclude_suppressed and e["status"] == "suppressed")]
    bad = [e for e in may if e["status"] in FAILED]
    graph = Graph(events)
    if bad:
        ids = {e["event_id"] for e in bad}
        if graph.usable and any(i in graph.parent or graph.children.get(i) for i in ids):
            above, depths = graph.above(ids), graph.depths()
            leaves = [e for e in bad if e["event_id"] not in above]
            if leaves:
                return min(leaves, key=lambda e: (-depths.get(e["event_id"], 0), *_identity(e))), CAUSAL
        return min(bad, key=_identity), FALLBACK
    linkage, roots = FALLBACK, [e for e in may if not e["parent_span_id"]]
    if not roots:
        roots = [e for e in may if e["parent_span_id"] and e["event_id"] not in graph.parent]
        linkage = CAUSAL if graph.usable else FALLBACK
    return min(roots or may, key=_identity, default=None), linkage


def _grouped(events: DataFrame) -> DataFrame:
    """A row a trace: its events in order of seq. Nulls in status, service or start are values like others."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    row = F.struct(
        "seq", "ts_start", "service", F.col("event_id").cast("string").alias("event_id"), blank("parent_span_id").alias("parent_span_id"), "status",
        F.transform("steps", lambda s: s["span_id"]).alias("spans"), "step", "error_code"
    )
    return events.where("trace_id is not null").groupBy("trace_id").agg(F.array_sort(F.collect_list(row)).alias("events"))


def order_traces(events: DataFrame) -> DataFrame:
    """trace_id, event_id, place (from 1), linkage. Events without a trace_id have no row; repeated rows of an event have one each only where the
    order is by time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for trace, own in zip(batch.column("trace_id").to_pylist(), batch.column("events").to_pylist(), strict=True):
                out, linkage = ordered(own)
                rows += [(trace, e["event_id"], k + 1, linkage) for k, e in enumerate(out)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)],
                ["trace_id", "event_id", "place", "linkage"]
            )

    return _grouped(events).mapInArrow(run, "trace_id string, event_id string, place int, linkage string")


def anchors(events: DataFrame, exclude_suppressed: bool = True) -> DataFrame:
    """trace_id, event_id of the anchor (null where no event may be one), linkage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchor(own, exclude_suppressed) for own in batch.column("events").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("trace_id"), pa.array([e and e["event_id"] for e, _ in found], pa.string()),
                    pa.array([x for _, x in found], pa.string())
                ],
                ["trace_id", "event_id", "linkage"]
            )

    return _grouped(events).mapInArrow(run, "trace_id string, event_id string, linkage string")


def trace_facts(events: DataFrame, exclude_suppressed: bool = True) -> DataFrame:
    """trace_id, services (in order of first use, '' and null left out), and of the anchor event event_id, linkage, status and anchor, its family
    (null where it has no error code)."""

    def family(e: dict | None) -> str | None:
        return None if not e or not e["error_code"] else ":".join((e[n] or "").replace(":", "\\:") for n in ("service", "step", "error_code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            services, found = [], []
            for own in batch.column("events").to_pylist():
                services.append(list(dict.fromkeys(e["service"] for e in ordered(own)[0] if e["service"])))
                found.append(anchor(own, exclude_suppressed))
            text = lambda values: pa.array(list(values), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("trace_id"), pa.array(services, pa.list_(pa.string())), text(e and e["event_id"] for e, _ in found), text(x for _, x in found), text(e and e["status"] for e, _ in found), text(family(e) for e, _ in found)],
                ["trace_id", "services", "event_id", "linkage", "status", "anchor"],
            )

    return _grouped(events).mapInArrow(run, "trace_id string, services array<string>, event_id string, linkage string, status string, anchor string")


def anchor_step(steps: Column, name: Column) -> Column:
    """The first of the latest-starting error steps of that name, else of all steps of that name; null where there is none."""
    numbered = F.transform(steps, lambda s, k: F.struct(s["start_ms"].alias("start"), (-k).alias("order"), s.alias("step")))
    named = F.filter(numbered, lambda n: n["step"]["name"] == name)
    wrong = F.filter(named, lambda n: n["step"]["status"] == "error")
    return F.array_max(F.when(F.size(wrong) > 0, wrong).otherwise(named))["step"]


def contributing_steps(steps: Column, until: Column) -> Column:
    """By start, the steps that end at `until` or before; all of them where it is null."""
    kept = F.filter(steps, lambda s: until.isNull() | (s["start_ms"] + s["duration_ms"] <= until))
    by_start = F.array_sort(F.transform(kept, lambda s, k: F.struct(s["start_ms"].alias("start"), k.alias("order"), s.alias("step"))))
    return F.transform(by_start, lambda n: n["step"])


def story_logs(logs: Column, path: Column, until: Column) -> Column:
    """Warnings and errors; where an anchor's step was found, from the start of the path's first step to that one's end."""
    first = F.coalesce(F.get(path, 0)["start_ms"], F.lit(0))
    return F.filter(logs, lambda x: x["level"].isin("warn", "error") & (until.isNull() | x["ts_offset_ms"].between(first, until)))


def stories(events: DataFrame) -> DataFrame:
    """Each event with path, loud (its logs), downstream (step, service and endpoint of each call of the path) and anchored (whether its anchor's step
    was found).

    events: with steps, logs and anchor (step, error_code). A suppressed event has its header only: the three are empty. Null steps or logs count as
    none; a step without start or duration is in no path that ends at an anchor.
    """
    shown = F.col("status") != "suppressed"
    none = lambda name: F.filter(name, lambda x: F.lit(False))
    rows = events.withColumn("steps", F.coalesce("steps", F.array())).withColumn("logs", F.coalesce("logs", F.array()))
    rows = rows.withColumn("_at", F.when(shown, anchor_step(F.col("steps"), F.col("anchor.step"))))
    until = F.col("_at.start_ms") + F.col("_at.duration_ms")
    rows = rows.withColumn("path", F.when(shown, contributing_steps(F.col("steps"), until)).otherwise(none("steps")))
    rows = rows.withColumn("loud", F.when(shown, story_logs(F.col("logs"), F.col("path"), until)).otherwise(none("logs")))
    calls = F.filter("path", lambda s: s["downstream"].isNotNull())
    calls = F.transform(
        calls, lambda s: F.struct(s["name"].alias("step"), s["downstream"]["service"].alias("service"), s["downstream"]["endpoint"].alias("endpoint"))
    )
    return rows.withColumn("downstream", calls).withColumn("anchored", F.col("_at").isNotNull()).drop("_at")


def trace_stories(events: DataFrame) -> DataFrame:
    """The story of each trace's anchor event, and how that was found (linkage). Traces of suppressed events only have none."""
    found = anchors(events).where("event_id is not null").select(F.col("event_id").alias("_id"), F.col("trace_id").alias("_trace"), "linkage")
    own = (F.col("event_id").cast("string") == F.col("_id")) & (F.col("trace_id") == F.col("_trace"))
    return stories(events.join(found, own).drop("_id", "_trace"))
