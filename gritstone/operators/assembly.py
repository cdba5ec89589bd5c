"""Requests assembled from the records that instrumented code leaves: one wide event for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a request, the status that each gives, and the step that stands for a request without one.
ENDS = {"close": "", "panic": "error", "timeout": "timeout", "aborted": "aborted"}
REQUEST = "request"
RECORD = (
    "request_id string, seq bigint, kind string, at_ms bigint, name string, span_id string, status string, code string, reason string, service string, env string, "
    "trace_id string, parent_span_id string, value string"
)


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def assemble(records: DataFrame, prefix: str = "") -> DataFrame:
    """request_id, service, env, trace_id, parent_span_id, ts_start_ms, ts_end_ms, duration_ms, status, anchor (step, error_code), steps (name, span_id,
    start_ms, duration_ms, status, code), logs (ts_offset_ms, level, msg), errors (code, reason) and fields (map) of each request.

    records (RECORD; other columns aren't looked at) in order of seq, of these kinds: open (with service, env, trace_id, parent_span_id), step and
    step_end (of one span_id; name; at its end status ok or error, and code and reason), log (name: its level, value: its text), field (name, value;
    the last one holds), error (code, reason), suppress, and what ends the request: close, panic, timeout or aborted.

    The first of these ends it; what comes later is left out, and so are requests without `open` and rows with a null request_id. A request that nothing
    ended has the status it has so far. Suppressed ones are suppressed whatever else happened, and keep header and fields only. The anchor is the first
    step that ended with an error. Without one, a panic, timeout or cancellation is anchored at the step that was running, the innermost one, or at
    `request`, with the code PANIC, TIMEOUT or ABORTED behind the prefix; with one, it stays, the status is a panic's or timeout's own, and a
    cancelled request stays an error. Steps still running when one of these three comes are closed then, as ok; at an ordinary close they are left out.
    errors has each code once, by its first reason, a panic's too. Of several records that open a request, or one step, the first holds. All records of
    a request meet in one row.
    """
    fields = [f.split()[0] for f in RECORD.split(", ") if not f.startswith("request_id")]
    rows = records.where("request_id is not null").select("request_id", *fields)
    rows = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_all"))
    over = F.transform(F.filter(F.transform("_all", lambda r, k: F.struct(k.alias("k"), r["kind"].alias("kind"))), lambda r: r["kind"].isin(*ENDS)), lambda r: r["k"])
    rows = rows.withColumn("_r", F.slice("_all", F.lit(1), F.coalesce(_first(over) + 1, F.size("_all")))).drop("_all")
    of = lambda *kinds: F.filter("_r", lambda r: r["kind"].isin(*kinds))
    rows = rows.withColumns({"_open": _first(of("open")), "_end": _first(of(*ENDS)), "_begun": of("step"), "_ended": of("step_end")}).where("_open is not null")
    rows = rows.withColumn("_cut", F.coalesce(F.col("_end.kind").isin("panic", "timeout", "aborted"), F.lit(False)))
    begin = F.col("_open.at_ms")

    def started(span: Column) -> Column:
        return _first(F.filter("_begun", lambda b: b["span_id"] == span))

    def step(name: Column, span: Column, start: Column, end: Column, status: Column, code: Column) -> Column:
        took = F.greatest(end - start, F.lit(0))
        return F.struct(name.alias("name"), span.alias("span_id"), (start - begin).alias("start_ms"), took.alias("duration_ms"), status.alias("status"), code.alias("code"))

    none = F.lit(None).cast("string")
    closed = F.transform("_ended", lambda e: step(F.coalesce(e["name"], started(e["span_id"])["name"]), e["span_id"], F.coalesce(started(e["span_id"])["at_ms"], e["at_ms"]), e["at_ms"], e["status"], F.when(e["status"] == "error", e["code"])))
    running = F.filter("_begun", lambda b: ~F.exists("_ended", lambda e: e["span_id"] == b["span_id"]))
    rows = rows.withColumns({"_running": F.when(F.col("_cut"), running).otherwise(F.filter("_begun", lambda b: F.lit(False))), "_closed": closed})
    rows = rows.withColumn("_wrong", _first(F.filter("_closed", lambda s: s["status"] == "error")))
    kind, wrong = F.col("_end.kind"), F.col("_wrong").isNotNull()
    status = F.when(F.size(of("suppress")) > 0, "suppressed").when(kind == "panic", "error").when(kind == "timeout", "timeout").when(wrong, "error").when(kind == "aborted", "aborted").otherwise("ok")
    inner = F.coalesce(F.try_element_at("_running", F.lit(-1))["name"], F.lit(REQUEST))
    anchor = F.when(wrong, F.struct(F.col("_wrong.name").alias("step"), F.col("_wrong.code").alias("error_code"))).when(
        F.col("_cut"), F.struct(inner.alias("step"), F.concat(F.lit(prefix), F.upper(kind)).alias("error_code"))
    )
    late = F.transform("_running", lambda b: step(b["name"], b["span_id"], b["at_ms"], F.col("_end.at_ms"), F.lit("ok"), none))
    told = F.transform(of("step_end", "error", "panic"), lambda r: F.struct(
        F.when(r["kind"] == "panic", F.lit(f"{prefix}PANIC")).when((r["kind"] == "error") | (r["status"] == "error"), r["code"]).alias("code"),
        F.when(r["kind"] == "panic", F.lit("runtime panic recovered")).otherwise(r["reason"]).alias("reason"),
    ))
    rows = rows.withColumn("_told", F.filter(told, lambda e: e["code"].isNotNull()))
    errors = F.filter("_told", lambda e, k: ~F.exists(F.slice("_told", F.lit(1), k), lambda f: f["code"] == e["code"]))
    logs = F.transform(of("log"), lambda r: F.struct((r["at_ms"] - begin).alias("ts_offset_ms"), r["name"].alias("level"), r["value"].alias("msg")))
    rows = rows.withColumn("_fields", of("field"))
    last = F.filter("_fields", lambda f, k: ~F.exists(F.slice("_fields", k + 2, F.size("_fields")), lambda g: g["name"] == f["name"]) & f["name"].isNotNull())
    header = [F.col(f"_open.{c}").alias(c) for c in ("service", "env", "trace_id", "parent_span_id")]
    end = F.coalesce("_end.at_ms", F.try_element_at("_r", F.lit(-1))["at_ms"])
    rows = rows.withColumn("status", status)
    shown = lambda c: F.when(F.col("status") != "suppressed", c)
    return rows.select(
        "request_id", *header, begin.alias("ts_start_ms"), end.alias("ts_end_ms"), (end - begin).alias("duration_ms"), "status", shown(anchor).alias("anchor"),
        shown(F.concat("_closed", late)).alias("steps"), shown(logs).alias("logs"), shown(errors).alias("errors"),
        F.map_from_entries(F.transform(last, lambda f: F.struct(f["name"], f["value"]))).alias("fields")
    )
