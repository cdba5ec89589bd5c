"""The incident store's steps: samples, snapshots, incidents of traffic and latency, upserts, rebuilds and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .correlate import near_in_time
from .filters import failed
from .incidents import family, incident_id, severity

#: Step and error codes of incidents that no failed event stands behind.
TRAFFIC_STEP, LATENCY_STEP = "<traffic>", "<latency>"
TRAFFIC_CODES, LATENCY_CODE = {"drop": "TRAFFIC_DROP", "surge": "TRAFFIC_SURGE"}, "LATENCY_SPIKE"


def family_samples(incidents: DataFrame, events: DataFrame, most: int = 200, minutes: int = 60) -> DataFrame:
    """incident_id, event_id, trace_id, ts_start of an incident's own events: of the newest `most` failed events of its service and code in its window
    (since to until), ties by event_id, those of its step.

    The limit comes before the step, so other steps of a code may crowd an incident's own out. minutes: the length of a slot of the join.
    """
    rows = events.where(failed() & F.col("error_code").isNotNull()).select(
        "service", "error_code", F.col("step").alias("_step"), "event_id", "trace_id", "ts_start"
    )
    spans = incidents.select("incident_id", "service", "step", "error_code", "since", "until")
    found = near_in_time(rows, spans, ["service", "error_code"], F.col("ts_start"), F.col("since"), F.col("until"), minutes)
    place = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("ts_start"), "event_id"))
    return found.withColumn("_place", place).where(
        (F.col("_place") <= most) & (F.col("_step") == F.col("step"))
    ).select("incident_id", "event_id", "trace_id", "ts_start")


def stable_samples(state: DataFrame, samples: DataFrame, limit: int = 5) -> DataFrame:
    """incident_id and samples, its traces, for each row of state (incident_id, samples): those it has stay; where it has none, that of the earliest
    event comes first; then those of the newest events, up to the limit.

    samples: of family_samples(), so an incident has a bounded number. Events without a trace count nothing; null samples count as none.
    """
    at = F.unix_micros(F.col("ts_start").cast("timestamp"))
    rows = samples.where("coalesce(trace_id, '') <> ''").groupBy("incident_id").agg(
        F.min(F.struct(at.alias("at"), "trace_id")).alias("_first"),
        F.array_sort(F.collect_list(F.struct((-at).alias("at"), "trace_id"))).alias("_recent")
    )
    old = F.coalesce("samples", F.array().cast("array<string>"))
    start = F.when((F.size(old) == 0) & F.col("_first").isNotNull(), F.array("_first.trace_id")).otherwise(old)
    recent = F.array_distinct(F.transform(F.coalesce("_recent", F.array().cast("array<struct<at:bigint,trace_id:string>>")), lambda x: x["trace_id"]))
    joined = state.select("incident_id", "samples").join(rows, "incident_id", "left").select("incident_id", start.alias("start"), recent.alias("recent"))
    return joined.select("incident_id", F.slice(F.concat("start", F.array_except("recent", "start")), 1, limit).alias("samples"))


def capture_status(story: Column, anchor_step: Column, path: Column, first_seen: Column) -> Column:
    """ok; partial where the story has no anchor, no path, or nothing says when its family was first seen; missing where there is no story."""
    whole = anchor_step.isNotNull() & (F.size(path) > 0) & first_seen.isNotNull()
    return F.when(story.isNull(), "missing").when(whole, "ok").otherwise("partial")


def update_snapshots(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """incident_id, opening and latest from prior (the same) and fresh (incident_id, evidence with a field capture_status): the latest is always the
    fresh one; the opening is the first that was captured ok, and then stays. Incidents without fresh evidence keep what they have."""
    rows = prior.join(fresh.withColumn("_new", F.lit(True)), "incident_id", "full_outer")
    opening = F.when(F.col("opening").isNotNull(), F.col("opening")).when(F.col("evidence.capture_status") == "ok", F.col("evidence"))
    return rows.select("incident_id", opening.alias("opening"), F.when(F.col("_new"), F.col("evidence")).otherwise(F.col("latest")).alias("latest"))


def anomaly_incidents(traffic: DataFrame, latency: DataFrame, open_: DataFrame, env: str, now: Column) -> DataFrame:
    """Incidents of what detect.traffic() and detect.latency() found: incident_id, env, service, step, error_code, status, severity, started_at,
    last_seen, lift, baseline, current.

    Their families are synthetic. An open incident of the same environment and family (open_: incident_id, env, service, step, error_code, started_at)
    lends its id and start. The lift of a drop is baseline to current, else current to
    baseline, either at least 1; severity goes by the larger of the two.
    """
    longs = lambda *names: [F.col(n).cast("bigint") for n in names]
    n0, base = longs("n0", "baseline")
    of_traffic = traffic.where("direction is not null").select(
        "service", F.lit(TRAFFIC_STEP).alias("step"),
        F.when(F.col("direction") == "drop", TRAFFIC_CODES["drop"]).otherwise(TRAFFIC_CODES["surge"]).alias("error_code"), n0.alias("current"),
        base.alias("baseline")
    )
    ms, base_ms = longs("latency_ms", "baseline_ms")
    of_latency = latency.where("anomalous").select(
        "service", F.lit(LATENCY_STEP).alias("step"), F.lit(LATENCY_CODE).alias("error_code"), ms.alias("current"), base_ms.alias("baseline")
    )
    rows = of_traffic.unionByName(of_latency).withColumn("env", F.lit(env))
    key = ["env", "service", "step", "error_code"]
    held = open_.groupBy(*key).agg(F.min_by(F.struct("incident_id", "started_at"), F.struct("started_at", "incident_id")).alias("_open"))
    rows = rows.join(held, key, "left").withColumn(
        "started_at", F.coalesce("_open.started_at", now)
    ).withColumn("family", family("service", "step", "error_code"))
    down = F.col("error_code") == TRAFFIC_CODES["drop"]
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    rows = rows.withColumn("lift", F.when(down, ratio("baseline", "current")).otherwise(ratio("current", "baseline")))
    return rows.select(
        F.coalesce("_open.incident_id", incident_id()).alias("incident_id"), *key, F.lit("active").alias("status"),
        severity(F.greatest("current", "baseline"), F.lit(1), F.col("lift")).alias("severity"), "started_at", now.alias("last_seen"), "lift",
        "baseline", "current"
    )


def upsert_incidents(store: DataFrame, rows: DataFrame, fixed: tuple[str, ...] = ("env", "service", "step", "error_code", "started_at")) -> DataFrame:
    """store with rows (the same columns) put in: a known id keeps its environment, family and start, and its suspected deployment where the new row
    names none; all else is the new row's."""
    names = store.columns
    both = store.select(F.struct(*names).alias("old"), "incident_id").join(
        rows.select(F.struct(*names).alias("new"), "incident_id"), "incident_id", "full_outer"
    )

    def pick(name: str) -> Column:
        old, new = F.col(f"old.{name}"), F.col(f"new.{name}")
        if name in fixed:
            return F.when(F.col("old").isNotNull(), old).otherwise(new)
        if name == "suspect_deploy_id":
            return F.coalesce(F.nullif(new, F.lit("")), old)
        return F.when(F.col("new").isNotNull(), new).otherwise(old)

    return both.select(*[F.col("incident_id") if n == "incident_id" else pick(n).alias(n) for n in names])


def replace_unresolved(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The store after a rebuild: its resolved incidents, and rows put in. Incidents that were open and are not in rows are gone."""
    return upsert_incidents(store.where("status = 'resolved'"), rows)


def signals_retained(signals: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """Signals of the last hours, the bound included; those without a time go."""
    return signals.where(F.unix_micros(F.col("timestamp").cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - hours * 3_600_000_000)


def report_signals(incidents: DataFrame, signals: DataFrame, minutes: int = 15, most: int = 200) -> DataFrame:
    """The newest signals of an incident's environment in the minutes up to `until`, whatever their service: what called services report is evidence
    too."""
    s = signals.select("signal_id", F.col("type").alias("signal_type"), "env", F.col("timestamp").alias("signal_at"))
    back = F.col("until") - F.make_dt_interval(mins=F.lit(minutes))
    rows = near_in_time(s, incidents.select("incident_id", "env", "until"), ["env"], F.col("signal_at"), back, F.col("until"), minutes)
    place = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("signal_at"), F.desc("signal_id")))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("incident_id", "signal_id", "signal_type", "place")


def top_families(incidents: DataFrame, events: DataFrame, minutes: int = 15, most: int = 5) -> DataFrame:
    """The largest error families of an incident's service in the minutes up to `until`; the incident's own code has no say. Ties by family."""
    rows = events.where(failed() & F.col("error_code").isNotNull()).select("service", "step", "error_code", "ts_start")
    back = F.col("until") - F.make_dt_interval(mins=F.lit(minutes))
    found = near_in_time(rows, incidents.select("incident_id", "service", "until"), ["service"], F.col("ts_start"), back, F.col("until"), minutes)
    sums = found.groupBy("incident_id", "service", "step", "error_code").agg(F.count(F.lit(1)).alias("count"))
    place = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("count"), "service", "step", "error_code"))
    return sums.withColumn("place", place).where(F.col("place") <= most)


def snapshot_text(incidents: DataFrame) -> DataFrame:
    """incident_id and text, a few lines on each incident for a log or a chat."""
    line = lambda form, *names: F.format_string(form, *[F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in names])
    text = F.concat_ws(
        "\n", line("%s %s severity %s", "incident_id", "status", "severity"), line("family %s/%s/%s in %s", "service", "step", "error_code", "env"),
        line("%s requests, %s users", "requests", "users"), line("cause %s (%s)", "cause", "confidence")
    )
    return incidents.select("incident_id", text.alias("text"))
