"""Deployments, dependencies, runtime signals and alerts that explain an incident; small sides are broadcast by Spark, by their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import failed

SEVERITY = {"critical": 3, "warning": 2, "info": 1}


def severity_rank(column: str = "severity") -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def tolerant(left: str, right: str) -> Column:
    """Equal, or one side blank."""
    return (F.coalesce(F.col(left), F.lit("")) == "") | (F.coalesce(F.col(right), F.lit("")) == "") | (F.col(left) == F.col(right))


def first_by(rows: DataFrame, key: str, *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def deploy_events(events: DataFrame, slot: Column | None = None) -> DataFrame:
    """A deployment where a service's version in an environment changes, by seq; the first version seen is none. Rows without a version are passed
    over.

    slot: a column that never falls as seq rises, such as the day. Versions are then compared within each slot of a service, and the first of a slot
    with the last of the one before: a
    service's history is dealt over its slots, and only one row a slot meets in one place.
    """
    rows = events.where("version is not null and version <> ''").select(
        "service", "env", "version", "ts_start", "seq", (F.lit(0) if slot is None else slot).alias("slot")
    )
    own = Window.partitionBy("service", "env", "slot").orderBy("seq")
    inside = rows.withColumn("before", F.lag("version").over(own)).where("before <> version")
    ends = rows.groupBy("service", "env", "slot").agg(
        F.min_by(F.struct("version", "ts_start", "seq"), "seq").alias("first"), F.max_by("version", "seq").alias("last")
    )
    ends = ends.withColumn("before", F.lag("last").over(Window.partitionBy("service", "env").orderBy("slot"))).where("before <> first.version")
    found = inside.select("service", "env", "version", "ts_start", "seq").unionByName(ends.select("service", "env", "first.*"))
    return found.select(
        F.concat_ws(":", F.lit("otlp"), "service", "env", "version").alias("id"), "service", "env", "version", F.col("ts_start").alias("first_seen"),
        F.col("ts_start").alias("last_seen"), "seq"
    )


def upsert_deploys(rows: DataFrame) -> DataFrame:
    """One row for each id: least first_seen, largest last_seen, the last version that is not blank. An id with two environments is left out; see
    deploy_conflicts()."""
    version = F.max_by(F.col("version"), F.when(F.coalesce("version", F.lit("")) != "", F.col("seq")))
    merged = rows.groupBy("id").agg(
        F.min("service").alias("service"), F.min("env").alias("env"), version.alias("version"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.count(F.lit(1)).alias("writes")
    )
    return merged.join(deploy_conflicts(rows), "id", "left_anti")


def deploy_conflicts(rows: DataFrame) -> DataFrame:
    """The ids that two environments or more write; a null environment is none."""
    return rows.groupBy("id").agg(F.count_distinct("env").alias("envs")).where("envs > 1").select("id")


def deploy_rate_delta(deploys: DataFrame, events: DataFrame, minutes: int = 5, least: int = 10) -> DataFrame:
    """Requests and failures of the service in the minutes before and after each deployment, both with the instant itself; the ratio of the rates only
    where both sides have enough requests and there were failures before.

    An event is joined to the deployments of its service by slots of that many minutes: its own slot and both neighbours.
    """
    seconds = minutes * 60
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    near = deploys.select("id", "service", "first_seen", F.explode(F.array(*[slot("first_seen") + k for k in (-1, 0, 1)])).alias("slot"))
    rows = events.select("service", "ts_start", failed().alias("bad"), slot("ts_start").alias("slot")).join(near, ["service", "slot"])
    span = F.make_dt_interval(mins=F.lit(minutes))
    before = F.col("ts_start").between(F.col("first_seen") - span, F.col("first_seen"))
    after = F.col("ts_start").between(F.col("first_seen"), F.col("first_seen") + span)
    sums = rows.groupBy("id").agg(
        F.count_if(before).alias("n_before"), F.count_if(before & F.col("bad")).alias("bad_before"), F.count_if(after).alias("n_after"),
        F.count_if(after & F.col("bad")).alias("bad_after")
    )
    out = deploys.select("id", "service", "first_seen").join(sums, "id", "left").na.fill(0, ["n_before", "bad_before", "n_after", "bad_after"])
    rate = lambda bad, n: F.when(F.col(n) > 0, F.col(bad) / F.col(n)).otherwise(0.0)
    enough = (F.col("n_before") >= least) & (F.col("n_after") >= least) & (F.col("bad_before") > 0)
    return out.withColumn("ratio", F.when(enough, rate("bad_after", "n_after") / F.greatest(rate("bad_before", "n_before"), F.lit(0.001))))


def near_in_time(points: DataFrame, spans: DataFrame, keys: list[str], at: Column, since: Column, until: Column, minutes: int) -> DataFrame:
    """points joined with spans by keys where `at` of the one lies from `since` to `until` of the other, both ends counted.

    Both go by slots of about that many minutes: a point is in one, a span in each that it touches, so a hot key is dealt over its slots and no point
    meets a span far from it. at is a column of
    points, since and until are of spans. Rows with a null time or key match nothing.
    """
    seconds = max(60, minutes * 60)
    slot = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / (seconds * 1_000_000))
    spans = spans.withColumns({"_since": since, "_until": until}).where(F.col("_until") >= F.col("_since"))
    spans = spans.withColumn("_slot", F.explode(F.sequence(slot(F.col("_since")), slot(F.col("_until")))))
    points = points.withColumn("_at", at).withColumn("_slot", slot(F.col("_at")))
    return points.join(spans, [*keys, "_slot"]).where(F.col("_at").between(F.col("_since"), F.col("_until"))).drop("_slot", "_at", "_since", "_until")


def deploy_match(incidents: DataFrame, deploys: DataFrame, minutes: int = 15) -> DataFrame:
    """The newest deployment of an incident's service in the minutes up to `now`, with its environment and version or blank ones."""
    d = deploys.select("service", *[F.col(c).alias(f"deploy_{c}") for c in ("id", "env", "version", "first_seen")])
    back = F.col("now") - F.make_dt_interval(mins=F.lit(minutes))
    rows = near_in_time(
        d, incidents, ["service"], F.col("deploy_first_seen"), back, F.col("now"), minutes
    ).where(tolerant("env", "deploy_env") & tolerant("version", "deploy_version"))
    return first_by(rows, "incident_id", F.desc("deploy_first_seen"), "deploy_id")


def dependency_match(incidents: DataFrame, signals: DataFrame, minutes: int = 60) -> DataFrame:
    """The newest dependency signal of the service that the incident's first failing call went to, in its window. minutes: the length of a slot."""
    s = signals.where("type = 'dependency'").select("signal_id", F.col("service").alias("downstream_service"), F.col("timestamp").alias("signal_at"))
    rows = near_in_time(s, incidents, ["downstream_service"], F.col("signal_at"), F.col("started_at"), F.col("now"), minutes)
    return first_by(rows, "incident_id", F.desc("signal_at"), F.desc("signal_id"))


def runtime_match(incidents: DataFrame, signals: DataFrame, minutes: int = 15) -> DataFrame:
    """Runtime and healthcheck signals of the service from the minutes before the start up to now: the most severe first, then the earliest. place
    counts them."""
    s = signals.where(F.col("type").isin("runtime", "healthcheck")).select(
        "signal_id", F.col("severity").alias("signal_severity"), "service", F.col("env").alias("signal_env"), F.col("timestamp").alias("signal_at")
    )
    back = F.col("started_at") - F.make_dt_interval(mins=F.lit(minutes))
    rows = near_in_time(s, incidents, ["service"], F.col("signal_at"), back, F.col("now"), minutes).where(tolerant("env", "signal_env"))
    place = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc(severity_rank("signal_severity")), "signal_at", "signal_id"))
    return rows.withColumn("place", place)


def deploy_signal_fallback(incidents: DataFrame, deploys: DataFrame, signals: DataFrame, minutes: int = 15) -> DataFrame:
    """The newest deploy signal of the service in the minutes up to now, for the incidents that deploy_match() finds no deployment for."""
    alone = incidents.join(deploy_match(incidents, deploys, minutes).select("incident_id"), "incident_id", "left_anti")
    s = signals.where("type = 'deploy'").select("signal_id", "service", F.col("env").alias("signal_env"), F.col("timestamp").alias("signal_at"))
    back = F.col("now") - F.make_dt_interval(mins=F.lit(minutes))
    rows = near_in_time(s, alone, ["service"], F.col("signal_at"), back, F.col("now"), minutes).where(tolerant("env", "signal_env"))
    return first_by(rows, "incident_id", F.desc("signal_at"), F.desc("signal_id"))


def alert_evidence(incidents: DataFrame, signals: DataFrame, minutes: int = 15) -> DataFrame:
    """The alerts of an incident's service and very environment from the minutes before its start up to now, the most severe first, then the newest.
    place counts them; the first is the top alert."""
    s = signals.where("type = 'alert'").select("signal_id", F.col("severity").alias("signal_severity"), "service", "env", F.col("timestamp").alias("signal_at"))
    back = F.col("started_at") - F.make_dt_interval(mins=F.lit(minutes))
    rows = near_in_time(s, incidents, ["service", "env"], F.col("signal_at"), back, F.col("now"), minutes)
    place = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc(severity_rank("signal_severity")), F.desc("signal_at"), "signal_id"))
    return rows.withColumn("place", place)


def suspect_change(incidents: DataFrame, deploys: DataFrame, rates: DataFrame) -> DataFrame:
    """Each incident's suspected deployment, with the change of its service's error rate; nulls where there is none or it isn't known. rates: of
    deploy_rate_delta()."""
    d = deploys.groupBy("id").agg(
        F.min_by("service", "first_seen").alias("deploy_service"), F.min_by("version", "first_seen").alias("deploy_version"),
        F.min("first_seen").alias("deploy_first_seen")
    )
    r = rates.select("id", *[c for c in ("n_before", "bad_before", "n_after", "bad_after", "ratio")]).dropDuplicates(["id"])
    return incidents.join(d.join(r, "id", "left").withColumnRenamed("id", "suspect_deploy_id"), "suspect_deploy_id", "left")


def alert_match(incidents: DataFrame, alerts: DataFrame, minutes: int = 15) -> DataFrame:
    """Alerts of an incident and why. One that names an incident belongs to that alone; another must be in the time window and agree on environment
    and service (or leave them blank) and on the error code, and on the step if it has one."""
    a = alerts.select(
        "signal_id", F.col("service").alias("alert_service"), F.col("env").alias("alert_env"), F.col("timestamp").alias("alert_at"),
        "alert_incident_id", "alert_code", "alert_step"
    )
    named = F.coalesce(F.col("alert_incident_id"), F.lit("")) != ""
    back = F.col("started_at") - F.make_dt_interval(mins=F.lit(minutes))
    by_id = near_in_time(
        a.where(named).withColumn("incident_id", F.col("alert_incident_id")), incidents, ["incident_id"], F.col("alert_at"), back, F.col("now"),
        minutes
    ).withColumn("strategy", F.lit("incident_id"))
    family = tolerant("env", "alert_env") & tolerant("service", "alert_service") & (
        (F.coalesce(F.col("alert_step"), F.lit("")) == "") | (F.col("alert_step") == F.col("step"))
    )
    by_family = near_in_time(
        a.where(~named).withColumn("error_code", F.col("alert_code")), incidents, ["error_code"], F.col("alert_at"), back, F.col("now"), minutes
    ).where(family).withColumn("strategy", F.lit("family"))
    return by_id.unionByName(by_family)


def alert_to_incident(alerts: DataFrame, incidents: DataFrame, anchors: DataFrame, minutes: int = 15) -> DataFrame:
    """signal_id, incident_id and way of the alerts that find an incident at intake: 1, the one that the alert names, whatever its status; else, among
    active ones near in time, 2, that of the
    service and code of its trace's anchor; 3, that of its own service and code; of several the most severe, newest first. Environments must agree
    where both are known.

    alerts: signal_id, service, env, timestamp, trace_id, alert_incident_id, alert_code. incidents: incident_id, env, service, error_code, status,
    severity, started_at, updated_at. anchors: trace_id, service, error_code.
    Alerts without a time are near to any incident. Incidents are joined by service, code and slots of time.
    """
    minutes = min(minutes, 24 * 60)
    a = alerts.select(
        "signal_id", F.coalesce("env", F.lit("")).alias("a_env"), "timestamp", "trace_id", "alert_incident_id", F.col("service").alias("own_service"),
        F.col("alert_code").alias("own_code")
    )
    i = incidents.select(
        "incident_id", "status", F.col("severity").alias("rank"), "started_at", F.col("updated_at").alias("until"),
        F.coalesce("env", F.lit("")).alias("i_env"), F.col("service").alias("by_service"), F.col("error_code").alias("by_code")
    )
    named = a.where("coalesce(alert_incident_id, '') <> ''").join(i, F.col("alert_incident_id") == F.col("incident_id")).withColumn("way", F.lit(1))
    traced = a.where("coalesce(trace_id, '') <> ''").join(
        anchors.select("trace_id", F.col("service").alias("by_service"), F.col("error_code").alias("by_code")).where("by_code is not null"),
        "trace_id"
    ).withColumn("way", F.lit(2))
    owned = a.where("coalesce(own_code, '') <> ''").withColumn(
        "by_service", F.col("own_service")
    ).withColumn("by_code", F.col("own_code")).withColumn("way", F.lit(3))
    asked = traced.unionByName(owned.select(*traced.columns))
    agree = (F.col("a_env") == "") | (F.col("i_env") == "") | (F.col("a_env") == F.col("i_env"))
    span = F.make_dt_interval(mins=F.lit(minutes))
    open_ = i.where("status = 'active'")
    timed = near_in_time(
        asked.where("timestamp is not null"), open_, ["by_service", "by_code"], F.col("timestamp"), F.col("started_at") - span, F.col("until") + span,
        minutes
    )
    timeless = asked.where("timestamp is null").join(open_, ["by_service", "by_code"])
    columns = ("signal_id", "incident_id", "way", "rank", "started_at")
    found = named.select(*columns).unionByName(timed.where(agree).select(*columns)).unionByName(timeless.where(agree).select(*columns))
    return first_by(found, "signal_id", "way", F.desc("rank"), F.desc("started_at"), "incident_id").select("signal_id", "incident_id", "way")
