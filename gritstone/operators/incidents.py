"""Incident ids, severity, causes, evidence, lifecycle and the judgment queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def family(service: Column | str, step: Column | str, code: Column | str) -> Column:
    """service:step:code, with a backslash before each colon within a part."""
    parts = [F.replace(F.col(p) if isinstance(p, str) else p, F.lit(":"), F.lit("\\:")) for p in (service, step, code)]
    return F.concat_ws(":", *parts)


def incident_id(env: str = "env", service: str = "service", family_: str = "family", started: str = "started_at", minutes: int = 5) -> Column:
    """inc_ and 16 hex digits of a hash of environment, service, family and start, cut to five minutes, so that an incident keeps its id while its
    start moves a little."""
    cut = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(started).cast("timestamp")) / (60 * minutes)) * (60 * minutes))
    text = F.concat_ws("|", env, service, family_, F.date_format(cut, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.concat(F.lit("inc_"), F.substring(F.sha2(text, 256), 1, 16))


def severity(count: Column, services: Column, lift: Column) -> Column:
    return F.least(F.lit(10), 1 + F.floor(count / 5) + services + F.when(lift >= 10, 3).when(lift >= 3, 2).otherwise(0)).cast("int")


def onset_tiebreak(dependency_at: str, deploy_at: str, onset: str) -> Column:
    """Which of a dependency signal and a deployment is the likelier cause: one at or before the onset beats one after it, else the closer one; an
    exact tie goes to the dependency, and one without a time loses."""
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = lambda c: F.abs(at(c) - at(onset))
    early = lambda c: F.col(c) <= F.col(onset)
    deploy_wins = F.when(F.col(deploy_at).isNull(), False).when(F.col(dependency_at).isNull(), True).when(
        early(dependency_at) != early(deploy_at), early(deploy_at)
    ).otherwise(gap(deploy_at) < gap(dependency_at))
    return F.when(deploy_wins, "deploy").otherwise("dependency")


def cause(dependency_at: str, deploy_at: str, downstream: str, runtime: str, events: str, step: str, onset: str) -> Column:
    """cause/confidence by the first rule that holds. downstream, runtime: whether there is one; events: how many."""
    both = F.col(dependency_at).isNotNull() & F.col(deploy_at).isNotNull()
    return (
        F.when(both, F.concat(onset_tiebreak(dependency_at, deploy_at, onset), F.lit("/high")))
        .when(F.col(dependency_at).isNotNull(), "dependency/high")
        .when(F.col(deploy_at).isNotNull(), "deploy/high")
        .when(F.col(downstream), "dependency/medium")
        .when(F.col(runtime), "runtime/high")
        .when((F.col(events) > 0) & (F.coalesce(F.col(step), F.lit("")) != ""), "app/medium")
        .otherwise("unknown/low")
    )


def cap_evidence(evidence: DataFrame, most: int = 12) -> DataFrame:
    """Each incident's evidence by time, kind and title, once for each kind, title, signal, deployment and trace. Runtime and deployment rows all
    stay; the earliest others fill what is left of the cap. Nulls in the five are a value like others.

    Copies go within tasks first, and of an incident's other rows no more than the cap are put in order in one place.
    """
    order, same = ["occurred_at", "kind", "title", "seq"], ["incident_id", "kind", "title", "signal_id", "deploy_id", "trace_id"]
    rest = [c for c in evidence.columns if c not in same]
    rows = evidence.groupBy(*same).agg(
        F.min_by(F.struct(*rest), F.struct("occurred_at", "seq")).alias("_rest")
    ).select(*same, "_rest.*").select(*evidence.columns)
    kept = F.coalesce(F.col("kind").isin("runtime", "deployment"), F.lit(False))
    must = rows.where(kept)
    sizes = rows.groupBy("incident_id").agg(F.count_if(kept).alias("_must"))
    own = Window.partitionBy("incident_id").orderBy(*order)
    others = rows.where(~kept).withColumn("_place", F.row_number().over(own)).where(F.col("_place") <= most).join(sizes, "incident_id").where(
        F.col("_place") <= most - F.col("_must")
    ).drop("_place", "_must")
    return must.unionByName(others).withColumn("place", F.row_number().over(own))


def lifecycle(state: DataFrame, seen: DataFrame, now: Column, minutes: int = 2) -> DataFrame:
    """The next state of the incidents. Those seen are active, with their first start kept, and their suspected deployment where none is named anew.
    Of those unseen, active ones recover, and recovering
    ones are resolved when they were last seen some minutes ago or more; resolved ones stay so. transition: opened, resolved or null. The next state
    is read back as `state`, less its transition.
    """
    old = state.select("incident_id", *[F.col(c).alias(f"old_{c}") for c in ("status", "started_at", "last_seen", "suspect_deploy_id")])
    rows = old.join(seen.withColumn("_seen", F.lit(True)), "incident_id", "full_outer")
    quiet = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("old_last_seen").cast("timestamp")) >= minutes * 60_000_000
    status = F.when(F.col("_seen"), "active").when(F.col("old_status") == "active", "recovering").when(
        (F.col("old_status") == "recovering") & quiet, "resolved"
    ).otherwise(F.col("old_status"))
    rows = rows.withColumn("status", status)
    transition = F.when(
        F.col("_seen") & (F.col("old_status").isNull() | (F.col("old_status") == "resolved")), "opened"
    ).when((F.col("status") == "resolved") & (F.col("old_status") != "resolved"), "resolved")
    return rows.select(
        "incident_id", "status", F.coalesce("old_started_at", "started_at").alias("started_at"),
        F.coalesce("last_seen", "old_last_seen").alias("last_seen"),
        F.coalesce(F.nullif(F.col("suspect_deploy_id"), F.lit("")), F.col("old_suspect_deploy_id")).alias("suspect_deploy_id"),
        transition.alias("transition")
    )


def retained(incidents: DataFrame, now: Column, hours: int = 168) -> DataFrame:
    """All but resolved incidents that were last seen more than so many hours ago, and those of which a null leaves that open."""
    old = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_seen").cast("timestamp")) > hours * 3600
    return incidents.where(~((F.col("status") == "resolved") & old))


def impact_queue(incidents: DataFrame, limit: int = 50) -> DataFrame:
    """Active incidents by users, requests and services; needs_judgment where the cause is unknown, confidence low, or no deployment suspected."""
    judge = (F.col("cause") == "unknown") | (F.col("confidence") == "low") | (F.coalesce(F.col("suspect_deploy_id"), F.lit("")) == "")
    return incidents.where("status in ('active', 'recovering')").withColumn("needs_judgment", judge).orderBy(
        F.desc("users"), F.desc("requests"), F.desc("services"), "incident_id"
    ).limit(limit)


def insight(incidents: DataFrame) -> DataFrame:
    """The most severe, newest active incident with its confidence as a number."""
    number = F.when(F.col("confidence") == "high", 0.9).when(F.col("confidence") == "medium", 0.65).otherwise(0.35)
    return incidents.where("status = 'active'").orderBy(F.desc("severity"), F.desc("started_at"), "incident_id").limit(1).withColumn("confidence_value", number)


def evidence_fingerprint(evidence: DataFrame, by: str = "incident_id") -> DataFrame:
    """A hash of the sorted distinct kind:id lines."""
    lines = F.array_sort(F.collect_set(F.concat_ws(":", "kind", "id")))
    return evidence.groupBy(by).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"))


def warnings(incidents: DataFrame) -> DataFrame:
    """Sorted instrumentation warnings of each incident."""
    found = F.array(
        F.when(F.coalesce(F.col("version"), F.lit("")) == "", "missing_service_version"),
        F.when(F.col("has_downstream") & ~F.col("has_dependency_signal"), "missing_dependency_signal"),
        F.when(F.col("linkage") == "timestamp_fallback", "partial_trace")
    )
    return incidents.withColumn("warnings", F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))))
