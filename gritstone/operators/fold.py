"""All ticks of the incident engine in one plan."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .incidents import family, incident_id

KEY = ["env", "service", "family"]


def _ticks(start: datetime, every: timedelta, c: Column) -> Column:
    """The number of the first tick at or after an instant."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    ago = micros(c) - micros(F.lit(start).cast("timestamp_ntz"))
    return F.ceil(ago / F.lit(every // timedelta(microseconds=1))).cast("bigint")


def sightings(spikes: DataFrame, env: str) -> DataFrame:
    """What detect.error_spikes() found, as transitions() and folded() take it."""
    return spikes.select(F.lit(env).alias("env"), "service", family("service", "step", "error_code").alias("family"), "tick", "started_at")


def runs(seen: DataFrame, start: datetime, every: timedelta, resolve_after: timedelta) -> DataFrame:
    """seen (env, service, family, tick, started_at and others: what was found at a tick, once for each family) with incident_id, tick_no, the incident's
    started_at, opened (whether it opens one) and, for its last row before a gap, what follows: recovering_no and resolved_no, the ticks at which it
    recovers and is resolved if nothing is seen before.

    An incident goes on until the tick that resolves it: the first one after its recovery that is resolve_after or more past its last sighting. That
    follows from two neighbouring sightings, so one window over a family's sightings folds any number of ticks.
    """
    own = Window.partitionBy(*KEY).orderBy("tick_no")
    rows = seen.withColumn("tick_no", _ticks(start, every, F.col("tick")))
    quiet = F.greatest(F.lit(2), F.ceil(F.lit(resolve_after / every))).cast("bigint")
    rows = rows.withColumn("recovering_no", F.col("tick_no") + 1).withColumn("resolved_no", F.col("tick_no") + quiet)
    before = F.lag("resolved_no").over(own)
    rows = rows.withColumn("opened", F.coalesce(before < F.col("tick_no"), F.lit(True)))
    rows = rows.withColumn("_run", F.sum(F.col("opened").cast("int")).over(own))
    first = F.first("started_at").over(Window.partitionBy(*KEY, "_run").orderBy("tick_no"))
    rows = rows.withColumn("started_at", first).withColumn("_next", F.lead("tick_no").over(own))
    return rows.withColumn("incident_id", incident_id(family_="family"))


def transitions(seen: DataFrame, start: datetime, every: timedelta, count: int, resolve_after: timedelta) -> DataFrame:
    """env, service, family, incident_id, tick, status, transition, started_at, last_seen: a row for each tick (start, and count - 1 more) at which an incident
    is seen or changes, as count calls of incidents.lifecycle() give them one after another."""
    rows = runs(seen, start, every, resolve_after)
    ends = F.coalesce("_next", F.lit(count).cast("bigint"))
    step = lambda no, status, transition: F.struct(no.alias("no"), F.lit(status).alias("status"), transition.alias("transition"))
    none = F.lit(None).cast("string")
    told = F.array(
        step(F.col("tick_no"), "active", F.when(F.col("opened"), "opened")),
        F.when(F.col("recovering_no") < ends, step(F.col("recovering_no"), "recovering", none)),
        F.when(F.col("resolved_no") < ends, step(F.col("resolved_no"), "resolved", F.lit("resolved")))
    )
    rows = rows.select(*KEY, "incident_id", "started_at", F.col("tick").alias("last_seen"), F.inline(F.filter(told, lambda x: x.isNotNull())))
    micros = F.unix_micros(F.lit(start).cast("timestamp_ntz").cast("timestamp")) + F.col("no") * F.lit(every // timedelta(microseconds=1))
    tick = F.timestamp_micros(micros).cast("timestamp_ntz")
    return rows.select(*KEY, "incident_id", tick.alias("tick"), "status", "transition", "started_at", "last_seen")


def folded(seen: DataFrame, start: datetime, every: timedelta, count: int, resolve_after: timedelta) -> DataFrame:
    """The store after all ticks: env, service, family, incident_id, status, started_at, last_seen, ticks (how often it was seen), recovering_at, resolved_at.
    An incident that opens again within five minutes of its first start has the same id, and is one row."""
    rows = transitions(seen, start, every, count, resolve_after)
    last = F.max_by(F.struct("status", "started_at", "last_seen"), "tick").alias("_last")
    when = lambda status: F.max(F.when(F.col("status") == status, F.col("tick")))
    sums = rows.groupBy(*KEY, "incident_id").agg(
        last, F.count_if(F.col("status") == "active").alias("ticks"), when("recovering").alias("recovering_at"), when("resolved").alias("resolved_at")
    )
    return sums.select(*KEY, "incident_id", "_last.status", "_last.started_at", "_last.last_seen", "ticks", "recovering_at", "resolved_at")
