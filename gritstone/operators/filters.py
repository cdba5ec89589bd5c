"""Predicates, validation, dedup and sampling."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FAILED


def failed(status: str | Column = "status") -> Column:
    return (F.col(status) if isinstance(status, str) else status).isin(*FAILED)


def in_window(since=None, until=None, column: str = "ts_start") -> Column:
    """Both ends count; None is unbounded."""
    keep = F.lit(True)
    if since is not None:
        keep = keep & (F.col(column) >= since)
    if until is not None:
        keep = keep & (F.col(column) <= until)
    return keep


def event_filter(
    service: str | None = None, trace_id: str | None = None, error_code: str | None = None, statuses: Iterable[str] = (), suppressed: bool = False,
    since=None, until=None
) -> Column:
    """Suppressed events are left out unless asked for, by flag or by status."""
    keep = in_window(since, until)
    for column, value in (("service", service), ("trace_id", trace_id), ("error_code", error_code)):
        if value:
            keep = keep & (F.col(column) == value)
    statuses = tuple(statuses)
    if statuses:
        return keep & F.col("status").isin(*statuses)
    return keep if suppressed else keep & (F.col("status") != "suppressed")


def rollup_filter(service: str | None = None, statuses: Iterable[str] = (), since=None, until=None) -> Column:
    """Failed events with an anchor; error code and trace have no say here."""
    keep = F.col("error_code").isNotNull() & failed() & in_window(since, until)
    if tuple(statuses):
        keep = keep & F.col("status").isin(*statuses)
    return keep & (F.col("service") == service) if service else keep


def blast_filter(error_code: str, service: str | None = None, step: str | None = None, since=None, until=None) -> Column:
    """One family where service and step are given, else every family of the code."""
    keep = F.col("error_code").isNotNull() & failed() & in_window(since, until) & (F.col("error_code") == error_code)
    return keep & (F.col("service") == service) & (F.col("step") == step) if service and step else keep


def dedup_first(events: DataFrame, key: str = "event_id", order: str = "seq") -> DataFrame:
    """The first row of each key stays, and every row whose key is null or '': such rows have never been seen."""
    named = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    rank = F.row_number().over(Window.partitionBy(key, F.when(~named, F.col(order))).orderBy(order))
    return events.withColumn("_rank", rank).where(~named | (F.col("_rank") == 1)).drop("_rank")


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes of a text."""
    digits = F.hex(F.encode(text, "UTF-8"))
    places = F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1)
    start = F.lit(0x811C9DC5).cast("bigint")

    def step(acc: Column, k: Column) -> Column:
        byte = F.conv(F.substring(digits, k * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
        return acc.bitwiseXOR(byte) * F.lit(0x01000193).cast("bigint") % F.lit(1 << 32)

    return F.when(F.length(digits) == 0, start).otherwise(F.aggregate(places, start, step))


def head_sample(events: DataFrame, percent: int = 2, slow_ms: int = 400, salt: str = "sample", vip: Column | None = None) -> DataFrame:
    """Failed, slow and VIP events stay; of the rest, those whose salted trace hash falls below the percentage."""
    sure = failed() | F.coalesce(F.col("duration_ms") >= slow_ms, F.lit(False))
    sure = sure if vip is None else sure | F.coalesce(vip, F.lit(False))
    return events.where(F.when(sure, True).otherwise(fnv1a32(F.concat(F.lit(salt), "trace_id")) % 100 < percent))  # the hash is made for the others only


def cap_per_second(events: DataFrame, most: int, priority: Column, order: str = "seq") -> DataFrame:
    """At most so many events of each second that have no priority; those with it all stay, and aren't put in order. A null priority is none; events
    without a start are one second's. Of a second's events no more than the cap of each task are put in order in one place."""
    sure = F.coalesce(priority, F.lit(False))
    second = Window.partitionBy(F.date_trunc("second", "ts_start")).orderBy(order)
    capped = events.where(~sure).withColumn("_place", F.row_number().over(second)).where(F.col("_place") <= most).drop("_place")
    return events.where(sure).unionByName(capped)


def cold_search(
    events: DataFrame, trace_id=None, user_id=None, service=None, error_code=None, since=None, until=None, before_id=None, limit: int = 50
) -> DataFrame:
    """Newest ids first, with the number of all matches."""
    keep = in_window(since, until)
    for column, value in (("trace_id", trace_id), ("user_id", user_id), ("service", service), ("error_code", error_code)):
        if value:
            keep = keep & (F.col(column) == value)
    matched = events.where(keep)
    page = matched if before_id is None else matched.where(F.col("event_id") < before_id)
    return page.orderBy(F.desc("event_id")).limit(limit).crossJoin(F.broadcast(matched.agg(F.count(F.lit(1)).alias("total"))))  # one row


def signal_query(
    signals: DataFrame, service=None, env=None, source=None, reason=None, types: Iterable[str] = (), since=None, until=None, limit: int = 200
) -> DataFrame:
    """Newest first, then larger ids; at most 200. A filter that is given leaves out signals whose value is null; bounds leave out those without a
    time. No signals give none."""
    keep = in_window(since, until, "timestamp")
    for column, value in (("service", service), ("env", env), ("source", source), ("reason", reason)):
        if value:
            keep = keep & (F.col(column) == value)
    if tuple(types):
        keep = keep & F.col("type").isin(*types)
    return signals.where(keep).orderBy(F.desc("timestamp"), F.desc("signal_id")).limit(min(limit, 200))


def deploy_window(deployments: DataFrame, since=None, until=None, service: str | None = None) -> DataFrame:
    """Deployments first seen within the bounds (both count), newest first, ties by id. Bounds leave out those without first_seen, which else come
    last."""
    keep = in_window(since, until, "first_seen")
    return deployments.where(keep & (F.col("service") == service) if service else keep).orderBy(F.desc("first_seen"), "id")
