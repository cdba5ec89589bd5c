"""Searches, pages, rollups and index views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import failed
from .trace import trace_facts

FAMILY = ("service", "step", "error_code")


def after(order: list[tuple[str, bool]], cursor: dict) -> Column:
    """The rows behind the cursor's, in an order of (column, descending)."""
    keep, same = F.lit(False), F.lit(True)
    for column, down in order:
        value = F.lit(cursor[column])
        keep = keep | (same & (F.col(column) < value if down else F.col(column) > value))
        same = same & (F.col(column) == value)
    return keep


def page(rows: DataFrame, order: list[tuple[str, bool]], limit: int, cursor: dict | None = None) -> DataFrame:
    """A keyset page, and _more, whether rows follow it: one row beyond the limit is looked for. cursor: the last row of the page before, None for the
    first page; an empty page has no rows. A null in a column of the order is on no page but the first."""
    rows = rows if cursor is None else rows.where(after(order, cursor))
    keys = [F.desc(c) if down else F.asc(c) for c, down in order]
    probe = rows.orderBy(*keys).limit(limit + 1)
    rank = F.row_number().over(Window.orderBy(*keys))  # over at most limit + 1 rows
    return probe.withColumn("_rank", rank).withColumn(
        "_more", F.max("_rank").over(Window.partitionBy(F.lit(1))) > limit
    ).where(F.col("_rank") <= limit).drop("_rank")


SEARCH_ORDER = [("ts_start", True), ("event_id", False)]
ERROR_ORDER = [("events", True), ("service", False), ("step", False), ("error_code", False)]
TRACE_ORDER = [("started", True), ("trace_id", False)]


def sample_traces(events: DataFrame, by: tuple[str, ...], most: int = 3) -> DataFrame:
    """samples: the traces of each group whose latest event is newest, ties by trace."""
    latest = events.groupBy(*by, "trace_id").agg(F.max("ts_start").alias("latest"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("latest"), "trace_id"))
    top = latest.withColumn("rank", rank).where(F.col("rank") <= most)
    return top.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "trace_id"))), lambda s: s["trace_id"]), ",").alias("samples")
    )


def error_rollup(matched: DataFrame) -> DataFrame:
    """Per family: events, distinct traces, distinct users (null where none is known), samples."""
    users = F.count_distinct("user_id")
    rows = matched.groupBy(*FAMILY).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("trace_id").alias("traces"), F.when(users > 0, users).alias("users")
    )
    return rows.join(sample_traces(matched, FAMILY), list(FAMILY))


def blast_radius(events: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: distinct matched traces; users and services over all events of those traces, whatever their status or time; the ten services with most
    traces, ties by name. Users are null where none is known. No match: no requests, users or services, and null top_services."""
    traces = matched.select("trace_id").distinct()
    whole = events.join(traces, "trace_id", "left_semi")
    users = F.count_distinct("user_id")
    sums = whole.agg(F.count_distinct("trace_id").alias("requests"), F.when(users > 0, users).alias("users"), F.count_distinct("service").alias("services"))
    top = whole.groupBy("service").agg(F.count_distinct("trace_id").alias("n")).orderBy(F.desc("n"), "service").limit(10)
    top = top.agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "service", "n"))),
                lambda s: F.concat(s["service"], F.lit(":"), s["n"].cast("string"))
            ),
            ","
        ).alias("top_services")
    )
    return sums.join(F.broadcast(top), F.lit(True))  # one row each


def top_services(events: DataFrame, matched: DataFrame, most: int = 10) -> DataFrame:
    whole = events.join(matched.select("trace_id").distinct(), "trace_id", "left_semi")
    return whole.groupBy("service").agg(F.count_distinct("trace_id").alias("traces")).orderBy(F.desc("traces"), "service").limit(most)


def nearest_rank(rows: DataFrame, by: tuple[str, ...], value: str, percent: int) -> DataFrame:
    """count and the value of integer rank (percent * n + 99) div 100, where null values come first; 0 where percent <= 0. No rows make no groups.

    Rows are counted by value within tasks first, and only distinct values are put in order, so a group with a third of all rows is no larger to sort
    than its number of values.
    """
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    if percent <= 0:
        return counts.groupBy(*by).agg(F.sum("_c").alias("count"), F.lit(0).cast("bigint").alias("latency_ms"))
    group = Window.partitionBy(*by)
    counts = counts.withColumn(
        "_upto", F.sum("_c").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_n", F.sum("_c").over(group))
    rank = F.expr(f"greatest(1, least(_n, ({percent} * _n + 99) div 100))")
    at = F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank), F.col(value))
    return counts.groupBy(*by).agg(F.sum("_c").alias("count"), F.max(at).alias("latency_ms"))


def service_stats(events: DataFrame, percent: int = 95) -> DataFrame:
    """Every status counts."""
    return nearest_rank(events, ("service",), "duration_ms", percent)


def service_index(events: DataFrame) -> DataFrame:
    seen = F.coalesce("ts_end", "ts_start")
    return events.groupBy("service").agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))


def error_index(events: DataFrame) -> DataFrame:
    seen = F.coalesce("ts_end", "ts_start")
    rows = events.where(failed() & F.col("error_code").isNotNull())
    return rows.groupBy(*FAMILY).agg(F.count(F.lit(1)).alias("failures"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))


def call_edges(events: DataFrame) -> DataFrame:
    """From a service to its steps' downstreams; suppressed events count for services only."""
    seen = F.coalesce("ts_end", "ts_start")
    steps = events.where("status <> 'suppressed'").select("service", seen.alias("seen"), F.explode("steps").alias("s")).where("s.downstream is not null")
    steps = steps.select(
        F.col("service").alias("from_service"), F.col("s.downstream.service").alias("to_service"), F.col("s.downstream.endpoint").alias("endpoint"),
        "seen"
    )
    return steps.groupBy("from_service", "to_service", "endpoint").agg(
        F.count(F.lit(1)).alias("calls"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen")
    )


def index_sizes(events: DataFrame) -> DataFrame:
    """One row: distinct events, traces, services, error families and calls (service, called service, endpoint)."""
    family = F.when(failed() & F.col("error_code").isNotNull(), F.concat_ws("|", *FAMILY))
    return events.agg(
        F.count_distinct("event_id").alias("events"), F.count_distinct("trace_id").alias("traces"), F.count_distinct("service").alias("services"),
        F.count_distinct(family).alias("errors")
    ).join(F.broadcast(call_edges(events).agg(F.count(F.lit(1)).alias("calls"))), F.lit(True))  # one row each


def minute_counters(events: DataFrame) -> DataFrame:
    return events.groupBy(
        F.date_trunc("minute", F.col("ts_start")).cast("timestamp_ntz").alias("minute")
    ).agg(F.count(F.lit(1)).alias("total"), F.count_if(failed()).alias("errors"))


def counter_sum(counters: DataFrame, now: Column, minutes: int, kept: int = 120) -> DataFrame:
    """One row: total and errors of the minutes from the one that holds `now` less the window, up to now; zeros where the window is longer than what
    is kept."""
    since = F.date_trunc("minute", now - F.make_dt_interval(mins=F.lit(minutes)))
    rows = counters.where((F.col("minute") >= since) & (F.col("minute") <= now) & F.lit(minutes <= kept))
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "errors")])


def error_rate(events: DataFrame, since, until, service: str | None = None) -> DataFrame:
    rows = events.where((F.col("ts_start") >= since) & (F.col("ts_start") <= until))
    rows = rows if service is None else rows.where(F.col("service") == service)
    return rows.agg(F.count(F.lit(1)).alias("requests"), F.count_if(failed()).alias("failures"))


def trace_summaries(events: DataFrame, include_suppressed: bool = False) -> DataFrame:
    """Per trace: first start, last end, length in whole ms, events, services in order of first use in the trace's order, the status of its anchor
    event, and anchor, that one's family (null where it has none). Traces without an anchor event, as all of theirs are suppressed, have no row."""
    sums = events.groupBy("trace_id").agg(
        F.min("ts_start").alias("started"), F.max(F.coalesce("ts_end", "ts_start")).alias("ended"), F.count(F.lit(1)).alias("events")
    )
    length = F.floor((F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1000)
    facts = trace_facts(events, not include_suppressed).where("event_id is not null")
    return sums.join(facts, "trace_id").select(
        "trace_id", "started", "ended", F.greatest(F.lit(0), length).cast("bigint").alias("duration_ms"), "events",
        F.array_join("services", ",").alias("services"), "status", "anchor"
    )


def recent_traces(events: DataFrame, matched: DataFrame, include_suppressed: bool = False) -> DataFrame:
    """Summaries, over all of their events, of the traces in which some event matched. page() with TRACE_ORDER puts the newest first."""
    return trace_summaries(events.join(matched.select("trace_id").distinct(), "trace_id", "left_semi"), include_suppressed)
