"""Error, traffic and latency detectors over four adjacent look-back windows, each compared with its three predecessors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import failed
from .reads import FAMILY, nearest_rank


@dataclass(frozen=True)
class Windows:
    """For each tick the current window (w 0) and the three before it (w 1 to 3), all of one length. A window ends where the one after it starts, and
    both ends count, so an event at a boundary is in two."""

    ticks: tuple[datetime, ...]
    length: timedelta


def windows(ticks: Sequence[datetime], length: timedelta) -> Windows:
    return Windows(tuple(sorted(set(ticks))), length)


def in_windows(events: DataFrame, table: Windows) -> DataFrame:
    """Each event, with tick and w, once for each window that holds it.

    The least and the largest instant of all windows are constants that reach the scan, and an event's windows follow from its
    time by arithmetic: no join. Events without a start are in none.
    """
    if not table.ticks:
        return events.select("*", F.lit(None).cast("timestamp_ntz").alias("tick"), F.lit(0).alias("w")).where("false")
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    rows = events.where((F.col("ts_start") >= at(table.ticks[0] - 4 * table.length)) & (F.col("ts_start") <= at(table.ticks[-1])))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    length = table.length // timedelta(microseconds=1)

    def held(tick: datetime) -> Column:
        ago = micros(at(tick)) - micros(F.col("ts_start"))
        w = F.floor(ago / length)
        row = lambda k: F.struct(at(tick).alias("tick"), k.cast("int").alias("w"))
        return F.array(F.when((ago >= 0) & (w < 4), row(w)), F.when((ago > 0) & (ago % length == 0) & (w <= 4), row(w - 1)))

    own = F.filter(F.flatten(F.array(*[held(t) for t in table.ticks])), lambda x: x.isNotNull())
    return rows.select("*", F.inline(own))


def median3(*values: Column) -> Column:
    return F.sort_array(F.array(*values))[1]


def _per_window(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = [F.count_if(F.col("w") == k).alias(f"n{k}") for k in range(4)]
    return rows.groupBy("tick", *by).agg(*counts).withColumn("baseline", median3(F.col("n1"), F.col("n2"), F.col("n3")))


def error_spikes(
    events: DataFrame, table: Windows, min_count: int = 5, min_lift: float = 3.0, min_rate: float = 0.0, minutes: float = 10.0, most: int = 200
) -> DataFrame:
    """Families whose current window has min_count errors and min_lift times the median of the three before; with no errors before, the lift is the
    count. started_at: the earliest of the current window's errors. Each window is read as its `most` largest families."""
    rows = in_windows(events.where(failed() & F.col("error_code").isNotNull()), table)
    sizes = rows.groupBy("tick", "w", *FAMILY).agg(F.count(F.lit(1)).alias("n"), F.min("ts_start").alias("first_at"))
    rank = F.row_number().over(Window.partitionBy("tick", "w").orderBy(F.desc("n"), *FAMILY))
    sizes = sizes.withColumn("rank", rank).where(F.col("rank") <= most)
    counts = [F.coalesce(F.sum(F.when(F.col("w") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(4)]
    wide = sizes.groupBy("tick", *FAMILY).agg(*counts, F.min(F.when(F.col("w") == 0, F.col("first_at"))).alias("started_at"))
    wide = wide.withColumn("baseline", median3(F.col("n1"), F.col("n2"), F.col("n3")))
    lift = F.when(F.col("baseline") > 0, F.col("n0") / F.col("baseline")).otherwise(F.col("n0").cast("double"))
    spike = (F.col("n0") >= min_count) & (F.col("n0") / F.lit(float(minutes)) >= min_rate) & ((F.col("baseline") == 0) | (lift >= min_lift))
    return wide.withColumn("lift", lift).where(spike)


def traffic(events: DataFrame, table: Windows, min_volume: int = 20, drop: float = 0.5, surge: float = 3.0) -> DataFrame:
    """tick, service, n0, baseline and direction (drop, surge or null) of services with enough traffic before; a service absent from a window has none
    there."""
    wide = _per_window(in_windows(events, table), ("service",)).where(F.col("baseline") >= min_volume)
    direction = F.when(F.col("n0") <= drop * F.col("baseline"), "drop").when((F.lit(surge) > 0) & (F.col("n0") >= surge * F.col("baseline")), "surge")
    return wide.withColumn("direction", direction)


def latency(events: DataFrame, table: Windows, percent: int = 95, min_requests: int = 50, factor: float = 2.0, min_ms: int = 0) -> DataFrame:
    """tick, service, latency_ms, baseline_ms, anomalous: the current percentile against the lower median of the windows before that have enough
    requests, of which there must be two."""
    stats = nearest_rank(in_windows(events, table), ("tick", "w", "service"), "duration_ms", percent).where(F.col("count") >= min_requests)
    wide = stats.groupBy("tick", "service").agg(
        F.max(F.when(F.col("w") == 0, F.col("latency_ms"))).alias("latency_ms"),
        F.sort_array(F.collect_list(F.when(F.col("w") > 0, F.col("latency_ms")))).alias("before")
    )
    wide = wide.where(F.col("latency_ms").isNotNull() & (F.size("before") >= 2))
    base = F.get("before", ((F.size("before") - 1) / 2).cast("int"))
    return wide.select(
        "tick", "service", "latency_ms", base.alias("baseline_ms"),
        ((base > 0) & (F.col("latency_ms") >= factor * base) & (F.col("latency_ms") >= min_ms)).alias("anomalous")
    )


def sustained(ticks: DataFrame, by: Sequence[str], state: str, need: int = 2, order: str = "tick_no") -> DataFrame:
    """The rows whose state is the need-th or later of its run: equal states at consecutive tick numbers. A null state, or a tick without a row, ends
    a run."""
    group = Window.partitionBy(*by, state).orderBy(order)
    runs = ticks.where(F.col(state).isNotNull()).withColumn("_run", F.col(order) - F.row_number().over(group))
    place = F.row_number().over(Window.partitionBy(*by, state, "_run").orderBy(order))
    return runs.withColumn("run_length", place).where(F.col("run_length") >= need).drop("_run")
