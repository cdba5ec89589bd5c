"""Detectors and incidents as state of a stream: every tick merges the counts that arrived since the last one, and nothing stored is read again.

Events are counted by bucket, a tick's length each, within tasks before they are shuffled; a key's state holds the buckets of four windows and its
open incidents. Ticks are the multiples of that length. A timer runs a key's ticks once the watermark says that their counts are whole, so results
follow from the events alone, and not from how they come in batches; after a restart they go on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.filters import failed
from ..operators.incidents import family, incident_id
from ..operators.state import LATENCY_CODE, LATENCY_STEP, TRAFFIC_CODES, TRAFFIC_STEP

#: A window's counts by value (a duration, or 0 where only their sum matters).
Counts = dict[int, int]
FACTS = "service string, step string, error_code string, tick timestamp_ntz, current bigint, baseline bigint, lift double, seen boolean, run int, status string, transition string, started_at timestamp_ntz, last_seen timestamp_ntz"


FACT = Row(*[part.split()[0] for part in FACTS.split(", ")])


@dataclass(frozen=True)
class Found:
    """What a rule says of a tick: the code of what is odd (None: nothing), and the numbers."""

    code: str | None
    current: int
    baseline: int
    lift: float


def _median(values: list[int]) -> int:
    return sorted(values)[(len(values) - 1) // 2]


@dataclass(frozen=True)
class Spikes:
    """Error spikes of a family, as detect.error_spikes() has them, without a cap on families."""

    min_count: int = 5
    min_lift: float = 3.0
    min_rate: float = 0.0
    minutes: float = 10.0

    def find(self, windows: list[Counts]) -> Found:
        now, *before = (sum(w.values()) for w in windows)
        base = _median(before)
        lift = now / base if base > 0 else float(now)
        odd = now >= self.min_count and now / self.minutes >= self.min_rate and (base == 0 or lift >= self.min_lift)
        return Found("" if odd else None, now, base, lift)


@dataclass(frozen=True)
class Traffic:
    """Drops and surges of a service's requests, as detect.traffic() has them."""

    min_volume: int = 20
    drop: float = 0.5
    surge: float = 3.0

    def find(self, windows: list[Counts]) -> Found:
        now, *before = (sum(w.values()) for w in windows)
        base = _median(before)
        way = None
        if base >= self.min_volume:
            way = "drop" if now <= self.drop * base else "surge" if self.surge > 0 and now >= self.surge * base else None
        lift = base / max(now, 1) if way == "drop" else now / max(base, 1)
        return Found(way and TRAFFIC_CODES[way], now, base, lift)


@dataclass(frozen=True)
class Latency:
    """Spikes of a percentile of a service's durations, by nearest rank over the merged counts of its buckets, as detect.latency() has them."""

    percent: int = 95
    min_requests: int = 50
    factor: float = 2.0
    min_ms: int = 0

    def rank(self, counts: Counts) -> int:
        left = -(-self.percent * sum(counts.values()) // 100)
        for value in sorted(counts):
            left -= counts[value]
            if left <= 0:
                return value
        return 0

    def find(self, windows: list[Counts]) -> Found:
        enough = [sum(w.values()) >= self.min_requests for w in windows]
        before = [self.rank(w) for w, on in zip(windows[1:], enough[1:], strict=True) if on]
        now = self.rank(windows[0]) if enough[0] else 0
        base = _median(before) if len(before) >= 2 else 0
        odd = enough[0] and base > 0 and now >= self.factor * base and now >= self.min_ms
        return Found(LATENCY_CODE if odd else None, now, base, now / max(base, 1))


class Watch(StatefulProcessor):
    """A key's buckets, the run of its oddity, and its open incidents by code. Times are microseconds."""

    def __init__(self, rule: Spikes | Traffic | Latency, every: timedelta, length: timedelta, resolve_after: timedelta, need: int):
        if length % every:
            raise ValueError("a window is some whole ticks long")
        self.rule, self.need = rule, need
        self.every, self.length, self.quiet = (t // timedelta(microseconds=1) for t in (every, length, resolve_after))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "at bigint", "value array<bigint>, n array<bigint>, edge array<bigint>, first bigint")
        self.open = handle.getMapState("open", "code string", "status string, started bigint, last_seen bigint")
        self.place = handle.getValueState("place", "next bigint, code string, run int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fresh: dict[int, list] = {}
        for row in rows:
            held = fresh.setdefault(row.at, [{}, {}, row.first])
            held[0][row.value] = held[0].get(row.value, 0) + row.n
            held[1][row.value] = held[1].get(row.value, 0) + row.edge
            held[2] = min(held[2], row.first)
        for at, (n, edge, first) in fresh.items():  # a bucket is whole when it comes, so it comes once
            values = sorted(n)
            self.buckets.updateValue((at,), (values, [n[v] for v in values], [edge[v] for v in values], first))
        if fresh and not self.place.exists():
            self._wait(min(fresh), None, 0)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.place.exists():
            return
        tick, code, run = self.place.get()
        held = {k[0]: v for k, v in self.buckets.iterator()}
        open_ = {k[0]: list(v) for k, v in self.open.iterator()}
        whole = timerValues.getCurrentWatermarkInMs() * 1000
        while tick + self.every < whole:
            found = self.rule.find([self._counts(held, tick - w * self.length) for w in range(4)])
            run = 0 if found.code is None else run + 1 if found.code == code else 1
            code = found.code
            yield from self._turn(key, tick, found, run, held, open_)
            tick += self.every
            for at in [a for a in held if a < tick - 4 * self.length]:
                del held[at]
                self.buckets.removeKey((at,))
            if not open_ and not any(a < tick for a in held):
                if not held:
                    self.place.clear()
                    return
                tick, code, run = max(tick, min(held)), None, 0  # nothing can be odd until there are counts again
        self._wait(tick, code, run)

    def _counts(self, held: dict[int, Any], end: int) -> Counts:
        """Of the window that ends at `end`: both its ends count."""
        out: Counts = {}
        for at in range(end - self.length, end + 1, self.every):
            if at in held:
                value, n, edge, _ = held[at]
                for v, c in zip(value, edge if at == end else n, strict=True):
                    if c:
                        out[v] = out.get(v, 0) + c
        return out

    def _turn(self, key: Any, tick: int, found: Found, run: int, held: dict[int, Any], open_: dict[str, list]) -> Iterator[Row]:
        """Rows of what is seen at this tick, and of open incidents that recover or are resolved."""
        at = lambda micros: datetime.fromtimestamp(micros / 1_000_000, timezone.utc).replace(tzinfo=None)
        names = tuple(key) if len(tuple(key)) == 3 else (key[0], LATENCY_STEP if isinstance(self.rule, Latency) else TRAFFIC_STEP)

        def row(code: str, seen: bool, transition: str | None) -> Row:
            status, started, last = open_[code]
            whose = names if len(names) == 3 else (*names, code)
            numbers = (found.current, found.baseline, found.lift) if seen else (None, None, None)
            return FACT(*whose, at(tick), *numbers, seen, run if seen else None, status, transition, at(started), at(last))

        code = found.code if found.code is not None and run >= self.need else None
        if code is not None:
            new = code not in open_
            starts = [b[3] for a, b in held.items() if tick - self.length <= a < tick] + [a for a, b in held.items() if a == tick and sum(b[2])]
            started = (min(starts, default=tick) if len(names) == 3 else tick) if new else open_[code][1]
            open_[code] = ["active", started, tick]
            self.open.updateValue((code,), tuple(open_[code]))
            yield row(code, True, "opened" if new else None)
        for other in [c for c in open_ if c != code]:
            status, started, last = open_[other]
            if status == "active":
                open_[other] = ["recovering", started, last]
                self.open.updateValue((other,), tuple(open_[other]))
                yield row(other, False, None)
            elif tick - last >= self.quiet:
                open_[other][0] = "resolved"
                yield row(other, False, "resolved")
                del open_[other]
                self.open.removeKey((other,))

    def _wait(self, tick: int, code: str | None, run: int) -> None:
        self.place.update((tick, code, run))
        self.handle.registerTimer((tick + self.every) // 1000)

    def close(self) -> None:
        pass


def bucket_counts(events: DataFrame, rule: Spikes | Traffic | Latency, every: timedelta, late: str) -> DataFrame:
    """Of each key and bucket: at (its start), value, n, edge (the events at its very start) and first (its earliest event)."""
    micros = F.unix_micros(F.col("ts_start").cast("timestamp"))
    if isinstance(rule, Spikes):
        rows, keys, value = events.where(failed() & F.col("error_code").isNotNull()), ["service", "step", "error_code"], F.lit(0).cast("bigint")
    else:
        rows, keys = events, ["service"]
        value = F.col("duration_ms").cast("bigint") if isinstance(rule, Latency) else F.lit(0).cast("bigint")
    if isinstance(rule, Latency):
        rows = rows.where("duration_ms is not null")
    rows = rows.select(*keys, value.alias("value"), F.col("ts_start").cast("timestamp").alias("ts_start"), micros.alias("_at")).withWatermark("ts_start", late)
    length = every // timedelta(microseconds=1)
    window = F.window("ts_start", f"{length} microseconds")
    counts = rows.groupBy(window, *keys, "value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_at") % length == 0).alias("edge"), F.min("_at").alias("first")
    )
    return counts.select(
        *[F.coalesce(k, F.lit("")).alias(k) for k in keys], F.unix_micros("window.start").alias("at"), "value", "n", "edge", "first",
        F.window_time("window").alias("event_time")
    )


def watch(
    events: DataFrame, rule: Spikes | Traffic | Latency, env: str = "", every: timedelta = timedelta(seconds=30), length: timedelta = timedelta(minutes=10),
    resolve_after: timedelta = timedelta(minutes=2), need: int = 1, late: str = "1 minute"
) -> DataFrame:
    """A row for each tick at which something is seen and each change of an incident that isn't: incident_id, env, service, step, error_code, tick,
    current, baseline and lift (null where not seen), seen, run, status (active, recovering, resolved), transition (opened, resolved or null),
    started_at, last_seen.

    events: a stream with ts_start, service, status, step, error_code and duration_ms. A rule's finding counts from the need-th tick of its run on. An
    open incident that isn't seen recovers, and is resolved at the first later tick that is resolve_after or more past its last one; seen again before
    that, it goes on under its id. Errors start at their window's earliest event, other incidents at their tick. Events that come later than `late`
    after the newest one are dropped by the watermark; null names count as ''. A tick is told once the watermark is past it by two ticks.
    Its state is kept by RocksDB, which this sets for the session. A key's state is the counts of four windows: of durations, the distinct ones.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    counts = bucket_counts(events, rule, every, late)
    keys = ["service", "step", "error_code"] if isinstance(rule, Spikes) else ["service"]
    rows = counts.groupBy(*keys).transformWithState(
        statefulProcessor=Watch(rule, every, length, resolve_after, need), outputStructType=FACTS, outputMode="Append", timeMode="EventTime"
    )
    rows = rows.withColumn("env", F.lit(env)).withColumn("family", family("service", "step", "error_code"))
    return rows.select(
        incident_id().alias("incident_id"), "env", "service", "step", "error_code", "tick", "current", "baseline", "lift", "seen", "run", "status",
        "transition", "started_at", "last_seen"
    )
