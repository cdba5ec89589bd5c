"""Detectors and incidents in a stream, held against the batch detectors and a plain fold."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gritstone.operators import detect, fold, incidents
from gritstone.streaming import watch

T0, EVERY, LENGTH = datetime(2024, 1, 1), timedelta(minutes=5), timedelta(minutes=10)
SCHEMA = "ts_start timestamp_ntz, service string, status string, step string, error_code string, duration_ms bigint"
TICKS = [T0 + k * EVERY for k in range(1, 22)]


def stories():
    """Two services and three families over 100 minutes, with bursts, silences, and events at the very ends of windows."""
    rng, rows = random.Random(3), []
    for minute in range(0, 125):
        at = T0 + timedelta(minutes=minute)
        burst = minute in range(22, 31) or minute in range(60, 66) or minute in range(90, 93)
        for _ in range(rng.randrange(5, 9) if burst else rng.randrange(0, 2)):
            rows.append((at + timedelta(seconds=rng.randrange(60)), "pay", "error", "charge", "E1", 50))
        if minute % 10 == 0:
            rows += [(at, "pay", "timeout", "charge", "E2", 10)] * (6 if minute in (40, 50) else 1)
        for _ in range(2 if 45 <= minute < 70 else 40 if 80 <= minute < 90 else 12):
            slow = 100 <= minute < 112
            rows.append((at + timedelta(seconds=rng.randrange(60), microseconds=rng.randrange(10**6)), "cart", "ok", None, None, rng.randrange(200, 400) if slow else rng.randrange(5, 100)))
    rows.append((T0 + timedelta(minutes=300), "end", "ok", None, None, 1))  # moves the watermark past the last tick
    return rows


def write(folder, name, rows):
    with open(folder / name, "w") as out:
        for at, *rest in rows:
            out.write(json.dumps(dict(zip(("service", "status", "step", "error_code", "duration_ms"), rest, strict=True)) | {"ts_start": at.isoformat()}) + "\n")


def streamed(spark, tmp_path, rule, parts, **more):
    """Rows of the stream over these parts, each in a run of its own: every run starts from the last one's checkpoint."""
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    out, seen = str(tmp_path / "out"), 0
    for k, rows in enumerate(parts):
        write(folder, f"{k:03}.json", rows)
        lines = spark.readStream.schema(SCHEMA).json(str(folder))
        rows = watch.watch(lines, rule, "prod", EVERY, LENGTH, late="5 minutes", **more)
        query = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out)
        query.awaitTermination(300)
        assert not query.isActive
    return spark.read.schema(rows.schema).parquet(out).where(F.col("tick") <= F.lit(TICKS[-1])).cache()


@pytest.mark.parametrize("cuts", [(), (300, 301, 900)])
def test_spikes_and_incidents_equal_the_batch(spark, tmp_path, cuts):
    rows = stories()
    parts = [rows[a:b] for a, b in zip((0, *cuts), (*cuts, len(rows)), strict=True)]
    quiet = timedelta(minutes=10)
    got = streamed(spark, tmp_path, watch.Spikes(), parts, resolve_after=quiet)
    events = spark.createDataFrame(rows, SCHEMA)
    spikes = detect.error_spikes(events, detect.windows(TICKS, LENGTH)).cache()
    key = lambda r: (r.service, r.step, r.error_code, r.tick, r[4], r.baseline, r.lift)
    want = sorted(map(key, spikes.select("service", "step", "error_code", "tick", "n0", "baseline", "lift").collect()))
    assert sorted(map(key, got.where("seen").select("service", "step", "error_code", "tick", "current", "baseline", "lift").collect())) == want and len(want) > 8

    # the same incidents as a call of lifecycle() for each tick
    first = events.where("status <> 'ok'").selectExpr("service", "step", "error_code", "ts_start AS at")
    held = spikes.select("service", "step", "error_code", "tick").join(first, ["service", "step", "error_code"]).where(
        F.col("at").between(F.col("tick") - F.expr("interval 10 minutes"), F.col("tick"))
    ).groupBy("service", "step", "error_code", "tick").agg(F.min("at").alias("started_at"))
    seen = held.select(F.lit("prod").alias("env"), "service", incidents.family("service", "step", "error_code").alias("family"), "tick", "started_at").cache()
    wanted = plain([r.asDict() for r in seen.collect()], TICKS, quiet)
    told = {(r.family, r.tick): (r.status, r.transition, r.started_at) for r in got.withColumn("family", incidents.family("service", "step", "error_code")).collect()}
    assert told == wanted and {t for _, t, _ in wanted.values()} == {None, "opened", "resolved"}
    folded = fold.transitions(seen, TICKS[0], EVERY, len(TICKS), quiet).collect()
    assert {(r.family, r.tick): (r.status, r.transition, r.started_at) for r in folded} == wanted
    assert {r.incident_id for r in folded} == {r.incident_id for r in got.collect()}


def plain(seen, ticks, quiet):
    """Tick by tick: what each family's incident is."""
    at = {(r["family"], r["tick"]): r["started_at"] for r in seen}
    state, out = {}, {}
    for t in ticks:
        for f in sorted({f for f, _ in at}):
            old = state.get(f)
            if (f, t) in at:
                state[f] = ("active", old[1] if old else at[f, t], t)
                out[f, t] = ("active", None if old else "opened", state[f][1])
            elif old and old[0] == "active":
                state[f] = ("recovering", *old[1:])
                out[f, t] = ("recovering", None, old[1])
            elif old and t - old[2] >= quiet:
                del state[f]
                out[f, t] = ("resolved", "resolved", old[1])
    return out


def test_traffic_in_runs(spark, tmp_path):
    rows = stories()
    got = streamed(spark, tmp_path, watch.Traffic(), [rows[:700], rows[700:]], need=2)
    found = detect.traffic(spark.createDataFrame(rows, SCHEMA), detect.windows(TICKS, LENGTH)).where("direction is not null")
    numbered = found.withColumn("tick_no", (F.unix_seconds(F.col("tick").cast("timestamp")) / 300).cast("int"))
    want = detect.sustained(numbered, ["service"], "direction", 2)
    key = lambda r: (r.service, r.tick, r[2], r.baseline, r[4], r[5])
    code = F.when(F.col("direction") == "drop", "TRAFFIC_DROP").otherwise("TRAFFIC_SURGE")
    want = sorted(map(key, want.select("service", "tick", "n0", "baseline", code, "run_length").collect()))
    assert sorted(map(key, got.where("seen").select("service", "tick", "current", "baseline", "error_code", "run").collect())) == want
    assert {r[4] for r in want} == {"TRAFFIC_DROP", "TRAFFIC_SURGE"}
    assert got.where("status = 'resolved'").count() >= 1


def test_latency(spark, tmp_path):
    rows = stories()
    got = streamed(spark, tmp_path, watch.Latency(), [rows])
    want = detect.latency(spark.createDataFrame(rows, SCHEMA), detect.windows(TICKS, LENGTH)).where("anomalous")
    key = lambda r: (r.service, r.tick, r[2], r[3])
    want = sorted(map(key, want.select("service", "tick", "latency_ms", "baseline_ms").collect()))
    assert sorted(map(key, got.where("seen").select("service", "tick", "current", "baseline").collect())) == want and want


def test_fold_of_many_ticks(spark):
    """Random sightings, gaps of every length, and resolving times on either side of them."""
    rng = random.Random(5)
    ticks = [T0 + k * EVERY for k in range(28)]
    rows = [("prod", "s", f"s:{f}:c", t, t - timedelta(seconds=rng.randrange(600))) for f in range(30) for t in ticks if rng.random() < (f + 1) / 32]
    seen = spark.createDataFrame(rows, "env string, service string, family string, tick timestamp_ntz, started_at timestamp_ntz")
    for quiet in (timedelta(0), timedelta(minutes=2), timedelta(minutes=11), timedelta(minutes=20)):
        want = plain([dict(zip(("env", "service", "family", "tick", "started_at"), r, strict=True)) for r in rows], ticks, quiet)
        got = fold.transitions(seen, ticks[0], EVERY, 28, quiet).collect()
        assert len(got) == len(want) and {(r.family, r.tick): (r.status, r.transition, r.started_at) for r in got} == want
        store = {(r.family, r.incident_id): r for r in fold.folded(seen, ticks[0], EVERY, 28, quiet).collect()}
        assert len(store) == len({(r.family, r.incident_id) for r in got})
        for (f, i), r in store.items():
            own = [x for x in got if (x.family, x.incident_id) == (f, i)]
            assert (r.status, r.ticks) == (max(own, key=lambda x: x.tick).status, sum(x.status == "active" for x in own))
    assert fold.transitions(seen.limit(0), ticks[0], EVERY, 28, quiet).collect() == []
