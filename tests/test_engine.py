"""Golden cases of the operators, on hand-built events."""

import json
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gritstone.operators import correlate, detect, filters, incidents, reads, state, trace
from gritstone.plans import report, reports

T0 = datetime(2024, 1, 1, 12)
EVENTS = "event_id string, ts_start timestamp_ntz, ts_end timestamp_ntz, duration_ms bigint, service string, env string, version string, trace_id string, parent_span_id string, status string, step string, error_code string, user_id string, seq bigint"


def event(n, at=0, service="checkout", status="ok", trace_id="t", parent="", step=None, code=None, user=None, ms=10, version="v1"):
    start = T0 + timedelta(seconds=at)
    return (f"e{n}", start, start + timedelta(milliseconds=ms), ms, service, "prod", version, trace_id, parent, status, step, code, user, n)


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def as_dicts(*rows):
    return [
        {
            "event_id": f"e{r[13]}", "ts_start": r[1], "service": r[4], "parent_span_id": r[8], "status": r[9], "spans": [f"s{r[13]}"], "seq": r[13]
        } for r in rows
    ]


def test_causal_order():
    leaf, child, root = event(3, 0, parent="s2"), event(2, 1, parent="s1"), event(1, 2)
    out, linkage = trace.ordered(as_dicts(leaf, child, root))
    assert [e["event_id"] for e in out] == ["e1", "e2", "e3"] and linkage == "causal"


def test_orphan_falls_back_to_time():
    out, linkage = trace.ordered(as_dicts(event(1, 2), event(2, 1, parent="missing")))
    assert [e["event_id"] for e in out] == ["e2", "e1"] and linkage == "timestamp_fallback"


def test_cycle_falls_back():
    out, linkage = trace.ordered(as_dicts(event(1, 0, parent="s2"), event(2, 1, parent="s1")))
    assert linkage == "timestamp_fallback" and len(out) == 2


def test_deepest_failed_leaf():
    got, linkage = trace.anchor(as_dicts(event(1, 0, status="error"), event(2, 1, status="error", parent="s1"), event(3, 2, status="error", parent="s2")))
    assert got["event_id"] == "e3" and linkage == "causal"


def test_suppressed_root():
    rows = as_dicts(event(1, 0, status="suppressed"), event(2, 1, parent="missing"))
    assert trace.anchor(rows, exclude_suppressed=False)[0]["event_id"] == "e1"
    assert trace.anchor(rows)[0]["event_id"] == "e2"
    assert trace.anchor(rows[:1])[0] is None


STORY = "event_id string, status string, anchor struct<step:string,error_code:string>, steps array<struct<name:string,span_id:string,start_ms:bigint,duration_ms:bigint,status:string,downstream:struct<service:string,endpoint:string>>>, logs array<struct<ts_offset_ms:bigint,level:string,msg:string>>"


def test_story_window(spark):
    step = lambda name, a, b, status="ok", call=None: (name, "", a, b - a, status, call)
    steps = [step("prepare", 0, 5), step("pay", 10, 15, "error", ("db", "/q")), step("pay", 20, 25, "error", ("db", "/q")), step("cleanup", 30, 35)]
    logs = [(4, "warn", "a"), (24, "error", "b"), (31, "warn", "c"), (12, "info", "d")]
    rows = [
        ("e", "error", ("pay", "X"), steps, logs), ("n", "ok", None, [step("b", 9, 10), step("a", 1, 2)], logs),
        ("o", "error", ("gone", "X"), steps[::-1], logs), ("q", "suppressed", None, steps, logs), ("r", "ok", None, None, None)
    ]
    e, n, o, q, r = trace.stories(spark.createDataFrame(rows, STORY)).orderBy("event_id").collect()
    assert [s.name for s in e.path] == ["prepare", "pay", "pay"] and [x.ts_offset_ms for x in e.loud] == [4, 24]
    assert [tuple(c) for c in e.downstream] == [("pay", "db", "/q")] * 2  # one for each step
    assert [s.name for s in n.path] == ["a", "b"]  # by start, also without an anchor
    assert [s.name for s in o.path] == ["prepare", "pay", "pay", "cleanup"] and [x.msg for x in o.loud] == ["a", "b", "c"] and not o.anchored
    assert q.path == [] and q.loud == [] and q.downstream == [] and r.path == [] and r.loud == []


def test_story_of_a_trace(spark):
    base = frame(spark, [event(1, 0), event(2, 10, parent="s1", status="error", code="X", step="pay")])
    step = F.struct(
        F.lit("pay").alias("name"), F.concat(F.lit("s"), F.substring("event_id", 2, 1)).alias("span_id"), F.lit(0).alias("start_ms"),
        F.lit(5).alias("duration_ms"), F.lit("error").alias("status"), F.lit(None).cast("struct<service:string,endpoint:string>").alias("downstream")
    )
    steps = F.array(step)
    rows = base.withColumn("steps", steps).withColumn(
        "logs", F.lit(None).cast("array<struct<ts_offset_ms:bigint,level:string,msg:string>>")
    ).withColumn("anchor", F.struct("step", "error_code"))
    got = trace.trace_stories(rows).collect()
    assert [(r.event_id, r.linkage) for r in got] == [("e2", "causal")]

def test_service_stats(spark):
    rows = [event(k, k, ms=10 * k) for k in range(1, 11)]
    got = reads.service_stats(frame(spark, rows), 95).collect()[0]
    assert (got["count"], got.latency_ms) == (10, 100)
    assert reads.service_stats(frame(spark, rows), 50).collect()[0].latency_ms == 50
    assert reads.service_stats(frame(spark, rows), 0).collect()[0].latency_ms == 0


@pytest.mark.parametrize("n", [1, 2, 99, 100, 101, 200])
@pytest.mark.parametrize("percent", [7, 50, 95, 99])
def test_nearest_rank_rule(n, percent):
    assert 1 <= (percent * n + 99) // 100 <= n


def test_error_rows_and_pages(spark):
    rows = [
        event(1, 1, status="error", step="charge", code="PMT_502", user="u1", trace_id="trace-a"),
        event(2, 0, status="error", step="charge", code="PMT_502", user="u2", trace_id="trace-b"),
        event(3, 2, status="error", step="reserve", code="INV_409", trace_id="trace-c"), event(4, 2)
    ]
    rolled = reads.error_rollup(frame(spark, rows).where(filters.rollup_filter()))
    first = reads.page(rolled, reads.ERROR_ORDER, 1).collect()[0]
    assert (first.events, first.users, first.samples, first._more) == (2, 2, "trace-a,trace-b", True)
    second = reads.page(rolled, reads.ERROR_ORDER, 1, first.asDict()).collect()[0]
    assert (second.step, second.users, second._more) == ("reserve", None, False)


def test_blast(spark):
    rows = [
        event(1, 0, status="error", step="charge", code="PMT_502", user="u1", trace_id="a"), event(2, 1, service="cart", trace_id="a", user="u1"),
        event(3, 2, service="payment", status="error", step="charge", code="PMT_502", user="u2", trace_id="b")
    ]
    df = frame(spark, rows)
    one = reads.blast_radius(df, df.where(filters.blast_filter("PMT_502", "checkout", "charge"))).collect()[0]
    assert (one.requests, one.users, one.services, one.top_services) == (1, 1, 2, "cart:1,checkout:1")
    every = reads.blast_radius(df, df.where(filters.blast_filter("PMT_502"))).collect()[0]
    assert (every.requests, every.services) == (2, 3)
    none = reads.blast_radius(df, df.where(filters.blast_filter("NO"))).collect()[0]
    assert (none.requests, none.users) == (0, None)


def spikes(spark, counts, **options):
    now, length = T0, timedelta(minutes=10)
    rows = [event(100 * w + k, -600 * w - 300, status="error", step="s", code="C", trace_id=f"{w}-{k}") for w, n in enumerate(counts) for k in range(n)]
    return detect.error_spikes(frame(spark, rows), detect.windows([now], length), **options).collect()


def test_spikes(spark):
    assert [r.baseline for r in spikes(spark, [12, 12, 0, 0])] == [0]
    assert spikes(spark, [12, 10, 9, 11]) == []
    assert spikes(spark, [6, 0, 0, 0], min_rate=1.0) == []
    assert len(spikes(spark, [6, 0, 0, 0])) == 1
    assert spikes(spark, [4, 0, 0, 0]) == []


def test_traffic_and_latency(spark):
    def rows(counts, ms):
        return [event(1000 * w + k, -600 * w - 300, ms=ms[w]) for w, n in enumerate(counts) for k in range(n)]

    table = detect.windows([T0], timedelta(minutes=10))
    direction = lambda counts: [r.direction for r in detect.traffic(frame(spark, rows(counts, [1] * 4)), table).collect()]
    assert direction([10, 100, 100, 100]) == ["drop"]
    assert direction([400, 100, 100, 100]) == ["surge"]
    assert direction([90, 100, 100, 100]) == [None]
    assert direction([0, 5, 5, 5]) == []
    slow = lambda counts, ms, **o: [r.anomalous for r in detect.latency(frame(spark, rows(counts, ms)), table, **o).collect()]
    assert slow([200] * 4, [300, 100, 100, 100]) == [True]
    assert slow([10] * 4, [300, 100, 100, 100]) == []
    assert slow([200] * 4, [9, 3, 3, 3], min_ms=250) == [False]


def test_sustained(spark):
    rows = [("a", 1, "drop"), ("a", 2, "drop"), ("a", 3, "surge"), ("a", 5, "surge"), ("a", 6, "surge"), ("a", 7, None)]
    got = detect.sustained(spark.createDataFrame(rows, "service string, tick_no int, direction string"), ["service"], "direction", 2)
    assert sorted((r.tick_no, r.run_length) for r in got.collect()) == [(2, 2), (6, 2)]


def test_boundary_is_in_two_windows(spark):
    df = frame(spark, [event(1, -600)])
    assert sorted(r.w for r in detect.in_windows(df, detect.windows([T0], timedelta(minutes=10))).collect()) == [0, 1]


def test_stable_id(spark):
    at = datetime(2024, 1, 1, 12, 3)
    rows = [("prod", "s", "s:a:C", at + timedelta(seconds=s)) for s in (0, 90, 180)]
    ids = [
        r[0] for r in spark.createDataFrame(
            rows, "env string, service string, family string, started_at timestamp_ntz"
        ).select(incidents.incident_id()).collect()
    ]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 20


def test_severity(spark):
    got = spark.createDataFrame(
        [(12, 2, 4.0), (100, 5, 20.0), (0, 0, 0.0)], "c bigint, s bigint, l double"
    ).select(incidents.severity(F.col("c"), F.col("s"), F.col("l"))).collect()
    assert [r[0] for r in got] == [7, 10, 1]


@pytest.mark.parametrize("dependency,deploy,winner", [(-600, -60, "deploy"), (-60, -600, "dependency"), (-60, -60, "dependency"), (-60, 30, "dependency"), (None, -5, "deploy")])
def test_tiebreak(spark, dependency, deploy, winner):
    at = lambda s: None if s is None else T0 + timedelta(seconds=s)
    df = spark.createDataFrame([(at(dependency), at(deploy), T0)], "a timestamp_ntz, b timestamp_ntz, o timestamp_ntz")
    assert df.select(incidents.onset_tiebreak("a", "b", "o")).collect()[0][0] == winner


def test_causes(spark):
    rows = [
        (T0, None, False, False, 1, "s"), (None, None, True, False, 1, "s"), (None, T0, False, False, 1, "s"), (None, None, False, False, 1, "s"),
        (None, None, False, False, 0, ""), (None, None, False, True, 1, "s")
    ]
    df = spark.createDataFrame([(*r, T0) for r in rows], "a timestamp_ntz, b timestamp_ntz, d boolean, r boolean, e int, s string, o timestamp_ntz")
    got = [r[0] for r in df.select(incidents.cause("a", "b", "d", "r", "e", "s", "o")).collect()]
    assert got == ["dependency/high", "dependency/medium", "deploy/high", "app/medium", "unknown/low", "runtime/high"]


def test_evidence_cap_keeps_runtime(spark):
    rows = [("i", "runtime" if k % 2 else "event", f"t{k}", T0 + timedelta(seconds=k), "", "", "", k) for k in range(30)]
    got = incidents.cap_evidence(
        spark.createDataFrame(
            rows,
            "incident_id string, kind string, title string, occurred_at timestamp_ntz, signal_id string, deploy_id string, trace_id string, seq bigint"
        ),
        12
    ).collect()
    assert [r.kind for r in got].count("runtime") == 15 and len(got) == 15


def test_lifecycle(spark):
    old = spark.createDataFrame(
        [
            ("a", "active", T0, T0, "d"), ("b", "active", T0, T0, None), ("c", "active", T0, T0 - timedelta(minutes=3), None),
            ("d", "recovering", T0, T0 - timedelta(minutes=1), None), ("e", "recovering", T0, T0, None)
        ],
        "incident_id string, status string, started_at timestamp_ntz, last_seen timestamp_ntz, suspect_deploy_id string"
    )
    now = T0 + timedelta(minutes=1)
    seen = spark.createDataFrame(
        [("a", now, now, "x"), ("n", now, now, None)],
        "incident_id string, started_at timestamp_ntz, last_seen timestamp_ntz, suspect_deploy_id string"
    )
    state = incidents.lifecycle(old, seen, F.lit(now))
    got = {r.incident_id: r for r in state.collect()}
    assert {k: (r.status, r.transition) for k, r in got.items()} == {
        "a": ("active", None), "b": ("recovering", None), "c": ("recovering", None), "d": ("resolved", "resolved"), "e": ("recovering", None),
        "n": ("active", "opened")
    }
    assert got["a"].started_at == T0 and got["a"].suspect_deploy_id == "x"
    state = incidents.lifecycle(state, seen.where("incident_id = 'c'"), F.lit(T0 + timedelta(minutes=3)))
    assert {r.incident_id: (r.status, r.transition) for r in state.collect()} == {
        "a": ("recovering", None), "b": ("resolved", "resolved"), "c": ("resolved", "resolved"), "d": ("resolved", None),
        "e": ("resolved", "resolved"), "n": ("recovering", None)
    }
    back = spark.createDataFrame([("d", now, now, None)], seen.schema)
    assert incidents.lifecycle(state, back, F.lit(now)).where("incident_id = 'd'").first().transition == "opened"

def test_deploys(spark):
    rows = [event(1, 0, version="v1"), event(2, 10, version="v1"), event(3, 20, version="v2"), event(4, 30, version="v1")]
    assert sorted(r.version for r in correlate.deploy_events(frame(spark, rows)).collect()) == ["v1", "v2"]
    at = lambda *seconds, bad=0: [event(k, s, status="error" if k < bad else "ok") for k, s in enumerate(seconds)]
    deploy = spark.createDataFrame([("d", "checkout", T0)], "id string, service string, first_seen timestamp_ntz")
    few = correlate.deploy_rate_delta(deploy, frame(spark, at(-3, -2, -1, 1, 2, 3))).collect()[0]
    assert few.ratio is None and (few.n_before, few.n_after) == (3, 3)
    before = [event(k, -1 - k, status="error" if k < 3 else "ok") for k in range(16)]
    after = [event(100 + k, 1 + k, status="error") for k in range(13)]
    assert correlate.deploy_rate_delta(deploy, frame(spark, before + after)).collect()[0].ratio > 1


def test_alerts(spark):
    i = spark.createDataFrame(
        [("i1", "prod", "s", "a", "C", T0, T0 + timedelta(minutes=1))],
        "incident_id string, env string, service string, step string, error_code string, started_at timestamp_ntz, now timestamp_ntz"
    )
    rows = [
        ("x", "info", "s", "prod", T0, "i1", "OTHER", ""), ("y", "info", "s", "prod", T0, "", "C", ""),
        ("z", "info", "s", "prod", T0 + timedelta(hours=2), "", "C", ""), ("w", "info", "s", "prod", T0, "other", "C", "")
    ]
    a = spark.createDataFrame(
        rows,
        "signal_id string, severity string, service string, env string, timestamp timestamp_ntz, alert_incident_id string, alert_code string, alert_step string"
    )
    assert sorted((r.signal_id, r.strategy) for r in correlate.alert_match(i, a).collect()) == [("x", "incident_id"), ("y", "family")]


def test_sampler_and_dedup(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",), ("é",)], "s string")

    def fnv(s):
        h = 0x811C9DC5
        for b in s.encode():
            h = (h ^ b) * 0x01000193 % (1 << 32)
        return h

    assert [r[0] for r in df.select(filters.fnv1a32(F.col("s"))).collect()] == [fnv(s) for s in ("", "a", "foobar", "é")]
    rows = [event(1, 0, status="error"), event(2, 1, ms=400), event(3, 2, trace_id="x")]
    kept = {r.event_id for r in filters.head_sample(frame(spark, rows), percent=0).collect()}
    assert kept == {"e1", "e2"}
    twice = frame(spark, [event(1, 5), event(1, 9)]).withColumn("seq", F.unix_seconds(F.col("ts_start").cast("timestamp")))
    assert filters.dedup_first(twice).collect()[0].ts_start == T0 + timedelta(seconds=5)


def test_samples_stay(spark):
    old = spark.createDataFrame([("a", ["t9"]), ("b", []), ("c", None), ("d", list("123456"))], "incident_id string, samples array<string>")
    rows = [(i, f"e{k}", t, T0 + timedelta(seconds=k)) for i in "abd" for k, t in enumerate(("t1", "t2", "t2", "t9", "", "t3", "t4", "t5"))]
    got = {
        r.incident_id: r.samples for r in state.stable_samples(
            old, spark.createDataFrame(rows, "incident_id string, event_id string, trace_id string, ts_start timestamp_ntz")
        ).collect()
    }
    assert got == {"a": ["t9", "t5", "t4", "t3", "t2"], "b": ["t1", "t5", "t4", "t3", "t9"], "c": [], "d": list("12345")}


def test_family_samples_limit_before_the_step(spark):
    events = frame(spark, [event(k, k, status="error", step="a" if k < 3 else "b", code="X") for k in range(6)])
    asked = spark.createDataFrame(
        [("i", "checkout", "a", "X", T0, T0 + timedelta(minutes=5))],
        "incident_id string, service string, step string, error_code string, since timestamp_ntz, until timestamp_ntz"
    )
    assert {r.event_id for r in state.family_samples(asked, events, most=4).collect()} == {"e2"}
    assert {r.event_id for r in state.family_samples(asked, events).collect()} == {"e0", "e1", "e2"}


def test_snapshots(spark):
    kind = "struct<n:int,capture_status:string>"
    prior = spark.createDataFrame(
        [("a", (1, "ok"), (1, "ok")), ("b", None, (1, "missing")), ("c", (1, "ok"), (1, "ok"))], f"incident_id string, opening {kind}, latest {kind}"
    )
    fresh = spark.createDataFrame([("a", (2, "missing")), ("b", (2, "ok")), ("n", (2, "partial"))], f"incident_id string, evidence {kind}")
    got = {r.incident_id: (r.opening and r.opening.n, r.latest.n) for r in state.update_snapshots(prior, fresh).collect()}
    assert got == {"a": (1, 2), "b": (2, 2), "c": (1, 1), "n": (None, 2)}


def test_rebuild_keeps_resolved(spark):
    kind = "incident_id string, env string, service string, step string, error_code string, status string, severity int, started_at timestamp_ntz, suspect_deploy_id string"
    row = lambda i, status, severity, at, deploy=None: (i, "prod", "s", "a", "X", status, severity, T0 + timedelta(minutes=at), deploy)
    store = spark.createDataFrame([row("open", "active", 1, 0), row("old", "resolved", 2, 0, "d"), row("kept", "resolved", 3, 0)], kind)
    got = {
        r.incident_id: r for r in state.replace_unresolved(
            store, spark.createDataFrame([row("old", "active", 9, 5, ""), row("new", "active", 4, 5)], kind)
        ).collect()
    }
    assert set(got) == {"old", "kept", "new"} and (
        got["old"].status, got["old"].severity, got["old"].started_at, got["old"].suspect_deploy_id
    ) == ("active", 9, T0, "d")


def test_anomaly_incidents(spark):
    traffic = spark.createDataFrame(
        [("s", 10, 100, "drop"), ("u", 400, 100, "surge"), ("v", 5, 5, None)], "service string, n0 bigint, baseline bigint, direction string"
    )
    latency = spark.createDataFrame([("s", 300, 100, True), ("u", 9, 3, False)], "service string, latency_ms bigint, baseline_ms bigint, anomalous boolean")
    open_ = spark.createDataFrame(
        [("mine", "prod", "s", "<latency>", "LATENCY_SPIKE", T0)],
        "incident_id string, env string, service string, step string, error_code string, started_at timestamp_ntz"
    )
    now = F.lit(T0 + timedelta(minutes=30)).cast("timestamp_ntz")
    got = {(r.service, r.error_code): r for r in state.anomaly_incidents(traffic, latency, open_, "prod", now).collect()}
    assert {k: (r.lift, r.severity) for k, r in got.items()} == {
        ("s", "TRAFFIC_DROP"): (10.0, 10), ("u", "TRAFFIC_SURGE"): (4.0, 10), ("s", "LATENCY_SPIKE"): (3.0, 10)
    }
    assert got["s", "LATENCY_SPIKE"].incident_id == "mine" and got["s", "LATENCY_SPIKE"].started_at == T0 and got["s", "TRAFFIC_DROP"].incident_id.startswith("inc_")


def test_anchor_on_any_graph():
    """Random parents, cycles included: the anchor is a failed event that no failed event is below, the deepest one, whatever the order of events."""
    rng, cyclic = random.Random(12), 0
    for _ in range(400):
        n = rng.randrange(2, 8)
        rows = [
            {
                "event_id": f"e{k}", "ts_start": T0 + timedelta(seconds=rng.randrange(5)), "service": "s", "status": rng.choice(("ok", "error")), "spans": [f"s{k}"], "seq": k,
                "parent_span_id": rng.choice(("", f"s{rng.choice([j for j in range(n) if j != k])}", f"s{rng.choice([j for j in range(n) if j != k])}")),
            } for k in range(n)
        ]
        up = {r["event_id"]: "e" + r["parent_span_id"][1:] for r in rows if r["parent_span_id"]}
        bad = {r["event_id"] for r in rows if r["status"] == "error"}

        def below(top):
            """All that is reached from an event through the calls it made, itself too if it is reached."""
            seen, stack = set(), [top]
            while stack:
                at = stack.pop()
                fresh = [c for c, p in up.items() if p == at and c not in seen]
                seen |= set(fresh)
                stack += fresh
            return seen

        cyclic += any(e in below(e) for e in up)
        leaves = {e for e in bad if not below(e) & bad}
        found = {(trace.anchor(rng.sample(rows, n))[0] or {}).get("event_id") for _ in range(4)}
        assert len(found) == 1
        if bad and up and leaves and any(e in up or e in up.values() for e in bad):
            depth = trace.Graph(rows).depths()
            by = {r["event_id"]: r for r in rows}
            assert found == {min(leaves, key=lambda e: (-depth.get(e, 0), by[e]["ts_start"], e))}
    assert cyclic > 50
    call = lambda k, parent, status: {"event_id": k, "ts_start": T0, "service": "s", "status": status, "spans": [k], "seq": 0, "parent_span_id": parent}
    assert trace.anchor([call("a", "b", "error"), call("b", "a", "ok"), call("d", "b", "error")])[0]["event_id"] == "d"


def test_deep_traces_are_linear():
    rows = [
        {
            "event_id": f"e{k}", "ts_start": T0, "service": "s", "parent_span_id": f"s{k - 1}" if k else "", "status": "error" if k % 2 else "ok",
            "spans": [f"s{k}"], "seq": k
        } for k in range(4000)
    ]
    assert trace.anchor(rows)[0]["event_id"] == "e3999" and len(trace.ordered(rows)[0]) == 4000
    assert trace.ordered([{**rows[0], "service": None}, rows[1]])[1] == "causal"


def test_report_from_frames(spark):
    rows = [
        event(1, 0, status="error", step="pay", code="X", user="u1"), event(2, 5, status="error", step="pay", code="X", user="u2", trace_id="t2"),
        event(3, 6, status="error", step="other", code="Y", trace_id="t3")
    ]
    events, until = frame(spark, rows), T0 + timedelta(minutes=10)
    asked = spark.createDataFrame(
        [("i1", "prod", "checkout", "pay", "X", T0, until, "deploy", "high", "d1")],
        "incident_id string, env string, service string, step string, error_code string, since timestamp_ntz, until timestamp_ntz, cause string, confidence string, suspect_deploy_id string"
    )
    samples = state.stable_samples(asked.select("incident_id", F.lit(None).cast("array<string>").alias("samples")), state.family_samples(asked, events))
    story = spark.createDataFrame(
        [("t", "e1", "checkout", "error", ("pay", "X"), [("pay", "s1", 0, 5, "error", None)], None)],
        "trace_id string, " + STORY.replace("event_id string, status", "event_id string, service string, status")
    )
    signals = spark.createDataFrame(
        [("sig1", "alert", "warning", "checkout", "prod", T0 + timedelta(minutes=1))],
        "signal_id string, type string, severity string, service string, env string, timestamp timestamp_ntz"
    )
    deploys = spark.createDataFrame([("d1", "checkout", "v2", T0)], "id string, service string, version string, first_seen timestamp_ntz")
    change = correlate.suspect_change(asked, deploys, correlate.deploy_rate_delta(deploys, events))
    alerts = correlate.alert_evidence(asked.withColumnsRenamed({"since": "started_at", "until": "now"}), signals)
    blast = reads.blast_radius(events, events.where(filters.blast_filter("X"))).first()
    row = asked.withColumns({c: F.lit(blast[c]) for c in ("requests", "users", "services")})
    details = signals.withColumns({"source": F.lit("pager"), "reason": F.lit('disk <90 %> "full"'), "metadata": F.lit('{"alert_id": "a9", "provider_url": "http://p/?a&b"}')})
    refs = alerts.select("incident_id", F.lit("alerts").alias("part"), "signal_id", "place").unionByName(
        state.report_signals(asked, signals).select("incident_id", F.lit("signals").alias("part"), "signal_id", "place")
    ).unionByName(spark.createDataFrame([("i1", "runtime", "sig1", 1)], "incident_id string, part string, signal_id string, place int"))
    changes = change.where("deploy_service is not null").select(
        "incident_id", F.col("suspect_deploy_id").alias("deploy_id"), F.col("deploy_service").alias("service"), F.col("deploy_version").alias("version"), F.col("deploy_first_seen").alias("deployed_at"),
        (F.col("bad_before") / F.nullif("n_before", F.lit(0))).alias("error_rate_before"), (F.col("bad_after") / F.nullif("n_after", F.lit(0))).alias("error_rate_after")
    )
    told = trace.stories(story).withColumn("incident_id", F.lit("i1"))
    make = lambda at, rows=row: json.loads(reports.reports(rows, at, state.top_families(asked, events), samples, told, refs, details, changes).first().report)
    made = make("2024-01-01T00:00:00Z")
    assert (made["blast_snapshot"]["requests"], made["blast_snapshot"]["users"]) == (2, 2)
    assert [(f["step"], f["count"]) for f in made["blast_snapshot"]["top_error_families"]] == [("pay", 2), ("other", 1)]
    assert [s["trace_id"] for s in made["sample_traces"]] == ["t", "t2"] and made["sample_traces"][0]["summary"] == "checkout/pay → pay"
    assert made["first_failure"]["first_failing_step"] == "pay" and made["suspect_change"]["deploy_id"] == "d1" and made["signals"][0]["id"] == "sig1" and made["alerts"][0]["signal_id"] == "sig1"
    assert made["alerts"][0] | {"evidence_ids": 0} == {"signal_id": "sig1", "alert_id": "a9", "source": "pager", "severity": "warning", "reason": 'disk <90 %> "full"', "provider_url": "http://p/?a&b", "evidence_ids": 0}
    assert made["runtime"][0]["occurred_at"].endswith(":01:00Z") and made["runtime"][0]["service"] == "checkout"
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", made["suspect_change"]["deployed_at"])
    assert made["report_hash"] == report.report_hash(made) and made["evidence_fingerprint"] == report.fingerprint(made)
    assert make("2025-01-01T00:00:00Z")["report_hash"] == made["report_hash"] and not report.problems(made)

    # what was captured comes first
    snapped = row.withColumns({
        "blast": F.expr("named_struct('requests', 7L, 'users', 5L, 'services', 3L, 'sampled_traces', array('z', 't'))"),
        "propagation": F.expr("named_struct('origin_service', 'db', 'origin_step', 'q', 'sample_trace_id', 'z', 'path', array(named_struct('step', 'a', 'status', 'ok', 'error_code', ''), named_struct('step', 'b', 'status', 'error', 'error_code', 'E9')))"),
    })
    made = make("2024-01-01T00:00:00Z", snapped)
    assert [made["blast_snapshot"][c] for c in ("requests", "users", "services")] == [7, 5, 3]
    assert made["first_failure"] == {"origin_service": "db", "origin_step": "q", "first_failing_step": "b", "error_code": "E9", "sample_trace_id": "z"}
    assert made["sample_traces"] == [{"trace_id": "z", "summary": "db/q → b"}, {"trace_id": "t", "summary": ""}]
    assert made["report_hash"] == report.report_hash(made) and made["evidence_fingerprint"] == report.fingerprint(made)


def test_reports_of_odd_incidents(spark):
    """Texts with all that JSON escapes, nulls, and incidents without any part: the same hashes as of one report at a time."""
    odd = "".join(map(chr, range(1, 40))) + '\\u000B "<>&é😀\u2028\u2029'
    rows = [("a", odd, "deploy", "high", 1, None, 3, [odd, "partial_trace"]), (odd, "s", "none", "sure", None, 2, None, None), ("", "s", "app", "low", 1, 1, 1, []), (None, "s", "app", "low", 1, 1, 1, [])]
    i = spark.createDataFrame(rows, "incident_id string, service string, cause string, confidence string, requests int, users int, services int, warnings array<string>")
    families = spark.createDataFrame([("a", odd, None, odd, 5, 1)], "incident_id string, service string, step string, error_code string, count int, place int")
    samples = spark.createDataFrame([("a", [odd, "t2"]), (odd, [])], "incident_id string, samples array<string>")
    got = {r.incident_id: r for r in reports.reports(i, "now", families, samples).collect()}
    assert set(got) == {"a", odd}
    for r in got.values():
        made = json.loads(r.report)
        assert made["report_hash"] == r.report_hash == report.report_hash(made) and made["evidence_fingerprint"] == r.evidence_fingerprint == report.fingerprint(made)
        assert report.canonical(made) == r.report and not report.problems(made)
    assert reports.reports(i.limit(0), "now").collect() == []


def test_a_snapshot_in_words(spark):
    asked = spark.createDataFrame(
        [("i1", "prod", "checkout", "pay", "X", "deploy", "high")], "incident_id string, env string, service string, step string, error_code string, cause string, confidence string"
    )
    assert state.snapshot_text(
        asked.withColumns({"status": F.lit("active"), "severity": F.lit(3), "requests": F.lit(2), "users": F.lit(None)})
    ).first().text.splitlines()[0] == "i1 active severity 3"


def test_near_in_time_as_brute_force(spark):
    rng = random.Random(1)
    at = lambda: T0 + timedelta(seconds=rng.randrange(-7200, 7200))
    points = [(k, rng.choice("ab"), at()) for k in range(80)] + [(90, "a", None), (91, None, T0)]
    spans = [(k, rng.choice("ab"), *sorted((at(), at()))) for k in range(40)] + [(50, "a", T0 + timedelta(hours=1), T0), (51, "b", None, T0), (52, "a", points[0][2], points[0][2])]
    p = spark.createDataFrame(points, "p int, key string, t timestamp_ntz")
    q = spark.createDataFrame(spans, "s int, key string, since timestamp_ntz, until timestamp_ntz")
    got = sorted((r.p, r.s) for r in correlate.near_in_time(p, q, ["key"], F.col("t"), F.col("since"), F.col("until"), 15).collect())
    assert got == sorted((a, b) for a, k, t in points if t and k for b, j, x, y in spans if j == k and x and x <= t <= y)


def test_windows_as_brute_force(spark):
    rng = random.Random(2)
    length, ticks = timedelta(minutes=10), [T0, T0 - timedelta(minutes=10), T0 - timedelta(minutes=25)]
    rows = [event(k, rng.choice((rng.randrange(-5000, 600), 600 * rng.randrange(-8, 1)))) for k in range(120)]
    got = sorted((r.event_id, r.tick, r.w) for r in detect.in_windows(frame(spark, rows), detect.windows(ticks, length)).collect())
    assert got == sorted((r[0], t, w) for r in rows for t in ticks for w in range(4) if t - (w + 1) * length <= r[1] <= t - w * length)
    assert detect.in_windows(frame(spark, rows), detect.windows([], length)).count() == 0


@pytest.mark.parametrize("slot", [None, "day"])
def test_deploy_slots(spark, slot):
    """Versions compared within slots and over their borders are as those of the whole history."""
    rng = random.Random(3)
    rows = [event(k, 3600 * k, service=rng.choice("st"), version=rng.choice(("v1", "v1", "v2", ""))) for k in range(120)]
    last, want = {}, []
    for r in rows:
        if r[6]:
            if last.get(r[4], r[6]) != r[6]:
                want.append(r[13])
            last[r[4]] = r[6]
    got = correlate.deploy_events(frame(spark, rows), None if slot is None else F.date_trunc(slot, F.col("ts_start"))).collect()
    assert sorted(r.seq for r in got) == want
