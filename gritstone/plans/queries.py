"""A query for each operator over the benchmark's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import admission, assembly, correlate, detect, filters, fold, incidents, reads, state, trace
from ..schema import FAILED
from ..sources import alerts, intake, legacy, otlp
from . import reports
from .views import long_events, seeds, signals, wide_events

NOW = datetime(2024, 1, 29)
WEEK = timedelta(days=7)
SINCE, UNTIL = datetime(2024, 1, 10), datetime(2024, 1, 20)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(make):
    QUERIES[make.__name__] = make
    return make


def _event(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "ts_start", "service", "status", "trace_id")


def _first_page(spark, sf_dir, limit=50):
    return _event(wide_events(spark, sf_dir).where(filters.event_filter(service="svc_1", since=SINCE, until=UNTIL))), reads.SEARCH_ORDER, limit


@query
def event_search(spark, sf_dir):
    rows, order, limit = _first_page(spark, sf_dir)
    return reads.page(rows, order, limit).withColumnRenamed("_more", "more")


def _second_page(rows, order, limit):
    """The page behind the last row of the first one; empty where that one is."""
    keys = [F.desc(c) if down else F.asc(c) for c, down in order]
    first = rows.orderBy(*keys).limit(limit).collect()  # a page
    page = reads.page(rows, order, limit, first[-1].asDict()) if first else reads.page(rows, order, limit)
    return page.withColumnRenamed("_more", "more")


@query
def event_search_page2(spark, sf_dir):
    rows, order, limit = _first_page(spark, sf_dir)
    return _second_page(rows, order, limit)


@query
def status_filter(spark, sf_dir):
    return _event(wide_events(spark, sf_dir).where(filters.event_filter(statuses=("timeout", "suppressed"))))


@query
def cold_event_search(spark, sf_dir):
    return filters.cold_search(wide_events(spark, sf_dir), service="svc_2", error_code="E1").select("event_id", "trace_id", "service", "error_code", "total")


def _rollup(spark, sf_dir):
    return reads.error_rollup(wide_events(spark, sf_dir).where(filters.rollup_filter()))


@query
def error_rollup(spark, sf_dir):
    return _rollup(spark, sf_dir)


@query
def error_rollup_page2(spark, sf_dir):
    rows = _rollup(spark, sf_dir)
    return _second_page(rows, reads.ERROR_ORDER, 20)


@query
def blast_single(spark, sf_dir):
    w = wide_events(spark, sf_dir)
    return reads.blast_radius(w, w.where(filters.blast_filter("E1", "svc_1", "step_1", SINCE, UNTIL)))


@query
def blast_cross(spark, sf_dir):
    w = wide_events(spark, sf_dir)
    return reads.blast_radius(w, w.where(filters.blast_filter("E1")))


@query
def top_services(spark, sf_dir):
    w = wide_events(spark, sf_dir)
    return reads.top_services(w, w.where(filters.blast_filter("E2")))


@query
def sample_traces(spark, sf_dir):
    return reads.sample_traces(wide_events(spark, sf_dir).where(filters.rollup_filter()), reads.FAMILY)


@query
def service_stats_p95(spark, sf_dir):
    return reads.service_stats(wide_events(spark, sf_dir), 95).orderBy(F.desc("count"), "service")


@query
def line_quantity_p95(spark, sf_dir):
    return reads.nearest_rank(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ("l_returnflag",), "l_quantity", 95)


@query
def service_index(spark, sf_dir):
    return reads.service_index(wide_events(spark, sf_dir))


@query
def error_index(spark, sf_dir):
    return reads.error_index(wide_events(spark, sf_dir))


@query
def call_edges(spark, sf_dir):
    return reads.call_edges(wide_events(spark, sf_dir))


@query
def index_sizes(spark, sf_dir):
    return reads.index_sizes(wide_events(spark, sf_dir))


@query
def minute_counters(spark, sf_dir):
    return reads.minute_counters(wide_events(spark, sf_dir))


@query
def service_error_rate(spark, sf_dir):
    return reads.error_rate(wide_events(spark, sf_dir), SINCE, UNTIL, "svc_3")


@query
def recent_traces(spark, sf_dir):
    w = wide_events(spark, sf_dir)
    return reads.recent_traces(w, w.where(filters.event_filter(error_code="E3")))


@query
def recent_traces_page2(spark, sf_dir):
    w = wide_events(spark, sf_dir)
    rows = reads.recent_traces(w, w.where(filters.event_filter(service="svc_2", since=SINCE))).select("trace_id", "started", "status", "anchor")
    return _second_page(rows, reads.TRACE_ORDER, 30)


@query
def trace_order(spark, sf_dir):
    return trace.order_traces(wide_events(spark, sf_dir))


@query
def trace_anchor(spark, sf_dir):
    return trace.anchors(wide_events(spark, sf_dir)).select("trace_id", "event_id")


@query
def trace_linkage(spark, sf_dir):
    return trace.order_traces(wide_events(spark, sf_dir)).groupBy("linkage").agg(F.count_distinct("trace_id").alias("traces"))


_CALLS = lambda calls: F.array_join(F.transform(calls, lambda c: F.concat_ws("|", c["step"], c["service"], c["endpoint"])), ",")


def _story(rows):
    path = F.array_join(F.transform("path", lambda s: F.concat_ws("@", s["name"], s["start_ms"].cast("string"))), ",")
    loud = F.array_join(F.transform("loud", lambda x: F.concat_ws("@", x["msg"], x["ts_offset_ms"].cast("string"))), ",")
    return rows.select(
        "trace_id", F.col("event_id").cast("string").alias("event_id"), "service", "status", path.alias("path"), loud.alias("logs"),
        _CALLS("downstream").alias("downstream"), *[c for c in ("linkage",) if c in rows.columns]
    )


@query
def trace_story_path(spark, sf_dir):
    """Stories of events with several steps and logs."""
    return _story(trace.stories(long_events(spark, sf_dir)))


@query
def story_by_trace(spark, sf_dir):
    """The story of each trace's anchor event. Events are linked by the spans of the plain view's steps."""
    w = wide_events(spark, sf_dir)
    found = trace.anchors(w).where("event_id is not null")
    rows = long_events(spark, sf_dir).withColumn("event_id", F.col("event_id").cast("string")).join(found, ["trace_id", "event_id"])
    return _story(trace.stories(rows)).drop("linkage")


def _windows(ticks=(NOW,)):
    return detect.windows(ticks, WEEK)


@query
def spike_detect(spark, sf_dir):
    found = detect.error_spikes(wide_events(spark, sf_dir), _windows(), min_count=5, min_lift=1.2)
    return found.select("service", "step", "error_code", "n0", "baseline", F.round("lift", 6).alias("lift"))


@query
def traffic_anomaly(spark, sf_dir):
    return detect.traffic(wide_events(spark, sf_dir), _windows(), min_volume=20, drop=0.98, surge=1.02).select("service", "n0", "baseline", "direction")


@query
def latency_anomaly(spark, sf_dir):
    return detect.latency(wide_events(spark, sf_dir), _windows(), min_requests=20, factor=1.01).select("service", "latency_ms", "baseline_ms", "anomalous")


@query
def sustained_gate(spark, sf_dir):
    ticks = [NOW - k * timedelta(hours=12) for k in range(8)]
    found = detect.traffic(wide_events(spark, sf_dir), detect.windows(ticks, timedelta(days=3)), min_volume=5, drop=0.95, surge=1.05)
    numbered = found.withColumn("tick_no", F.floor(F.unix_seconds(F.col("tick").cast("timestamp")) / 43200).cast("int"))
    return detect.sustained(numbered, ("service",), "direction", need=2).select(
        "service", "tick_no", "direction", F.col("run_length").cast("int").alias("run_length")
    )


@query
def stable_incident_id(spark, sf_dir):
    rows = seeds(spark, sf_dir).withColumn("family", incidents.family("service", "step", "error_code"))
    return rows.select(F.col("incident_id").alias("seed"), incidents.incident_id().alias("incident_id"))


@query
def severity_score(spark, sf_dir):
    return seeds(spark, sf_dir).select("incident_id", incidents.severity(F.col("events"), F.col("users"), F.col("events") / 2.0).alias("severity"))


@query
def incident_lifecycle(spark, sf_dir):
    """Three ticks, at the ends of three days, over the incidents of four days."""
    rows = seeds(spark, sf_dir).select(
        F.concat_ws("|", "service", "step", "error_code").alias("incident_id"), "day", "started_at", F.col("now").alias("last_seen"),
        F.concat_ws("-", F.lit("d"), "day").alias("suspect_deploy_id")
    )
    state = rows.where("day = '20240110'").drop("day").withColumn("status", F.lit("active"))
    for day in (11, 12, 13):
        state = incidents.lifecycle(state, rows.where(F.col("day") == f"202401{day}").drop("day"), F.lit(f"2024-01-{day} 23:59:59").cast("timestamp_ntz"))
    return state


def _deploys(spark, sf_dir):
    return correlate.deploy_events(wide_events(spark, sf_dir).withColumn("seq", F.struct("ts_start", "event_id")), F.date_trunc("day", F.col("ts_start")))


@query
def deploy_detect(spark, sf_dir):
    return _deploys(spark, sf_dir).select("id", "service", "version", "first_seen")


@query
def deploy_upsert(spark, sf_dir):
    """Some writes of a service name another environment, which is a conflict for its ids."""
    w = wide_events(spark, sf_dir)
    rows = w.select(
        F.concat_ws(":", "service", "version").alias("id"), "service", F.when(F.col("k") % 50 == 7, "stage").otherwise(F.col("env")).alias("env"),
        F.when(F.col("k") % 2 == 0, F.col("version")).otherwise("").alias("version"), F.col("ts_start").alias("first_seen"),
        F.col("ts_end").alias("last_seen"), "seq"
    )
    return correlate.upsert_deploys(rows)


@query
def deploy_rate_delta(spark, sf_dir):
    out = correlate.deploy_rate_delta(_deploys(spark, sf_dir).dropDuplicates(["id", "first_seen"]), wide_events(spark, sf_dir), minutes=600, least=1)
    return out.select("id", "n_before", "bad_before", "n_after", "bad_after", F.round("ratio", 6).alias("ratio"))


@query
def deploy_match(spark, sf_dir):
    return correlate.deploy_match(seeds(spark, sf_dir), _deploys(spark, sf_dir), minutes=60 * 72).select("incident_id", "deploy_id", "deploy_first_seen")


@query
def dependency_match(spark, sf_dir):
    return correlate.dependency_match(seeds(spark, sf_dir), signals(spark, sf_dir)).select("incident_id", "signal_id", "signal_at")


@query
def runtime_match(spark, sf_dir):
    return correlate.runtime_match(seeds(spark, sf_dir), signals(spark, sf_dir), 120).select(
        "incident_id", "signal_id", F.col("place").cast("int").alias("place")
    )


@query
def alert_match(spark, sf_dir):
    """Of the alerts a seventh names an incident, which then is the only one, and another seventh one that doesn't exist."""
    n = F.substring("signal_id", 5, 20).cast("bigint") % 7
    named = F.when(
        n == 0, F.concat_ws("|", "service", F.lit("step_0"), "alert_code", F.date_format("timestamp", "yyyyMMdd"))
    ).when(n == 1, "none").otherwise("")
    alerts = signals(spark, sf_dir).where("type = 'alert'").withColumn("alert_incident_id", named)
    return correlate.alert_match(seeds(spark, sf_dir), alerts, 360).select("incident_id", "signal_id", "strategy")


def _evidence_times(spark, sf_dir):
    s = seeds(spark, sf_dir)
    dependency = correlate.dependency_match(s, signals(spark, sf_dir)).select("incident_id", F.col("signal_at").alias("dependency_at"))
    deploy = correlate.deploy_match(s, _deploys(spark, sf_dir), 60 * 72).select("incident_id", F.col("deploy_first_seen").alias("deploy_at"))
    runtime = correlate.runtime_match(s, signals(spark, sf_dir), 120).select("incident_id").distinct().withColumn("has_runtime", F.lit(True))
    rows = s.join(dependency, "incident_id", "left").join(deploy, "incident_id", "left").join(runtime, "incident_id", "left")
    return rows.withColumn("has_runtime", F.coalesce("has_runtime", F.lit(False))).withColumn("has_downstream", F.col("events") > 3)


@query
def cause_classify(spark, sf_dir):
    rows = _evidence_times(spark, sf_dir)
    return rows.select(
        "incident_id", incidents.cause("dependency_at", "deploy_at", "has_downstream", "has_runtime", "events", "step", "started_at").alias("cause")
    )


@query
def onset_tiebreak(spark, sf_dir):
    return _evidence_times(spark, sf_dir).select("incident_id", incidents.onset_tiebreak("dependency_at", "deploy_at", "started_at").alias("winner"))


@query
def evidence_cap(spark, sf_dir):
    w = wide_events(spark, sf_dir)
    kind = F.when(F.col("k") % 9 == 0, "runtime").when(F.col("k") % 31 == 0, "deployment").otherwise("event")
    rows = w.select(
        F.col("service").alias("incident_id"), kind.alias("kind"), F.concat(F.lit("t"), F.col("k") % 13).alias("title"),
        F.date_trunc("hour", "ts_start").cast("timestamp_ntz").alias("occurred_at"), F.col("user_id").alias("signal_id"),
        F.lit("").alias("deploy_id"), "trace_id", "seq"
    )
    return incidents.cap_evidence(rows, 12).select("incident_id", "kind", "title", "signal_id", "trace_id", F.col("place").cast("int").alias("place"))


@query
def impact_queue(spark, sf_dir):
    rows = _evidence_times(spark, sf_dir).withColumn(
        "c", F.split(incidents.cause("dependency_at", "deploy_at", "has_downstream", "has_runtime", "events", "step", "started_at"), "/")
    )
    rows = rows.withColumn("cause", F.get("c", 0)).withColumn("confidence", F.get("c", 1)).withColumn("status", F.when(F.col("events") % 5 == 4, "resolved").otherwise("active")).withColumn("services", F.lit(1)).withColumn(
        "suspect_deploy_id", F.when(F.col("deploy_at").isNotNull(), F.col("service"))
    )
    return incidents.impact_queue(rows).select("incident_id", "users", "requests", "cause", "needs_judgment")


@query
def evidence_fingerprint(spark, sf_dir):
    w = wide_events(spark, sf_dir).select(F.col("trace_id").alias("incident_id"), F.col("status").alias("kind"), F.col("service").alias("id"))
    return incidents.evidence_fingerprint(w)


@query
def head_sample(spark, sf_dir):
    return filters.head_sample(wide_events(spark, sf_dir), percent=2).select("event_id", "trace_id", "status")


@query
def per_second_cap(spark, sf_dir):
    w = wide_events(spark, sf_dir).withColumn("ts_start", F.date_trunc("day", "ts_start"))
    return filters.cap_per_second(w, 3, filters.failed()).select("event_id", "status")


@query
def dedup_first(spark, sf_dir):
    w = wide_events(spark, sf_dir)
    return filters.dedup_first(w, key="trace_id", order="event_id").select("trace_id", "event_id")


@query
def dedup_events(spark, sf_dir):
    """Every third event came twice, and earlier with another status: the first one stays."""
    w = wide_events(spark, sf_dir).select("event_id", "status", "k", (F.col("event_id") * 2).alias("seq"))
    early = w.where("k % 3 = 0").withColumn("status", F.lit("early")).withColumn("seq", F.col("seq") - 1)
    return filters.dedup_first(w.unionByName(early)).select("event_id", "status")


@query
def family_format(spark, sf_dir):
    w = wide_events(spark, sf_dir).where(filters.failed())
    return w.select("event_id", incidents.family(F.concat(F.col("service"), F.lit(":a")), "step", "error_code").alias("family"))


@query
def signal_query(spark, sf_dir):
    return filters.signal_query(signals(spark, sf_dir), service="svc_1", types=("alert", "runtime")).select("signal_id", "type", "severity", "timestamp")


@query
def deploy_list(spark, sf_dir):
    return filters.deploy_window(_deploys(spark, sf_dir), SINCE, datetime(2024, 1, 25)).select("id", "service", "first_seen")


@query
def naive_rollup(spark, sf_dir):
    """The naive count beside the root-cause one: events times affected services, for each family."""
    w = wide_events(spark, sf_dir)
    rows = w.where(filters.rollup_filter(statuses=FAILED))
    per = rows.select(
        "trace_id", F.col("error_code").alias("code")
    ).distinct().join(w.select("trace_id", "service"), "trace_id").groupBy("code").agg(F.count_distinct("service").alias("services"))
    return rows.groupBy(F.col("error_code").alias("code")).agg(F.count(F.lit(1)).alias("events")).join(per, "code").withColumn(
        "naive", F.col("events") * F.col("services")
    )


@query
def validate_reasons(spark, sf_dir):
    """Each event as a JSON line, some broken, of an old version or without a service, and why it is refused."""
    w = wide_events(spark, sf_dir)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.to_json(F.struct(
        F.when(F.col("k") % 13 == 0, "1.1").otherwise("2.0").alias("schema_version"), F.col("event_id").cast("string").alias("event_id"), stamp("ts_start").alias("ts_start"), stamp("ts_end").alias("ts_end"), F.lit("http").alias("kind"),
        F.when(F.col("k") % 17 != 0, F.col("service")).alias("service"), "env", F.md5("trace_id").alias("trace_id"), "status", F.when(filters.failed(), F.struct("step", "error_code")).alias("anchor"),
    ))
    lines = w.select("event_id", F.when(F.col("k") % 11 == 0, F.substring(body, 2, 40)).otherwise(body).alias("value"))
    return intake.parse(lines).select("event_id", "reason")


@query
def span_event_ids(spark, sf_dir):
    w = wide_events(spark, sf_dir)
    return w.select("event_id", text.event_uuid(F.col("trace_id"), F.col("event_id").cast("string")).alias("uuid"))


@query
def alert_normalize(spark, sf_dir):
    """The error events as alerts of four providers."""
    w = wide_events(spark, sf_dir).where(filters.failed())
    common = F.struct(F.lit("graf").alias("grafana_folder"), "service", "env", "error_code", F.lit("high").alias("severity"))
    plain = F.struct("service", "env", "error_code", F.lit("info").alias("severity"), F.lit("Alert").alias("alertname"))
    body = (
        F.when(F.col("k") % 4 == 0, F.to_json(F.struct(F.lit("bench").alias("source"), "service", "env", F.lit("why").alias("reason"), "error_code")))
        .when(F.col("k") % 4 == 1, F.to_json(F.struct(F.lit("r").alias("receiver"), F.array(F.struct(plain.alias("labels"))).alias("alerts"))))
        .when(F.col("k") % 4 == 2, F.to_json(F.struct(F.lit("t").alias("title"), F.array(F.struct(common.alias("labels"))).alias("alerts"))))
        .otherwise(F.to_json(F.struct(F.struct("service", "error_code", F.lit("late").alias("title")).alias("incident"), F.lit("e").alias("event"))))
    )
    return alerts.normalize(w.select("event_id", body.alias("body")), NOW).select("event_id", "provider", "service", "severity", "reason", "error")


@query
def counter_window(spark, sf_dir):
    """Requests and failures of the last hour and a half, from the minute counters."""
    return reads.counter_sum(reads.minute_counters(wide_events(spark, sf_dir)), F.lit(UNTIL).cast("timestamp_ntz"), 90)


@query
def schema_rules(spark, sf_dir):
    """Events that each break one rule of the schema, or none."""
    w = wide_events(spark, sf_dir)
    good = '{"schema_version":"2.0","event_id":"e","ts_start":"2024-01-01T00:00:00Z","ts_end":"2024-01-01T00:00:01Z","kind":"http","service":"s","env":"p","trace_id":"0123456789abcdef0123456789abcdef","status":"ok"%s}'
    step = '{"name":"a","span_id":"0123456789abcdef","start_ms":0,"duration_ms":1,"status":"ok"}'
    more = (
        "", ',"span_id":"xyz"', f',"steps":[{step}]', ',"steps":[{"name":"","start_ms":0,"duration_ms":1,"status":"ok"}]', ',"steps":[{"name":"a","start_ms":0,"duration_ms":1,"status":"late"}]', ',"steps":[{"name":"a","duration_ms":1,"status":"ok"}]',
        ',"logs":[{"ts_offset_ms":1,"level":"loud","msg":"m"}]', ',"logs":[{"ts_offset_ms":1,"level":"warn","msg":"m"}]', ',"errors":[{"reason":"r"}]', ',"duration_ms":"5"', ',"duration_ms":5', ',"anchor":{"step":"","error_code":"E"}', ',"anchor":{"step":"a","error_code":"E"}',
        ',"steps":[{"name":"a","start_ms":0,"duration_ms":1,"status":"ok","downstream":{"service":"x"}}]', ',"version":7', ',"fields":[]', ',"parent_span_id":""',
    )
    bodies = F.array(*[F.lit(good % x) for x in more])
    return intake.parse(w.select("event_id", F.get(bodies, (F.col("k") % len(more)).cast("int")).alias("value"))).select("event_id", "reason")


@query
def otlp_events(spark, sf_dir):
    """Each event as an exported span, of several kinds and with or without exceptions, and the event that is made of it."""
    w = wide_events(spark, sf_dir)
    attribute = lambda key, value, kind="stringValue": F.struct(
        F.lit(key).alias("key"),
        F.struct(*[(value if kind == k else F.lit(None)).cast("string").alias(k) for k in ("stringValue", "intValue")]).alias("value")
    )
    given = lambda when, what: F.when(when, what)
    k = F.col("k")
    attributes = F.array_compact(F.array(
        given(k % 3 == 0, attribute("http.response.status_code", F.when(k % 2 == 0, "200").otherwise("503"), "intValue")), given(k % 3 == 1, attribute("http.request.method", F.lit("GET"))),
        given(k % 4 == 1, attribute("http.route", F.concat(F.lit("/r"), k % 7))), given(k % 5 != 0, attribute("server.address", F.concat(F.lit("https://db"), k % 3, F.lit(":5432")))),
    ))
    thrown = F.when(
        k % 7 == 0,
        F.array(
            F.struct(
                F.lit("exception").alias("name"),
                F.array(attribute("exception.type", F.lit("Boom")), attribute("exception.message", F.concat(F.lit("m"), k))).alias("attributes")
            )
        )
    )
    start = F.unix_micros(F.col("ts_start").cast("timestamp"))
    span = F.struct(
        F.md5("trace_id").alias("traceId"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 16).alias("spanId"), F.when(k % 6 == 0, F.lit("0" * 16)).otherwise("").alias("parentSpanId"), F.lit("GET /").alias("name"), (k % 6).cast("int").alias("kind"),
        F.concat(start.cast("string"), F.lit("000")).alias("startTimeUnixNano"), F.concat((start + F.col("duration_ms") * 1000).cast("string"), F.lit("999")).alias("endTimeUnixNano"), attributes.alias("attributes"), thrown.alias("events"),
        F.struct(F.when(k % 11 == 0, 2).otherwise(0).alias("code"), F.when(k % 22 == 0, "bad").otherwise("").alias("message")).alias("status"),
    )
    resource = F.struct(
        F.array_compact(
            F.array(given(k % 13 != 0, attribute("service.name", F.col("service"))), attribute("service.version", F.col("version")))
        ).alias("attributes")
    )
    body = F.to_json(
        F.struct(
            F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")
        )
    )
    made = otlp.spans_to_events(w.select(body.alias("body")), datetime(2024, 1, 25))
    step = F.get("steps", 0)
    return made.select(
        "span_id", "drop", "status", "duration_ms", "parent_span_id", F.col("anchor.error_code").alias("code"), F.get("errors", 0)["reason"].alias("reason"), step["name"].alias("step"), step["downstream"]["service"].alias("calls"), step["downstream"]["endpoint"].alias("endpoint"),
        F.get("logs", 0)["msg"].alias("log"), F.get_json_object("fields", "$.http.status").alias("http_status"), F.get_json_object("fields", "$.otel.span_kind").alias("kind"),
    )


def _alerts(spark, sf_dir):
    """Alerts of which some name an incident, that may not exist, some a trace, and some leave their environment or time open."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'signup'")
    named = F.when(
        k % 7 == 0,
        F.concat_ws(
            "|", F.concat(F.lit("svc_"), k % 5), F.concat(F.lit("step_"), k % 3), F.concat(F.lit("E"), k % 4), F.date_format("ts", "yyyyMMdd")
        )
    ).when(k % 7 == 1, "none").otherwise("")
    return e.select(F.concat(F.lit("sig_"), "event_id").alias("signal_id"), F.concat(F.lit("svc_"), k % 5).alias("service"), F.when(k % 4 == 0, "").when(k % 4 == 1, "test").otherwise("prod").alias("env"), F.when(k % 17 != 0, F.col("ts")).alias("timestamp"),
                    F.when(k % 3 == 0, F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))).alias("trace_id"), named.alias("alert_incident_id"), F.when(k % 5 != 4, F.concat(F.lit("E"), k % 4)).otherwise("").alias("alert_code"))


def _incidents(spark, sf_dir):
    s = seeds(spark, sf_dir)
    return s.withColumn(
        "status", F.when(F.col("events") % 3 == 0, "resolved").otherwise("active")
    ).withColumn("severity", F.col("events").cast("int")).withColumn("updated_at", F.col("now"))


@query
def alert_to_incident(spark, sf_dir):
    w = wide_events(spark, sf_dir)
    anchors = trace.anchors(w).join(w.select("trace_id", F.col("event_id").cast("string").alias("event_id"), "service", "error_code"), ["trace_id", "event_id"])
    return correlate.alert_to_incident(_alerts(spark, sf_dir), _incidents(spark, sf_dir), anchors, 600)


@query
def alert_evidence(spark, sf_dir):
    found = correlate.alert_evidence(seeds(spark, sf_dir), signals(spark, sf_dir), 360)
    return found.select("incident_id", "signal_id", F.col("place").cast("int").alias("place"))


@query
def deploy_fallback(spark, sf_dir):
    found = correlate.deploy_signal_fallback(seeds(spark, sf_dir), _deploys(spark, sf_dir), signals(spark, sf_dir), 60 * 24)
    return found.select("incident_id", "signal_id", "signal_at")


@query
def suspect_change(spark, sf_dir):
    deploys = _deploys(spark, sf_dir)
    first = deploys.groupBy("id").agg(F.min("service").alias("service"), F.min("first_seen").alias("first_seen"))
    rates = correlate.deploy_rate_delta(first, wide_events(spark, sf_dir), minutes=600, least=1)
    s = seeds(spark, sf_dir).withColumn("suspect_deploy_id", F.concat_ws(":", F.lit("otlp"), "service", "env", "version"))
    counts = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("n_before", "bad_before", "n_after", "bad_after")]  # -1: no such deployment
    return correlate.suspect_change(s, deploys, rates).select("incident_id", "suspect_deploy_id", "deploy_version", "deploy_first_seen", *counts)


@query
def family_samples(spark, sf_dir):
    """The samples of each incident, of which every third has some already."""
    s = seeds(spark, sf_dir).select("incident_id", "service", "step", "error_code", F.col("started_at").alias("since"), F.col("now").alias("until"), "events")
    found = state.family_samples(s, wide_events(spark, sf_dir), most=4)
    old = s.select("incident_id", F.when(F.col("events") % 3 == 0, F.array(F.lit("kept"), F.lit("too"))).alias("samples"))
    return state.stable_samples(old, found, limit=3).select("incident_id", F.array_join("samples", ",").alias("samples"))


@query
def anomaly_incidents(spark, sf_dir):
    w = wide_events(spark, sf_dir)
    traffic = detect.traffic(w, _windows(), min_volume=20, drop=0.98, surge=1.02)
    latency = detect.latency(w, _windows(), min_requests=20, factor=1.01)
    open_ = seeds(spark, sf_dir).select(
        F.lit("open").alias("incident_id"), "env", "service", F.lit(state.LATENCY_STEP).alias("step"), F.lit(state.LATENCY_CODE).alias("error_code"),
        F.lit(SINCE).cast("timestamp_ntz").alias("started_at")
    ).where("service = 'svc_1'").distinct()
    found = state.anomaly_incidents(traffic, latency, open_, "prod", F.lit(NOW).cast("timestamp_ntz"))
    return found.select("incident_id", "service", "step", "error_code", "severity", "started_at", F.round("lift", 6).alias("lift"))


@query
def rebuild_store(spark, sf_dir):
    """A store of one day's incidents, of which some are resolved, replaced by the next day's."""
    rows = seeds(spark, sf_dir).select(
        F.concat_ws("|", "service", "step", "error_code").alias("incident_id"), "env", "service", "step", "error_code",
        F.when(F.col("events") % 2 == 0, "resolved").otherwise("active").alias("status"), F.col("events").alias("severity"), "started_at",
        F.when(F.col("events") % 3 == 0, F.col("day")).otherwise("").alias("suspect_deploy_id"), "day"
    )
    day = lambda d: rows.where(F.col("day") == d).drop("day")
    return state.replace_unresolved(day("20240110"), day("20240111").withColumn("status", F.lit("active")))


DAY, FIRST_DAY = timedelta(days=1), datetime(2024, 1, 3)


def _daily_sightings(spark, sf_dir):
    found = detect.error_spikes(wide_events(spark, sf_dir), detect.windows([FIRST_DAY + k * DAY for k in range(28)], DAY), min_count=2, min_lift=1.5)
    return fold.sightings(found, "prod")


@query
def incident_fold(spark, sf_dir):
    """The store after 28 daily ticks."""
    return fold.folded(_daily_sightings(spark, sf_dir), FIRST_DAY, DAY, 28, 2.5 * DAY).drop("env", "service")


@query
def incident_transitions(spark, sf_dir):
    """What each of 28 daily ticks changed."""
    return fold.transitions(_daily_sightings(spark, sf_dir), FIRST_DAY, DAY, 28, 2.5 * DAY).drop("env", "service")


@query
def assembled_events(spark, sf_dir):
    """Each event's request from the records it would have left: a step that may stay open, an inner one that never ends, a log, and four ways to end."""
    w = wide_events(spark, sf_dir)
    at, k, bad = F.col("event_id") * 1000, F.col("k"), F.col("status").isin(*FAILED)
    ended = F.when(k % 13 == 0, "panic").when(k % 13 == 1, "timeout").when(k % 13 == 2, "aborted").otherwise("close")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("")) if not isinstance(c, str) else F.lit(c)

    def record(seq, kind, after, when=None, name="", span="", status="", code="", reason=""):
        row = F.struct(F.lit(seq).cast("bigint").alias("seq"), text(kind).alias("kind"), (at + after).alias("at_ms"), text(name).alias("name"), text(span).alias("span_id"), text(status).alias("status"), text(code).alias("code"), text(reason).alias("reason"))
        return row if when is None else F.when(when, row)

    rows = F.array(
        record(1, "open", 0), record(2, "step", 2, name=F.concat(F.lit("step_"), k % 3), span="1"), record(3, "step", 5, k % 6 == 0, name="inner", span="2"),
        record(4, "log", 7, k % 4 == 0, name="warn"), record(5, "step_end", 9 + k % 30, k % 5 != 0, span="1", status=F.when(bad, "error").otherwise("ok"), code=F.col("error_code"), reason=F.concat(F.lit("r"), k % 4), name=F.concat(F.lit("step_"), k % 3)),
        record(6, "suppress", 45, k % 17 == 0), record(7, ended, 50), record(8, "panic", 60, k % 2 == 0),
    )
    records = w.select(F.col("event_id").cast("string").alias("request_id"), "service", "env", "trace_id", "parent_span_id", F.lit(None).cast("string").alias("value"), F.inline(F.filter(rows, lambda r: r.isNotNull())))
    made, number = assembly.assemble(records), lambda c: F.coalesce(c, F.lit(-1))  # suppressed ones have none
    return made.select(
        "request_id", "status", F.col("anchor.step").alias("anchor_step"), F.col("anchor.error_code").alias("anchor_code"), number(F.size("steps")).alias("n_steps"), number(F.size("logs")).alias("n_logs"),
        F.array_join("errors.code", ",").alias("errors"), number(F.aggregate("steps", F.lit(0).cast("bigint"), lambda a, x: a + x["duration_ms"])).alias("step_ms"), "duration_ms"
    )


@query
def newest_ids(spark, sf_dir):
    """Events whose trace was not among the last 100 traces admitted."""
    return admission.newest(wide_events(spark, sf_dir).select("event_id", "trace_id", "seq"), "trace_id", "seq", 100).select("event_id", "trace_id")


@query
def report_signals(spark, sf_dir):
    s = seeds(spark, sf_dir).withColumn("until", F.col("now"))
    return state.report_signals(s, signals(spark, sf_dir), 120).select("incident_id", "signal_id", "signal_type", F.col("place").cast("int").alias("place"))


@query
def report_hash(spark, sf_dir):
    """The hashes of every incident's report: its largest families, signals, runtime evidence, suspected deployment, samples and next checks."""
    s, events, found = seeds(spark, sf_dir), wide_events(spark, sf_dir), signals(spark, sf_dir)
    until = s.withColumn("until", F.col("now"))
    ref = lambda rows, part: rows.select("incident_id", F.lit(part).alias("part"), "signal_id", "place")
    refs = ref(state.report_signals(until, found, 120), "signals").unionByName(ref(correlate.runtime_match(s, found, 120), "runtime"))
    details = found.withColumn("reason", F.concat_ws(" ", F.lit("seen <"), "signal_id"))
    matched = correlate.deploy_match(s, _deploys(spark, sf_dir), minutes=60 * 72)
    changes = matched.select("incident_id", "deploy_id", "service", F.col("deploy_first_seen").alias("deployed_at"))
    samples = s.select("incident_id", F.array(F.concat_ws("_", "service", "day"), F.lit("other")).alias("samples"))
    asked = until.withColumns({
        "services": F.lit(1), "cause": F.when(F.col("events") % 3 == 0, "deploy").when(F.col("events") % 3 == 1, "dependency").otherwise("unknown"),
        "confidence": F.when(F.col("users") > 1, "high").otherwise("low"), "warnings": F.when(F.col("events") % 2 == 0, F.array(F.lit("partial_trace"))),
    })
    families = state.top_families(until, events, 60 * 48)
    return reports.reports(asked, "2024-01-31T00:00:00Z", families, samples, None, refs, details, changes).select("incident_id", "report_hash", "evidence_fingerprint")


@query
def top_families(spark, sf_dir):
    s = seeds(spark, sf_dir).withColumn("until", F.col("now"))
    return state.top_families(s, wide_events(spark, sf_dir), 60 * 48).select(
        "incident_id", "step", "error_code", "count", F.col("place").cast("int").alias("place")
    )


@query
def retention(spark, sf_dir):
    """What is left of incidents and signals at an instant."""
    now = F.lit(UNTIL).cast("timestamp_ntz")
    old = seeds(spark, sf_dir).select(
        "incident_id", F.when(F.col("events") % 2 == 0, "resolved").otherwise("active").alias("status"), F.col("now").alias("last_seen")
    )
    left = incidents.retained(old, now).select(F.col("incident_id").alias("id"))
    return left.unionByName(state.signals_retained(signals(spark, sf_dir), now).select(F.col("signal_id").alias("id")))


@query
def instrumentation_warnings(spark, sf_dir):
    w = wide_events(spark, sf_dir)
    rows = w.select(
        "event_id", F.when(F.col("k") % 4 == 0, "").otherwise(F.col("version")).alias("version"), (F.col("k") % 2 == 0).alias("has_downstream"),
        (F.col("k") % 3 == 0).alias("has_dependency_signal"), F.when(F.col("k") % 5 == 0, "timestamp_fallback").otherwise("causal").alias("linkage")
    )
    return incidents.warnings(rows).select("event_id", F.array_join("warnings", ",").alias("warnings"))


@query
def top_insight(spark, sf_dir):
    rows = seeds(spark, sf_dir).select(
        "incident_id", "started_at", F.col("events").cast("int").alias("severity"),
        F.when(F.col("events") % 7 == 0, "resolved").otherwise("active").alias("status"),
        F.when(F.col("users") % 3 == 0, "high").when(F.col("users") % 3 == 1, "medium").otherwise("low").alias("confidence")
    )
    return incidents.insight(rows).select("incident_id", "confidence", "confidence_value")


@query
def legacy_problems(spark, sf_dir):
    """Each event as one of version 1 that lacks what its key says, and the names of what is wrong with it."""
    w = wide_events(spark, sf_dir)
    k = F.col("k")
    body = F.to_json(F.struct(
        F.when(k % 13 == 0, "2.0").otherwise("1.1").alias("schema_version"), F.lit("e").alias("event_name"), F.date_format("ts_start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.struct(F.when(k % 5 > 0, F.col("user_id")).alias("id")).alias("user"),
        F.struct("trace_id", F.when(k % 7 == 0, "p").alias("parent_span_id"), F.when(k % 11 == 0, "get").otherwise("GET").alias("http_method")).alias("request"), F.struct("service", "env").alias("system"),
        F.struct((~filters.failed()).alias("success"), F.when(k % 17 > 0, 200).otherwise(0).alias("status_code")).alias("outcome"), F.when(filters.failed() & (k % 3 > 0), F.struct(F.when(k % 3 == 1, F.col("error_code")).otherwise("").alias("code"))).alias("error"),
    ))
    rows = w.select("event_id", F.from_json(body, legacy.EVENT_V1).alias("event"))
    return rows.select("event_id", F.array_join(legacy.problems(F.col("event")), ",").alias("problems"))
