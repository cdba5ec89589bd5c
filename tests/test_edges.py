"""Parameters, sources, report and streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gritstone.functions import params, text
from gritstone.plans import report
from gritstone.sources import alerts, intake, legacy, otlp
from gritstone.streaming import stream

NOW = datetime(2024, 1, 2, 3, 4, 5)
VALID = {
    "schema_version": "2.0", "event_id": "e1", "ts_start": "2024-01-01T00:00:00Z", "ts_end": "2024-01-01T00:00:01Z", "kind": "http", "service": "s",
    "env": "prod", "trace_id": "a" * 32, "status": "ok"
}


def test_windows():
    parse = lambda **q: params.Params.parse(q, NOW, timedelta(hours=1), timedelta(days=1))
    assert parse().since == NOW - timedelta(hours=1)
    assert parse(window="90m").since == NOW - timedelta(minutes=90)
    assert parse(until="2024-01-02T00:00:00Z").since == datetime(2024, 1, 1)
    assert parse(status="ok, error").statuses == ("ok", "error")
    for bad, code in (
        ({"window": "2d"}, "over_limit"), ({"since": "2023-12-01T00:00:00Z"}, "over_limit"), ({"limit": "201"}, "over_limit"),
        ({"limit": "0"}, "bad_request"), ({"status": "odd"}, "bad_request"), ({"x": "1"}, "bad_request"), ({"since": "soon"}, "bad_request")
    ):
        with pytest.raises(params.QueryError) as e:
            parse(**bad)
        assert e.value.code == code
    assert params.duration("1h30m") == timedelta(minutes=90) and params.duration("7d") == timedelta(days=7)
    assert params.instant("2024-01-01T01:00:00.123456789+01:00") == datetime(2024, 1, 1, 0, 0, 0, 123456)


def test_family_codec():
    assert params.parse_family(params.format_family("a:b", "c", "d:")) == ("a:b", "c", "d:")
    for bad in ("", "a", "a:b", "a:b:", ":b:c", "a:b:c:d", "a\\x:b:c"):
        with pytest.raises(params.QueryError):
            params.parse_family(bad)
    assert params.blast_key({"error_code": "C"}) == (None, None, "C")
    with pytest.raises(params.QueryError):
        params.blast_key({"error_code": "C", "service": "s"})


def test_cursor_and_traceparent():
    assert params.parse_cursor(params.cursor({"a": 1, "b": "x"}), ("a", "b")) == {"a": 1, "b": "x"}
    with pytest.raises(params.QueryError):
        params.parse_cursor("%%", ("a",))
    header = params.format_traceparent("ab" * 16, "cd" * 8)
    assert params.traceparent(header) == ("ab" * 16, "cd" * 8, True)
    assert params.traceparent(header.upper()) is None and params.traceparent("00-" + "0" * 32 + "-" + "cd" * 8 + "-01") is None


def lines(spark, rows):
    return spark.createDataFrame([("b", k, r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(rows)], "batch string, line int, value string")


def test_intake(spark):
    rows = [
        VALID, "{broken", VALID | {"schema_version": "1.1"}, VALID | {"event_id": "e2", "service": ""}, VALID, "",
        VALID | {"event_id": "e3", "status": "error"}, VALID | {"event_id": "e4", "status": "error", "anchor": {"step": "a", "error_code": "C"}},
        VALID | {"event_id": "e5", "trace_id": "short"}
    ]
    parsed = intake.parse(lines(spark, rows))
    assert [r.reason for r in parsed.orderBy("line").collect()] == [
        None, "invalid_json", "bridge_not_implemented", "schema_validation_failed", None, "schema_validation_failed", None, "schema_validation_failed"
    ]
    got = intake.envelope(parsed).collect()[0]
    assert (got.accepted, got.duplicate, len(got.rejected)) == (2, 1, 5)
    assert intake.oversized(lines(spark, ["x"] * 257)).count() == 1


def test_log_round_trip(spark, tmp_path):
    with open(tmp_path / "events-1.jsonl", "w") as f:
        f.write(
            "\n".join(
                [
                    json.dumps(VALID), "{", json.dumps(VALID | {"schema_version": "1.0"}), json.dumps(VALID),
                    json.dumps(VALID | {"event_id": "old", "ts_end": "2020-01-01T00:00:00Z"})
                ]
            )
        )
    events, skipped = intake.replay(intake.read_log(spark, str(tmp_path)), datetime(2023, 1, 1))
    assert [r.event_id for r in events.collect()] == ["e1"]
    assert {r.skip: r.lines for r in skipped.collect()} == {"malformed_json": 1, "schema_invalid": 1, "stale": 1}


def test_alert_providers(spark):
    label = {"service": "s", "env": "prod", "severity": "error", "alertname": "Hot", "error_code": "C"}
    bodies = [
        {"source": "own", "service": "s", "env": "e", "reason": "r", "severity": "ok"},
        {"receiver": "x", "alerts": [{"labels": label, "fingerprint": "f", "startsAt": "2024-01-01T00:00:00Z"}]},
        {"orgId": 1, "title": "T", "ruleUID": "u", "alerts": [{"labels": label}]},
        {"messages": [{"event": {"id": "m", "data": {"id": "d", "title": "P", "env": "e", "service": {"summary": "s"}, "urgency": "high"}}}]},
        {"odd": 1},
    ]
    df = spark.createDataFrame(
        [(k, json.dumps(b)) for k, b in enumerate(bodies)] + [(9, "nope"), (8, json.dumps({"source": "own", "service": "s"}))], "n int, body string"
    )
    got = {r.n: r for r in alerts.normalize(df, NOW).collect()}
    assert [got[k].provider for k in range(4)] == ["native", "alertmanager", "grafana", "pagerduty"]
    assert [got[k].severity for k in range(4)] == ["info", "critical", "critical", "critical"]
    assert [got[k].alert_id for k in range(4)] == ["", "f", "u", "d"] and got[3].service == "s"
    assert {k: got[k].error for k in (0, 1, 2, 3, 4, 8, 9)} == {
        0: None, 1: None, 2: None, 3: None, 4: "unsupported_alert", 8: "missing_fields", 9: "invalid_json"
    }


def test_otlp(spark):
    attr = lambda **kw: [{"key": k.replace("_", "."), "value": {"stringValue": v}} for k, v in kw.items()]
    http = [{"key": "http.request.method", "value": {"stringValue": "GET"}}]
    span = {
        "traceId": "ab" * 16, "spanId": "cd" * 8, "name": "GET /", "kind": 3, "startTimeUnixNano": "1704067200000000000",
        "endTimeUnixNano": "1704067200250000000", "attributes": attr(peer_service="http://db:5432") + http, "status": {"code": 2}
    }
    thrown = {
        "name": "exception",
        "attributes": [
            {"key": "exception.type", "value": {"stringValue": "Boom"}}, {"key": "exception.message", "value": {"stringValue": "it broke"}}
        ]
    }
    spans = [
        span, span | {"spanId": "0" * 16}, span | {"spanId": "11" * 8, "attributes": []}, span | {"spanId": "22" * 8, "status": {}, "events": [thrown], "parentSpanId": "0" * 16}, span | {"spanId": "33" * 8, "startTimeUnixNano": "1804067200000000000"},
        span | {"spanId": "44" * 8, "status": {}, "endTimeUnixNano": "1704067100000000000", "attributes": [{"key": "http.response.status_code", "value": {"intValue": "503"}}, {"key": "event.step", "value": {"stringValue": "pay"}}]},
        span | {"spanId": "55" * 8, "status": {}, "kind": 2, "attributes": [{"key": "http.status_code", "value": {"intValue": "503"}}, *http]},
    ]
    body = {
        "resourceSpans": [
            {"resource": {"attributes": attr(service_name="s")}, "scopeSpans": [{"spans": spans}]},
            {"resource": {"attributes": []}, "scopeSpans": [{"spans": [span | {"spanId": "66" * 8}]}]}
        ]
    }
    got = {
        r.span_id[:2]: r for r in otlp.spans_to_events(
            spark.createDataFrame([(json.dumps(body),), ("nope",), (None,)], "body string"), datetime(2024, 1, 2)
        ).collect()
    }
    good = got["cd"]
    assert (
        good.duration_ms, good.status, good.env, good.anchor.error_code, good.anchor.kind, good.steps[0].downstream.service
    ) == (250, "error", "unknown", "HTTP_500", "otlp", "db")
    assert good.event_id[14] == "5" and len(good.event_id) == 36 and good.errors[0].reason == "otlp span reported error" and good.logs[0].level == "error"
    assert {k: got[k].drop for k in got} == {
        "cd": None, "00": "invalid_span", "11": "unsupported_kind", "22": None, "33": "future_timestamp", "44": None, "55": None,
        "66": "missing_service"
    }
    assert (got["22"].status, got["22"].anchor.error_code, got["22"].errors[0].reason, got["22"].parent_span_id) == ("error", "Boom", "it broke", "")
    assert (got["44"].status, got["44"].anchor.error_code, got["44"].steps[0].name, got["44"].duration_ms) == ("error", "HTTP_503", "pay", 0)
    assert got["55"].status == "ok" and got["55"].anchor is None and got["55"].logs is None  # the legacy attribute says nothing


def test_schema_rules(spark):
    """Each entry breaks one rule, or none."""
    step = {"name": "a", "span_id": "0" * 16, "start_ms": 0, "duration_ms": 1, "status": "ok"}
    bad = [
        {"span_id": "xyz"}, {"parent_span_id": "0"}, {"duration_ms": -1}, {"duration_ms": "5"}, {"duration_ms": 1.5}, {"version": 1}, {"kind": "rpc"}, {"status": "late"}, {"env": ""}, {"event_id": 7}, {"ts_start": "2024-01-01"}, {"ts_end": "2024-13-01T00:00:00Z"}, {"trace_id": "A" * 32},
        {"status": "error"}, {"anchor": {"step": "", "error_code": "x"}}, {"anchor": None}, {"anchor": {"step": "a"}}, {"steps": {}}, {"steps": [None]}, {"steps": [step | {"name": ""}]}, {"steps": [step | {"status": "x"}]}, {"steps": [{"name": "a"}]}, {"steps": [step | {"start_ms": -1}]},
        {"steps": [{k: v for k, v in step.items() if k != "span_id"} | {"downstream": {}}]}, {"steps": [step | {"downstream": {"service": 1}}]}, {"steps": [step | {"error": "x"}]}, {"logs": [{"ts_offset_ms": 0, "level": "debug", "msg": ""}]}, {"logs": [{"level": "warn", "msg": ""}]},
        {"logs": [{"ts_offset_ms": 0, "level": "warn", "msg": "", "fields": 1}]}, {"errors": [{"reason": "x"}]}, {"errors": [{"code": 1}]}, {"fields": "x"}, {"schema_version": "3"}, {"schema_version": 2},
    ]
    good = [
        {}, {"span_id": ""}, {"steps": [step]}, {"steps": [step | {"downstream": {"service": "x"}, "error": {"code": "c"}}]}, {"steps": []},
        {"logs": [{"ts_offset_ms": 0, "level": "info", "msg": "", "fields": {"a": 1}}]}, {"errors": [{"code": ""}]}, {"fields": {}}, {"more": 1},
        {"event_id": "anything"}, {"status": "suppressed"}, {"anchor": {"step": "a", "error_code": "x"}}
    ]
    odd = ["[]", "7", '{"a":1} x', "{} {}", "{'a': 1}"]
    got = [r.reason for r in intake.parse(lines(spark, [VALID | x for x in bad + good] + odd)).orderBy("line").collect()]
    assert got[: len(bad)] == ["schema_validation_failed"] * len(bad)
    assert got[len(bad) : len(bad) + len(good)] == [None] * len(good)
    assert got[-len(odd) :] == ["schema_validation_failed"] * 2 + ["invalid_json"] * 3


def test_notify_hands_over_everything(spark):
    sent = []

    def send(rows):
        sent.append(len(rows))
        if len(sent) == 1:
            raise RuntimeError("down")

    df = spark.range(25).withColumn("transition", F.when(F.col("id") % 5 > 0, "opened"))
    stream.notify(df, send, at_once=7)
    assert sum(sent) == 20 and max(sent) == 7

def sample_report(**more):
    return report.build(
        {"incident_id": "inc_1", "window": "15m", "confidence": "high"}, {"requests": 3, "users": 2, "services": 1},
        [{"service": "s<b>", "step": "a", "error_code": "C", "count": 3}], "2024-01-01T00:00:00Z",
        signals=[{"id": "sig", "type": "alert", "evidence_ids": []}], suspect_change={"deploy_id": "d", "service": "s", "error_rate_after": 0.5},
        **more
    )


def test_report():
    one, two = sample_report(), sample_report(plan_run_id="run")
    two["suspect_change"]["error_rate_after"] = 0.9
    assert one["report_hash"] == report.report_hash(two) and one["evidence_fingerprint"] == two["evidence_fingerprint"]
    assert "\\u003cb\\u003e" in report.canonical(one) and "error_rate" not in report.canonical(one | {"suspect_change": {"deploy_id": "d", "service": "s"}})
    assert one["report_hash"] != report.report_hash(one | {"confidence": "low"})
    assert report.problems({}) == ["schema_version", "incident_ref.id", "confidence", "generated_at"]
    assert "inc_1" in report.markdown(one) and report.slack_blocks(one) and report.pagerduty_event(one, "k")["dedup_key"] == "inc_1"
    assert [c["id"] for c in report.next_checks("dependency", "s", "db", None, ["partial_trace"])] == ["dependency-health", "partial_trace"]


def test_text(spark):
    df = spark.createDataFrame([("http://db.local:5432", "1234567890123")], "peer string, ref string")
    assert tuple(df.select(text.host_of(F.col("peer")), text.short_ref(F.col("ref"))).collect()[0]) == ("db.local", "123456789012…")


def test_stream_is_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [VALID, VALID, VALID | {"event_id": "e2"}, "{"]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    for q in stream.ingest(stream.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp")):
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["e1", "e2"]
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["invalid_json"]


def test_legacy_events(spark):
    good = {
        "schema_version": "1.1", "event_name": "pay", "timestamp": "2024-01-01T00:00:00Z", "user": {"id": "u"}, "request": {"trace_id": "t"},
        "system": {"service": "s", "env": "prod"}, "outcome": {"success": True, "status_code": 200}
    }
    cases = [
        ({}, []), ({"schema_version": "2.0"}, ["schema_version"]), ({"schema_version": "1"}, ["schema_version"]), ({"user": {}, "event_name": ""}, ["event_name", "user.id"]), ({"request": {"trace_id": "t", "parent_span_id": "p", "http_method": "get", "route_template": "x"}}, ["request.http_method", "request.route_template", "request.span_id"]),
        ({"outcome": {"success": False, "status_code": 500}}, ["error"]), ({"outcome": {"success": False, "status_code": 0}, "error": {"code": ""}}, ["error.code", "outcome.status_code"]), ({"retry": {"of": 1}, "request": {"trace_id": "t", "attempt": 2}}, ["retry.of"]), ({"system": {}, "timestamp": None}, ["system.env", "system.service", "timestamp"]),
    ]
    df = spark.createDataFrame(
        [(k, json.dumps(good | more)) for k, (more, _) in enumerate(cases)], "n int, value string"
    ).withColumn("event", F.from_json("value", legacy.EVENT_V1))
    assert [r.p for r in df.select("n", legacy.problems(F.col("event")).alias("p")).orderBy("n").collect()] == [p for _, p in cases]
    lines = [
        json.dumps(
            {"logged_at": "2024-01-02T00:00:00Z", "event": good | {"user": {"id": f"u{k % 2}"}, "timestamp": f"2024-01-01T00:00:{k:02}Z"}}
        ) for k in range(20)
    ] + [json.dumps(good)]
    entries = intake.legacy_entries(
        spark.createDataFrame([(x,) for x in lines], "value string"), spark.createDataFrame([], f"e {legacy.EVENT_V1}").schema["e"].dataType
    )
    got = legacy.search(entries, user_id="u1", since=datetime(2024, 1, 1, 0, 0, 5), limit=3).collect()
    assert [r.event.timestamp.second for r in got] == [19, 17, 15] and legacy.search(entries).count() == 21
    assert legacy.row_of(legacy.row_cursor(42)) == 42 and legacy.row_of("") == 0 and legacy.time_of(legacy.time_cursor(NOW, "a|b")) == (NOW, "a|b")
    names = spark.createDataFrame(
        [
            (n,) for n in (
                "events-20240101-000000.jsonl", "events-20240101-000000-2.jsonl", "events-20240301-000000.jsonl", "events-x.jsonl", "other.jsonl",
                "events-20230101-000000.jsonl"
            )
        ],
        "name string"
    )
    assert {
        r.name for r in legacy.expired_logs(names, datetime(2024, 2, 1), "events-20230101-000000.jsonl").collect()
    } == {"events-20240101-000000.jsonl", "events-20240101-000000-2.jsonl"}
