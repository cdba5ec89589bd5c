"""OTLP traces, as decoded JSON, to wide events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import event_uuid, host_of

_ATTRIBUTES = "array<struct<key:string,value:struct<stringValue:string,intValue:string,boolValue:boolean,doubleValue:double>>>"
_EVENT = f"struct<name:string,attributes:{_ATTRIBUTES}>"
SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRIBUTES},events:array<{_EVENT}>,status:struct<code:int,message:string>>"
EXPORT = f"struct<resourceSpans:array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<spans:array<{SPAN}>>>>>>"
#: Names of span kinds by number, the kinds that call others, and the status code of an error.
KINDS = ("SPAN_KIND_UNSPECIFIED", "SPAN_KIND_INTERNAL", "SPAN_KIND_SERVER", "SPAN_KIND_CLIENT", "SPAN_KIND_PRODUCER", "SPAN_KIND_CONSUMER")
CLIENT, PRODUCER, ERROR = 3, 4, 2


def _value(attributes: Column | str, name: str) -> Column:
    return F.get(F.filter(attributes, lambda a: a["key"] == name), 0)["value"]


def _text(attributes: Column | str, *names: str) -> Column:
    """The first of the attributes that is a string and not empty; else ''."""
    return F.coalesce(*[F.nullif(_value(attributes, n)["stringValue"], F.lit("")) for n in names], F.lit(""))


def spans_to_events(exports: DataFrame, now=None, step_attribute: str = "event.step", code_attribute: str = "event.error_code") -> DataFrame:
    """exports: body, a JSON export request. A row for each span: the event's columns, and drop, the reason that it makes none (missing_service,
    missing_trace_id, invalid_span, unsupported_kind: it isn't of HTTP; future_timestamp) or null.

    step_attribute, code_attribute: attributes by which a span names its step and error code itself. Malformed bodies and those without spans make no
    row. A span without start or end has null times and length.
    """
    rows = exports.select(F.from_json("body", EXPORT).alias("x")).select(F.explode("x.resourceSpans").alias("r")).select(
        "r.resource.attributes", F.explode("r.scopeSpans").alias("s")
    ).select("attributes", F.explode("s.spans").alias("s"))
    rows = rows.select(F.col("attributes").alias("resource"), "s.*")
    zero = lambda c: F.coalesce(F.col(c), F.lit("")).rlike("^0*$")
    micros = lambda c: F.expr(f"cast({c} as bigint) div 1000")  # noqa: E731  nanoseconds are beyond a double

    own = lambda x: F.nullif(x, F.lit(""))

    def once(df: DataFrame, **columns: Column) -> DataFrame:
        """df with these columns, a row for a row: they are made once here, and not again in each expression that names them."""
        return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))

    thrown = F.filter(F.coalesce("events", F.array().cast(f"array<{_EVENT}>")), lambda e: e["name"] == "exception")
    told = F.transform(thrown, lambda e: F.struct(own(_text(e["attributes"], "exception.type")).alias("type"), own(_text(e["attributes"], "exception.message")).alias("message")))
    rows = once(
        rows, thrown=told, answered=_value("attributes", "http.response.status_code")["intValue"].try_cast("int"), method=_value("attributes", "http.request.method"),
        route=_value("attributes", "http.route"), own_step=own(_text("attributes", step_attribute)), own_code=own(_text("attributes", code_attribute)), service=_text("resource", "service.name"),
        env=own(_text("resource", "deployment.environment.name", "deployment.environment")), version=_text("resource", "service.version"),
        peer=host_of(_text("attributes", "peer.service", "server.address", "net.peer.name")), elsewhere=_text("attributes", "url.path", "http.target"),
    )
    text_of = lambda c: own(F.col(f"{c}.stringValue"))
    wrong = F.coalesce(F.col("status.code") == ERROR, F.lit(False)) | (F.size("thrown") > 0)
    has_answer = F.coalesce(F.col("answered") > 0, F.lit(False))
    rows = once(
        rows, is_http=has_answer | F.col("method").isNotNull() | F.col("route").isNotNull(), is_error=wrong | (has_answer & (F.col("answered") >= 500)),
        status_code=F.when(has_answer, F.col("answered")).when(wrong, 500).otherwise(200), step=F.coalesce("own_step", text_of("route"), own(F.col("name")), F.lit("otlp.span")),
        typed=F.get(F.filter("thrown", lambda e: e["type"].isNotNull()), F.lit(0)), said=F.get(F.filter("thrown", lambda e: e["message"].isNotNull()), F.lit(0)),
    )
    any_reason = F.coalesce("said.message", own(F.col("status.message")), F.lit("otlp span reported error"))
    code = F.coalesce("own_code", "typed.type", F.concat(F.lit("HTTP_"), F.col("status_code").cast("string")))
    reason = F.when(F.col("own_code").isNull() & F.col("typed.type").isNotNull(), F.coalesce("typed.message", F.lit(""))).otherwise(any_reason)
    rows = once(rows, code=code, reason=reason)

    service, peer = F.col("service"), F.col("peer")
    start_at = F.timestamp_micros(micros("startTimeUnixNano"))
    drop = F.when(service == "", "missing_service").when(zero("traceId"), "missing_trace_id").when(zero("spanId"), "invalid_span").when(
        ~F.col("is_http"), "unsupported_kind"
    )
    if now is not None:
        drop = F.coalesce(drop, F.when(F.unix_micros(start_at) > F.unix_micros(F.lit(now).cast("timestamp")) + 300_000_000, "future_timestamp"))
    nanos = lambda c: F.col(c).cast("decimal(20,0)")
    length = F.when(nanos("endTimeUnixNano") < nanos("startTimeUnixNano"), 0).otherwise(
        F.floor((nanos("endTimeUnixNano") - nanos("startTimeUnixNano")) / 1_000_000)
    ).cast("bigint")
    end = F.greatest(micros("startTimeUnixNano"), micros("endTimeUnixNano"))
    downstream = F.struct(peer.alias("service"), F.coalesce(text_of("route"), "elsewhere").alias("endpoint"), F.lit("http").alias("kind"))
    fault = F.struct(F.col("code"), F.col("reason"), F.lit("otlp").alias("cause"))
    when_wrong = lambda x: F.when(F.col("is_error"), x)
    state = F.when(F.col("is_error"), "error").otherwise("ok")
    fields = F.to_json(F.struct(
        F.struct(F.col("status_code").alias("status"), text_of("method").alias("method"), text_of("route").alias("route")).alias("http"),
        F.struct(F.coalesce("name", F.lit("")).alias("span_name"), F.coalesce(F.get(F.array(*[F.lit(k) for k in KINDS]), F.coalesce("kind", F.lit(0))), F.col("kind").cast("string")).alias("span_kind")).alias("otel"),
    ))
    log = F.struct(
        F.lit(0).cast("bigint").alias("ts_offset_ms"), F.lit("error").alias("level"),
        F.when(F.col("reason") == "", F.col("code")).otherwise(F.col("reason")).alias("msg"),
        F.to_json(F.struct(F.col("code").alias("error_code"))).alias("fields")
    )
    return rows.select(
        event_uuid(F.lower("traceId"), F.lower("spanId")).alias("event_id"), start_at.alias("ts_start"), F.timestamp_micros(end).alias("ts_end"), length.alias("duration_ms"), service.alias("service"),
        F.coalesce("env", F.lit("unknown")).alias("env"), "version",
        F.lower("traceId").alias("trace_id"), F.lower("spanId").alias("span_id"), F.when(zero("parentSpanId"), "").otherwise(F.lower("parentSpanId")).alias("parent_span_id"), state.alias("status"),
        when_wrong(F.struct(F.col("step"), F.col("code").alias("error_code"), F.lit("otlp").alias("kind"))).alias("anchor"),
        F.array(F.struct(
            F.col("step").alias("name"), F.lower("spanId").alias("span_id"), F.lit(0).cast("bigint").alias("start_ms"), length.alias("duration_ms"), state.alias("status"),
            F.when(F.col("kind").isin(CLIENT, PRODUCER) & (peer != ""), downstream).alias("downstream"), when_wrong(fault).alias("error"),
        )).alias("steps"),
        F.when(F.col("is_error"), F.array(log)).alias("logs"), fields.alias("fields"), F.when(F.col("is_error"), F.array(F.struct("code", "reason"))).alias("errors"),
        F.col("name").alias("span_name"), drop.alias("drop"),
    )
