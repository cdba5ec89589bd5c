"""Schemas of the engine's collections."""

from __future__ import annotations

from pyspark.sql import types as T

FAILED = ("error", "timeout", "partial", "aborted")
STATUSES = ("ok", *FAILED, "suppressed")
STEP_STATUSES, LOG_LEVELS = ("ok", "error"), ("info", "warn", "error")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


S, L, TS = T.StringType(), T.LongType(), T.TimestampType()

DOWNSTREAM = _struct(service=S, endpoint=S, kind=S)
STEP = _struct(name=S, span_id=S, start_ms=L, duration_ms=L, status=S, downstream=DOWNSTREAM, error=_struct(code=S, reason=S, cause=S))
LOG = _struct(ts_offset_ms=L, level=S, msg=S, fields=S)

#: A request-level wide event, version 2.0; open maps are kept as JSON text.
EVENT = _struct(
    schema_version=S, event_id=S, ts_start=TS, ts_end=TS, duration_ms=L, kind=S, service=S, env=S, version=S, trace_id=S, span_id=S, parent_span_id=S, status=S,
    anchor=_struct(step=S, error_code=S, kind=S), steps=T.ArrayType(STEP), logs=T.ArrayType(LOG), fields=S, errors=T.ArrayType(_struct(code=S, reason=S)),
)

SIGNAL = _struct(
    signal_id=S, type=S, source=S, service=S, env=S, severity=S, reason=S, message=S, resource=S, metadata=S, timestamp=TS, received_at=TS, extra=S
)
SIGNAL_TYPES = ("deploy", "runtime", "healthcheck", "dependency", "config", "alert")
SEVERITIES = ("info", "warning", "critical")

DEPLOYMENT = _struct(id=S, service=S, version=S, env=S, first_seen=TS, last_seen=TS, metadata=T.MapType(S, S), commit_sha=S, pr_url=S, commit_author=S)
