"""Why an event's JSON is refused: the rules of the wide-event schema over VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FAILED, LOG_LEVELS, STATUSES, STEP_STATUSES

#: Patterns of the schema, and the form that times must have.
TRACE_ID, SPAN_ID = "^[0-9a-f]{32}$", "^([0-9a-f]{16})?$"
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.]\d+)?(Z|[+-]\d{2}:\d{2})$"
#: The fields of an event, and of what it holds.
EVENT = (
    "schema_version", "event_id", "ts_start", "ts_end", "duration_ms", "kind", "service", "env", "version", "trace_id", "span_id", "parent_span_id", "status",
    "anchor", "steps", "logs", "errors", "fields",
)
ANCHOR, CALL, FAULT = ("step", "error_code", "kind"), ("service", "endpoint", "kind"), ("code", "reason", "cause")
STEP = ("name", "span_id", "start_ms", "duration_ms", "status", "downstream", "error")
LOG, ERROR = ("ts_offset_ms", "level", "msg", "fields"), ("code", "reason")


def fields(value: Column, names: tuple[str, ...]) -> Column:
    """The fields of a JSON object as a struct of VARIANTs, null where absent; null for what is no object."""
    return F.try_variant_get(value, "$", f"struct<{','.join(f'{n}:variant' for n in names)}>")


def _items(value: Column, names: tuple[str, ...]) -> Column:
    return F.try_variant_get(value, "$", f"array<struct<{','.join(f'{n}:variant' for n in names)}>>")


# A rule is true where a value breaks it, and never null.


def _text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _not(test: Column) -> Column:
    return ~F.coalesce(test, F.lit(False))


def _not_text(value: Column, least: int = 0) -> Column:
    return _not(F.char_length(_text(value)) >= least)


def _not_count(value: Column) -> Column:
    """Not a whole number from 0."""
    return _not((F.schema_of_variant(value) == "BIGINT") & (F.try_variant_get(value, "$", "bigint") >= 0))


def _not_object(value: Column) -> Column:
    return _not(F.schema_of_variant(value).startswith("OBJECT"))


def _given(value: Column, rule: Column) -> Column:
    """The rule holds for a value that is there."""
    return value.isNotNull() & rule


def _texts(of: Column, *names: str) -> Column:
    return _any(_given(of[n], _not_text(of[n])) for n in names)


def _any(rules) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | rule
    return out


def _object(value: Column, names: tuple[str, ...], rule) -> Column:
    """Where it is there, it is an object that breaks no rule."""
    own = fields(value, names)
    return _given(value, own.isNull() | F.coalesce(rule(own), F.lit(True)))


def _array(value: Column, names: tuple[str, ...], rule) -> Column:
    """Where it is there, it is an array of objects that break no rule."""
    own = _items(value, names)
    return _given(value, own.isNull() | F.coalesce(F.exists(own, lambda x: x.isNull() | rule(x)), F.lit(False)))


def _bad_step(s: Column) -> Column:
    return _any([
        _not_text(s["name"], 1), _not_count(s["start_ms"]), _not_count(s["duration_ms"]), _not(_text(s["status"]).isin(*STEP_STATUSES)),
        _given(s["span_id"], _not(_text(s["span_id"]).rlike(SPAN_ID))), _object(s["downstream"], CALL, lambda d: _texts(d, *CALL)),
        s["downstream"].isNotNull() & s["span_id"].isNull(), _object(s["error"], FAULT, lambda e: _texts(e, *FAULT)),
    ])


def _bad_log(x: Column) -> Column:
    return _any([
        _not_count(x["ts_offset_ms"]), _not(_text(x["level"]).isin(*LOG_LEVELS)), _not_text(x["msg"]), _given(x["fields"], _not_object(x["fields"]))
    ])


def breaks_schema(e: Column) -> Column:
    """Whether the fields of a JSON object, of fields(), are no wide event of version 2.0; so is null."""
    like = lambda name, pattern: _not(_text(e[name]).rlike(pattern))
    return _any([
        e.isNull(), _not(_text(e["schema_version"]) == "2.0"), _not(_text(e["kind"]) == "http"), _not(_text(e["status"]).isin(*STATUSES)), like("trace_id", TRACE_ID),
        _not_text(e["event_id"]), _not_text(e["service"], 1), _not_text(e["env"], 1), like("ts_start", RFC3339), like("ts_end", RFC3339),
        _given(e["duration_ms"], _not_count(e["duration_ms"])), _texts(e, "version"), _given(e["span_id"], like("span_id", SPAN_ID)),
        _given(e["parent_span_id"], like("parent_span_id", SPAN_ID)), _given(e["fields"], _not_object(e["fields"])),
        _object(e["anchor"], ANCHOR, lambda a: _not_text(a["step"], 1) | _not_text(a["error_code"], 1) | _texts(a, "kind")),
        F.coalesce(_text(e["status"]).isin(*FAILED), F.lit(False)) & e["anchor"].isNull(),
        _array(e["steps"], STEP, _bad_step), _array(e["logs"], LOG, _bad_log), _array(e["errors"], ERROR, lambda x: _not_text(x["code"]) | _texts(x, "reason")),
    ])


def reject_reason(valid_json: Column, own: Column, event: Column) -> Column:
    """Why an event is refused, or null. valid_json: whether its text is JSON; own: its fields(); event: it, parsed with the schema of events, whose times must be real ones."""
    undated = event.getField("ts_start").isNull() | event.getField("ts_end").isNull()
    version = F.coalesce(_text(own["schema_version"]), F.lit(""))
    bad = breaks_schema(own) | F.coalesce(undated, F.lit(True))
    return F.when(~valid_json, "invalid_json").when(version.startswith("1."), "bridge_not_implemented").when(bad, "schema_validation_failed")
