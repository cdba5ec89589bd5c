"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_text(*values: Column) -> Column:
    """The first value that is not blank, trimmed; else ''."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values], F.lit(""))


def host_of(peer: Column) -> Column:
    """An address without http:// or https://, and without what follows its last colon, but for a colon in front."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(peer, "^http://", ""), "^https://", ""), r"^(.+):[^:]*$", "$1")


def severity_of(text: Column) -> Column:
    """Providers' words for critical, info and, for all others, warning."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(low.isin("critical", "error", "high", "triggered"), "critical").when(low.isin("info", "resolved", "ok"), "info").otherwise("warning")


def event_uuid(trace_id: Column, span_id: Column) -> Column:
    """A version-5-shaped id that is always the same for a span."""
    h = F.sha2(F.concat(trace_id, F.lit(":"), span_id), 256)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12)
    )


def short_ref(text: Column) -> Column:
    """The first 12 bytes of a longer text, and an ellipsis; a character that is cut through reads as the replacement character."""
    head = F.decode(F.substring(F.encode(text, "UTF-8"), 1, 12), "UTF-8")
    return F.when(F.octet_length(text) > 12, F.concat(head, F.lit("…"))).otherwise(text)


def route(fields: Column) -> Column:
    """fields.http.route, where it is a string; else ''."""
    return string_at(fields, "$.http.route", F.lit(""))


def string_at(json: Column, path: str, otherwise: Column) -> Column:
    """What is at a path of a JSON text, where it is a string."""
    value = F.try_variant_get(F.try_parse_json(json), path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(otherwise)


def user_id(fields: Column) -> Column:
    """fields.user.id, where it is a string; else null."""
    return string_at(fields, "$.user.id", F.lit(None).cast("string"))
