"""Events of version 1: validation with all errors at once, and the search of their log."""

from __future__ import annotations

import base64
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Methods that an event may name.
METHODS = ("GET", "HEAD", "POST", "PUT", "DELETE", "CONNECT", "OPTIONS", "TRACE", "PATCH")
#: An event of version 1, as far as it is looked at.
EVENT_V1 = (
    "struct<schema_version:string,event_name:string,timestamp:timestamp,user:struct<id:string,tier:string,vip:boolean>,request:struct<trace_id:string,span_id:string,parent_span_id:string,http_method:string,route_template:string,attempt:int>,"
    "system:struct<service:string,version:string,env:string>,outcome:struct<success:boolean,status_code:int>,error:struct<code:string,message:string>,metrics:struct<latency_ms:bigint>,retry:struct<of:int>>"
)


def problems(event: Column, without_user: bool = False) -> Column:
    """The sorted names of the fields that are missing or wrong; empty for a valid event, and null for a null one. without_user: events that came as
    spans may lack a user."""
    at = lambda path: _at(event, path)
    blank = lambda path: F.coalesce(at(path), F.lit("")) == ""
    says = lambda test, name: F.when(F.coalesce(test, F.lit(False)), name)
    ok = F.coalesce(at("outcome.success"), F.lit(False))
    found = [
        says(~F.coalesce(at("schema_version").rlike(r"^[+-]?0*1\.[+-]?[0-9]+$") & ~at("schema_version").startswith("-"), F.lit(False)), "schema_version"), says(blank("event_name"), "event_name"), says(at("timestamp").isNull(), "timestamp"),
        says(blank("user.id") & F.lit(not without_user), "user.id"), says(blank("request.trace_id"), "request.trace_id"), says(~blank("request.parent_span_id") & blank("request.span_id"), "request.span_id"),
        says(~blank("request.http_method") & ~at("request.http_method").isin(*METHODS), "request.http_method"), says(~blank("request.route_template") & ~at("request.route_template").startswith("/"), "request.route_template"),
        says(blank("system.service"), "system.service"), says(blank("system.env"), "system.env"), says(F.coalesce(at("outcome.status_code"), F.lit(0)) == 0, "outcome.status_code"),
        says(~ok & at("error").isNull(), "error"), says(~ok & at("error").isNotNull() & blank("error.code"), "error.code"),
        says((F.coalesce(at("retry.of"), F.lit(0)) != 0) & (at("retry.of") < F.coalesce(at("request.attempt"), F.lit(0))), "retry.of"),
    ]
    return F.when(event.isNotNull(), F.array_sort(F.array_compact(F.array(*found))))


def _at(event: Column, path: str) -> Column:
    for name in path.split("."):
        event = event.getField(name)
    return event


def search(entries: DataFrame, trace_id=None, user_id=None, service=None, error_code=None, since=None, until=None, limit: int = 50) -> DataFrame:
    """entries: event, of intake.legacy_entries(). Those that fit all that is asked for, newest first; 50 where no limit is given, and never over
    200."""
    keep = F.lit(True)
    for path, value in (("request.trace_id", trace_id), ("user.id", user_id), ("system.service", service), ("error.code", error_code)):
        if value:
            keep = keep & (_at(F.col("event"), path) == value)
    stamp = F.col("event.timestamp")
    keep = keep if since is None else keep & (stamp >= since)
    keep = keep if until is None else keep & (stamp <= until)
    return entries.where(keep).orderBy(F.desc("event.timestamp")).limit(min(limit if limit > 0 else 50, 200))


def row_cursor(row_id: int) -> str:
    return base64.urlsafe_b64encode(str(row_id).encode()).decode()


def row_of(cursor: str) -> int:
    """0 for an empty cursor; ValueError for a bad one."""
    return int(base64.urlsafe_b64decode(cursor.encode()).decode()) if cursor else 0


def time_cursor(at: datetime, trace_id: str) -> str:
    return base64.urlsafe_b64encode(f"{at.isoformat()}Z|{trace_id}".encode()).decode()


def time_of(cursor: str) -> tuple[datetime | None, str]:
    """The time and the trace; nothing for an empty cursor, ValueError for a bad one."""
    if not cursor:
        return None, ""
    at, bar, trace_id = base64.urlsafe_b64decode(cursor.encode()).decode().partition("|")
    if not bar:
        raise ValueError("a time cursor has a time and a trace")
    return datetime.fromisoformat(at.removesuffix("Z")), trace_id


def expired_logs(names: DataFrame, before: datetime, active: str | None = None) -> DataFrame:
    """name of the log files events-YYYYMMDD-HHMMSS[-N].jsonl whose time is before that; the active file and names of another form are never among
    them."""
    stamp = F.regexp_extract("name", r"^events-(\d{8}-\d{6})(-[^-]*)?\.jsonl$", 1)
    old = F.try_to_timestamp(stamp, F.lit("yyyyMMdd-HHmmss")) < F.lit(before)
    return names.where(F.coalesce(old, F.lit(False)) & (F.col("name") != F.lit(active or ""))).select("name")
