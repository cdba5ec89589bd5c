"""The triage reports of all incidents at once: canonical JSON as a column, hashed where the rows are.

A report's parts are gathered by incident in one shuffle; each part has a bounded number of rows an incident (the caps of state.report_signals(),
state.top_families(), incidents.cap_evidence() and so on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .report import CHECKS, CONFIDENCES, GAPS, INNER, ORDER, VERSION, WIDEN

#: What JSON escapes beside quotes and backslashes, and what stands for it there; the last five so that no page takes text for markup.
SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
ESCAPED = {chr(c): SHORT.get(chr(c), f"\\u{c:04x}") for c in (*range(32), ord("<"), ord(">"), ord("&"), 0x2028, 0x2029)}
RARE = r"[\x00-\x1f<>&\u2028\u2029]"


def quoted(text: Column) -> Column:
    """A text as a JSON string; null as null. Most texts hold nothing rare, and are looked at once."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rare = plain
    for c, escape in ESCAPED.items():
        rare = F.replace(rare, F.lit(c), F.lit(escape))
    return F.coalesce(F.concat(F.lit('"'), F.when(text.rlike(RARE), rare).otherwise(plain), F.lit('"')), F.lit("null"))


def listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def membered(name: str | None, values: dict[str, Column], fields: tuple[str, ...] | None = None) -> Column:
    """A JSON object of the fields of INNER[name], in that order: values are JSON already; one that is marked ? is left out where null."""
    parts = []
    for field in fields or INNER[name]:
        key = field.rstrip("?")
        if key in values:
            value = values[key] if field.endswith("?") else F.coalesce(values[key], F.lit("null"))
            parts.append(F.concat(F.lit(f'"{key}":'), value))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def unless_empty(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", quoted(text))


def rfc3339(at: Column) -> Column:
    """An instant in UTC, with as many digits of a second as it has."""
    micros = F.unix_micros(at.cast("timestamp"))
    digits = F.rtrim(F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("0"))
    whole = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.floor(micros / 1_000_000)), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(digits != "", F.concat(F.lit("."), digits)).otherwise(""), F.lit("Z"))


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def _part(df: DataFrame | None, part: str, place: str, json: Column, ident: Column) -> DataFrame | None:
    if df is None:
        return None
    return df.select("incident_id", F.lit(part).alias("part"), F.col(place).cast("bigint").alias("place"), json.alias("json"), ident.alias("id"))


def _of_signals(refs: DataFrame, details: DataFrame) -> list[DataFrame]:
    """The parts signals, alerts and runtime: each reference with what its signal says."""
    meta = lambda key: F.get_json_object("metadata", f"$.{key}") if "metadata" in details.columns else F.lit(None).cast("string")
    d = details.select(
        F.col("signal_id"), *[_text(details, c).alias(c) for c in ("type", "source", "service", "severity", "reason")], F.col("timestamp"),
        meta("alert_id").alias("alert_id"), meta("provider_url").alias("provider_url"), F.coalesce(meta("subtype"), F.lit("")).alias("subtype")
    ).dropDuplicates(["signal_id"])
    rows = refs.select("incident_id", "part", "place", "signal_id").join(d, "signal_id")
    q = {c: quoted(F.col(c)) for c in ("signal_id", "type", "source", "service", "severity", "reason", "subtype")}
    own = {"id": q["signal_id"], "evidence_ids": listed(F.array(q["signal_id"]))} | q
    own |= {"alert_id": unless_empty(F.col("alert_id")), "provider_url": unless_empty(F.col("provider_url")), "occurred_at": quoted(rfc3339(F.col("timestamp")))}
    return [_part(rows.where(F.col("part") == p), p, "place", membered(p, own), F.col("signal_id")) for p in ("signals", "alerts", "runtime")]


def next_checks(cause: Column, service: Column, downstream: Column, deploy: Column, warnings: Column) -> Column:
    """JSON texts of report.next_checks()."""
    filled = lambda text: F.replace(F.replace(F.replace(F.lit(text), F.lit("{service}"), service), F.lit("{downstream}"), downstream), F.lit("{deploy}"), deploy)
    check = lambda name, text: F.concat(F.lit(f'{{"id":"{name}","prompt":'), quoted(text), F.lit("}"))
    first = F.lit(None).cast("string")
    for key, (name, text) in CHECKS.items():
        first = F.when(cause == key, check(name, filled(text))).otherwise(first)
    first = F.coalesce(first, check(WIDEN[0], filled(WIDEN[1])))
    gaps = F.array(*[F.when(F.array_contains(warnings, name), check(name, F.lit(text))) for name, text in sorted(GAPS.items())])
    return F.concat(F.array(first), F.filter(gaps, lambda x: x.isNotNull()))


def reports(
    incidents: DataFrame, generated_at: str, families: DataFrame | None = None, samples: DataFrame | None = None, stories: DataFrame | None = None,
    refs: DataFrame | None = None, details: DataFrame | None = None, changes: DataFrame | None = None, window: str = "15m"
) -> DataFrame:
    """incident_id, report (JSON, with its hashes), report_hash and evidence_fingerprint of each row of incidents.

    incidents: incident_id, service, cause, confidence, requests, users and services; and where known downstream_service, warnings (array), and what was
    captured when the incident was last seen, which then comes before what is computed now: blast (requests, users, services, sampled_traces) and
    propagation (origin_service, origin_step, sample_trace_id, path of step, status, error_code). families: of state.top_families(). samples:
    incident_id and samples, of state.stable_samples(). stories: incident_id and the story, of trace.trace_stories(), of its first sample. refs:
    incident_id, part (signals, alerts or runtime), signal_id and place; details: the signals with source, reason, metadata. changes: incident_id,
    deploy_id, service, version, commit_sha, pr_url, commit_author, deployed_at, error_rate_before, error_rate_after.

    Parts that have no rows are left out. An unknown confidence counts as medium; null numbers are 0. Rows with a null incident_id have no report.
    Incidents are rows of their own; of several stories, samples or changes of one the least is taken.
    """
    i = incidents.where("coalesce(incident_id, '') <> ''")
    have = set(i.columns)
    i = i.withColumn("_blast", F.col("blast") if "blast" in have else F.lit(None).cast("struct<requests:bigint,users:bigint,services:bigint,sampled_traces:array<string>>"))
    i = i.withColumn(
        "_story", F.col("propagation") if "propagation" in have else F.lit(None).cast("struct<origin_service:string,origin_step:string,sample_trace_id:string,path:array<struct<step:string,status:string,error_code:string>>>")
    )
    parts = [_part(families, "families", "place", membered("top_error_families", {c: quoted(F.col(c)) for c in ("service", "step", "error_code")} | {"count": F.col("count").cast("string")}), F.lit(None).cast("string")) if families is not None else None]
    if refs is not None and details is not None:
        parts += _of_signals(refs, details)
    if changes is not None:
        c = changes.where("coalesce(deploy_id, '') <> ''")
        named = {n: unless_empty(_text(c, n)) for n in ("version", "commit_sha", "pr_url", "commit_author")}
        rates = {n: F.col(n).cast("string") for n in ("error_rate_before", "error_rate_after") if n in c.columns}
        named |= {n: quoted(_text(c, n)) for n in ("deploy_id", "service")} | {"deployed_at": quoted(rfc3339(F.col("deployed_at")))}
        both = F.concat(membered("suspect_change", named), F.lit("\n"), membered("suspect_change", named | rates))
        parts.append(_part(c.withColumn("place", F.lit(1)), "change", "place", both, F.col("deploy_id")))
    if samples is not None:
        s = samples.where(F.size("samples") > 0).select("incident_id", F.posexplode("samples").alias("place", "trace"))
        parts.append(_part(s, "samples", "place", F.lit(None).cast("string"), F.col("trace")))
    found = [p for p in parts if p is not None]
    if found:
        every = found[0]
        for p in found[1:]:
            every = every.unionByName(p)
        every = every.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("part", "place", "id", "json"))).alias("_parts"))
        i = i.join(every, "incident_id", "left")
    else:
        i = i.withColumn("_parts", F.lit(None).cast("array<struct<part:string,place:bigint,id:string,json:string>>"))
    if stories is not None:
        step = F.transform("path", lambda s: F.struct(s["name"].alias("step"), s["status"].alias("status")))
        told = F.struct("service", F.coalesce("anchor.step", F.lit("")).alias("origin_step"), F.col("anchor.error_code").alias("error_code"), "trace_id", step.alias("path"))
        i = i.join(stories.groupBy("incident_id").agg(F.min(told).alias("_told")), "incident_id", "left")
    else:
        i = i.withColumn("_told", F.lit(None).cast("struct<service:string,origin_step:string,error_code:string,trace_id:string,path:array<struct<step:string,status:string>>>"))
    return _assembled(i, generated_at, window)


def _assembled(i: DataFrame, generated_at: str, window: str) -> DataFrame:
    of = lambda part: F.filter(F.coalesce("_parts", F.array().cast("array<struct<part:string,place:bigint,id:string,json:string>>")), lambda p: p["part"] == part)
    number = lambda name: F.coalesce(F.when(F.col("_blast").isNotNull(), F.col(f"_blast.{name}")).otherwise(F.col(name) if name in i.columns else F.lit(0)), F.lit(0)).cast("string")
    jsons = lambda part: F.transform(of(part), lambda p: p["json"])
    some = lambda items: F.when(F.size(items) > 0, listed(items))
    named = lambda kind, items: F.transform(items, lambda p: F.concat(F.lit(f"{kind}:"), p["id"]))

    # The first failure: as captured, else of the story.
    captured = F.col("_story").isNotNull()
    pick = lambda a, b: F.when(captured, F.col(f"_story.{a}")).otherwise(F.col(f"_told.{b}"))
    service, step, trace = F.coalesce(pick("origin_service", "service"), F.lit("")), F.coalesce(pick("origin_step", "origin_step"), F.lit("")), pick("sample_trace_id", "trace_id")
    wrong = F.get(F.filter("_story.path", lambda s: s["status"] == "error"), F.lit(0))
    wrong_told = F.get(F.filter("_told.path", lambda s: s["status"] == "error"), F.lit(0))
    fields = ("origin_service", "origin_step", "first_failing_step?", "error_code?", "sample_trace_id?")
    failure = membered(None, {
        "origin_service": quoted(service), "origin_step": quoted(step), "first_failing_step": unless_empty(F.when(captured, wrong["step"]).otherwise(wrong_told["step"])),
        "error_code": unless_empty(F.when(captured, wrong["error_code"]).otherwise(F.col("_told.error_code"))), "sample_trace_id": unless_empty(trace),
    }, fields)
    there = captured | F.col("_told").isNotNull()
    last = F.when(captured, F.element_at(F.nullif("_story.path", F.array().cast("array<struct<step:string,status:string,error_code:string>>")), -1)["step"]).otherwise(
        F.element_at(F.nullif("_told.path", F.array().cast("array<struct<step:string,status:string>>")), -1)["step"]
    )
    summary = F.when(last.isNotNull(), F.concat(service, F.lit("/"), step, F.lit(" → "), last)).otherwise("")
    held = F.coalesce(F.col("_blast.sampled_traces"), F.transform(of("samples"), lambda p: p["id"]))
    traces = F.when((F.size(held) == 0) & there & (F.coalesce(trace, F.lit("")) != ""), F.array(trace)).otherwise(held)
    i = i.withColumns({"_failure": F.when(there, failure), "_summary": summary, "_trace": F.coalesce(trace, F.lit("")), "_traces": traces})
    sample = lambda t: membered("sample_traces", {"trace_id": quoted(t), "summary": quoted(F.when(t == F.col("_trace"), F.col("_summary")).otherwise(""))})

    change = F.get(of("change"), F.lit(0))
    deploy = F.coalesce(change["id"], F.lit("its last deployment"))
    downstream = F.coalesce(F.nullif(_text(i, "downstream_service"), F.lit("")), F.lit("the called service"))
    warnings = F.coalesce(F.col("warnings"), F.array().cast("array<string>")) if "warnings" in i.columns else F.array().cast("array<string>")
    families = F.coalesce(some(F.slice(jsons("families"), 1, 5)), F.lit("null"))
    confidence = F.when(F.col("confidence").isin(*CONFIDENCES), F.col("confidence")).otherwise("medium")
    rows = i.withColumns({
        "schema_version": F.lit(f'"{VERSION}"'),
        "incident_ref": membered("incident_ref", {"id": quoted(F.col("incident_id")), "window": quoted(F.lit(window))}),
        "blast_snapshot": membered("blast_snapshot", {n: number(n) for n in ("requests", "users", "services")} | {"top_error_families": families}),
        "first_failure": F.col("_failure"), "_change": F.split(change["json"], "\n"), "sample_traces": some(F.transform("_traces", sample)),
        "next_checks": listed(next_checks(F.col("cause"), F.coalesce("service", F.lit("")), downstream, deploy, warnings)), "confidence": quoted(confidence),
        "_ids": F.array_sort(F.array_distinct(F.filter(F.concat(
            F.array(F.concat(F.lit("incident:"), "incident_id"), F.when(change["id"].isNotNull(), F.concat(F.lit("deploy:"), change["id"]))),
            *[named(kind, of(part)) for part, kind in (("signals", "signal"), ("alerts", "alert"), ("runtime", "runtime"))],
            F.transform(F.filter("_traces", lambda t: t != ""), lambda t: F.concat(F.lit("trace:"), t)),
        ), lambda x: x.isNotNull()))),
        **{part: some(jsons(part)) for part in ("signals", "alerts", "runtime")},
    })
    # Texts are made once here, and not again for each of the two hashes.
    names = ["schema_version", "incident_ref", "blast_snapshot", "first_failure", "sample_traces", "signals", "alerts", "runtime", "next_checks", "confidence"]
    made = F.struct(*names, "_change", F.concat(F.lit("sha256:"), F.sha2(F.array_join("_ids", "\n"), 256)).alias("evidence_fingerprint"))
    rows = rows.select("incident_id", F.explode(F.array(made)).alias("r"))

    def text(change: Column, more: dict[str, Column]) -> Column:
        values = {n: F.col(f"r.{n}") for n in names} | {"suspect_change": change} | more
        return membered(None, values, tuple(k + "?" * optional for k, optional in ORDER.items()))

    empty = F.lit('""')
    bare = text(F.get("r._change", F.lit(0)), {"generated_at": empty, "report_hash": empty})
    rows = rows.withColumn("report_hash", F.concat(F.lit("sha256:"), F.sha2(bare, 256)))
    whole = text(F.get("r._change", F.lit(1)), {"generated_at": quoted(F.lit(generated_at)), "report_hash": quoted(F.col("report_hash")), "evidence_fingerprint": quoted(F.col("r.evidence_fingerprint"))})
    return rows.select("incident_id", whole.alias("report"), "report_hash", "r.evidence_fingerprint")
