"""The triage report of one incident as a dictionary: hashed the same way every time, checked and rendered. Reports of many are in reports.py."""

from __future__ import annotations

import hashlib
import json
from copy import deepcopy

VERSION, CONFIDENCES = "triage.v1", ("low", "medium", "high")
#: The report's fields in the order in which they are hashed; those marked True are left out where empty.
ORDER = {
    "schema_version": False, "incident_ref": False, "blast_snapshot": False, "first_failure": True, "suspect_change": True, "sample_traces": True, "signals": True,
    "alerts": True, "runtime": True, "next_checks": True, "confidence": False, "generated_at": False, "plan_run_id": True, "report_hash": False, "evidence_fingerprint": True,
}
INNER = {
    "incident_ref": ("id", "window"), "blast_snapshot": ("requests", "users", "services", "top_error_families"), "top_error_families": ("service", "step", "error_code", "count"),
    "suspect_change": ("deploy_id", "service", "version?", "commit_sha?", "pr_url?", "commit_author?", "deployed_at?", "error_rate_before?", "error_rate_after?"),
    "sample_traces": ("trace_id", "summary"), "signals": ("id", "type", "evidence_ids"), "alerts": ("signal_id", "alert_id?", "source", "severity", "reason", "provider_url?", "evidence_ids"),
    "runtime": ("signal_id", "subtype", "service", "source", "severity", "reason", "occurred_at"), "next_checks": ("id", "prompt"),
}


def _ordered(name: str, value):
    if isinstance(value, list):
        return [_ordered(name, v) for v in value]
    if name not in INNER or not isinstance(value, dict):
        return value
    out = {}
    for field in INNER[name]:
        key = field.rstrip("?")
        if field.endswith("?") and value.get(key) in (None, ""):
            continue
        out[key] = _ordered(key, value.get(key))
    return out


def canonical(report: dict) -> str:
    """Compact JSON in fixed order, with < > & and the two line separators escaped."""
    out = {k: _ordered(k, report.get(k, "")) for k, optional in ORDER.items() if not (optional and report.get(k) in (None, "", [], {}))}
    text = json.dumps(out, separators=(",", ":"), ensure_ascii=False)
    for c in "<>&\u2028\u2029":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def report_hash(report: dict) -> str:
    """Of all but when and by what run it was made, its own hashes and the measured error rates."""
    clean = deepcopy(report) | {"generated_at": "", "plan_run_id": "", "report_hash": "", "evidence_fingerprint": ""}
    if clean.get("suspect_change"):
        clean["suspect_change"] |= {"error_rate_before": None, "error_rate_after": None}
    return "sha256:" + hashlib.sha256(canonical(clean).encode()).hexdigest()


def fingerprint(report: dict) -> str:
    """Of the sorted distinct kind:id lines of what the report rests on."""
    ids = [("incident", report["incident_ref"]["id"]), ("deploy", (report.get("suspect_change") or {}).get("deploy_id"))]
    for name, kind, key in (
        ("signals", "signal", "id"), ("alerts", "alert", "signal_id"), ("runtime", "runtime", "signal_id"), ("sample_traces", "trace", "trace_id")
    ):
        ids += [(kind, x.get(key)) for x in report.get(name) or ()]
    return "sha256:" + hashlib.sha256("\n".join(sorted({f"{k}:{i}" for k, i in ids if i})).encode()).hexdigest()


def problems(report: dict) -> list[str]:
    found = []
    if report.get("schema_version") != VERSION:
        found.append("schema_version")
    if not (report.get("incident_ref") or {}).get("id"):
        found.append("incident_ref.id")
    if report.get("confidence") not in CONFIDENCES:
        found.append("confidence")
    return found if report.get("generated_at") else [*found, "generated_at"]


def build(incident: dict, blast: dict, families: list[dict], generated_at: str, **parts) -> dict:
    """parts: first_failure, suspect_change, sample_traces, signals, alerts, runtime, next_checks, plan_run_id."""
    report = {
        "schema_version": VERSION, "incident_ref": {"id": incident["incident_id"], "window": incident["window"]},
        "blast_snapshot": {k: blast.get(k) or 0 for k in ("requests", "users", "services")} | {"top_error_families": families[:5] or None},
        "confidence": incident["confidence"], "generated_at": generated_at
    } | {k: v for k, v in parts.items() if v}
    report["report_hash"] = report_hash(report)
    report["evidence_fingerprint"] = fingerprint(report)
    if bad := problems(report):
        raise ValueError(f"not a report: {', '.join(bad)}")
    return report


def markdown(report: dict) -> str:
    """The report for a person on call."""
    b = report["blast_snapshot"]
    lines = [
        f"# Incident {report['incident_ref']['id']}", "", f"Window {report['incident_ref']['window']}, confidence {report['confidence']}.", "",
        f"{b['requests']} requests, {b['users']} users, {b['services']} services."
    ]
    lines += [f"- {f['service']} / {f['step']} / {f['error_code']}: {f['count']}" for f in b["top_error_families"] or ()]
    if change := report.get("suspect_change"):
        lines += ["", f"Suspect change: {change['deploy_id']} of {change['service']}"]
    lines += [f"- [ ] {c['prompt']}" for c in report.get("next_checks") or ()]
    return "\n".join([*lines, "", report["report_hash"]])


def slack_blocks(report: dict) -> list[dict]:
    return [
        {"type": "header", "text": {"type": "plain_text", "text": f"Incident {report['incident_ref']['id']}"}},
        {"type": "section", "text": {"type": "mrkdwn", "text": markdown(report)}}
    ]


def pagerduty_event(report: dict, key: str) -> dict:
    b = report["blast_snapshot"]
    return {
        "routing_key": key, "event_action": "trigger", "dedup_key": report["incident_ref"]["id"],
        "payload": {
            "summary": f"{report['incident_ref']['id']}: {b['requests']} requests, {b['users']} users",
            "severity": "critical" if report["confidence"] == "high" else "warning", "source": "gritstone", "custom_details": report
        }
    }


#: What to look at next for each cause, and where none explains the failures; and for what the traces lack.
CHECKS = {
    "dependency": ("dependency-health", "Look at the health of {downstream} as {service} sees it."),
    "deploy": ("deploy-diff", "Compare {service} before and after {deploy}, and consider taking it back."),
    "runtime": ("runtime-events", "Look at restarts, memory and crashes of {service}."),
    "app": ("failing-step", "Read the failing step of {service} in a sample trace."),
}
WIDEN = ("widen", "Widen the window around {service}; nothing explains the failures yet.")
GAPS = {
    "missing_service_version": "Record the version of each service.", "missing_dependency_signal": "Send dependency signals for called services.",
    "partial_trace": "Pass the parent span on, so that traces link up."
}


def next_checks(cause: str, service: str, downstream: str | None, deploy_id: str | None, warnings: list[str]) -> list[dict]:
    """What to look at next, by cause and by what the traces lack."""
    name, text = CHECKS.get(cause, WIDEN)
    text = text.replace("{service}", service).replace("{downstream}", downstream or "the called service").replace("{deploy}", deploy_id or "its last deployment")
    return [{"id": i, "prompt": p} for i, p in [(name, text), *[(w, GAPS[w]) for w in sorted(set(warnings)) if w in GAPS]]]
