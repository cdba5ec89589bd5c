"""Alert payloads of several providers as alert signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_text, severity_of
from ..schema import SEVERITIES, SIGNAL_TYPES


def normalize(payloads: DataFrame, now, own_name: str = "engine") -> DataFrame:
    """payloads: body (JSON text). Adds provider, the signal's columns, and error: invalid_json, unsupported_alert, missing_fields or null.

    own_name: what the native form calls its source where it names none. A source of another name is the native form; then a Grafana body, known by
    its rule ids, organisation or links; the native form again; Alertmanager's list with a receiver or
    common labels; PagerDuty's messages or event. Each field is the first of its places that is not blank.
    """
    at = lambda path: F.get_json_object("body", path)
    has = lambda *names: F.coalesce(F.array_max(F.array(*[at(f"$.{n}").isNotNull() for n in names])), F.lit(False))
    label, note, alert = (lambda n: at(f"$.alerts[0].labels.{n}")), (lambda n: at(f"$.alerts[0].annotations.{n}")), (lambda n: at(f"$.alerts[0].{n}"))
    data = lambda n: F.coalesce(at(f"$.messages[0].event.data.{n}"), at(f"$.incident.{n}"))
    own_source = first_text(at("$.source"))
    folder = has(
        "orgId", "orgID", "alerts[0].dashboardURL", "alerts[0].panelURL", "alerts[0].ruleURL", "alerts[0].labels.grafana_folder",
        "alerts[0].annotations.__dashboardUid__", "alerts[0].annotations.__panelId__"
    )
    provider = (
        F.when((own_source != "") & (own_source != own_name), "native")
        .when(has("ruleId", "ruleUID", "evalMatches") | folder, "grafana")
        .when(has("source", "alert_id"), "native")
        .when(has("alerts") & has("receiver", "commonLabels"), "alertmanager")
        .when(has("messages", "event"), "pagerduty")
    )

    def pick(native: Column, manager: Column, grafana: Column, duty: Column) -> Column:
        p = F.col("provider")
        return F.when(p == "native", native).when(p == "alertmanager", manager).when(p == "grafana", grafana).when(p == "pagerduty", duty)

    blank = F.lit("")
    rows = payloads.withColumn("provider", provider)
    rows = rows.withColumns({
        "source": pick(F.when(own_source == "", own_name).otherwise(own_source), F.lit("alertmanager"), F.lit("grafana"), F.lit("pagerduty")),
        "service": pick(first_text(at("$.service")), first_text(label("service")), first_text(label("service"), at("$.service")), first_text(F.when(~F.coalesce(data("service"), blank).startswith("{"), data("service")), data("service.summary"))),
        "env": pick(first_text(at("$.env")), first_text(label("env")), first_text(label("env"), at("$.env")), first_text(data("env"))),
        "severity": severity_of(pick(at("$.severity"), label("severity"), first_text(label("severity"), at("$.state")), first_text(data("urgency"), data("severity")))),
        "reason": pick(first_text(at("$.reason")), first_text(note("summary"), note("description"), label("alertname")), first_text(note("summary"), at("$.title"), at("$.ruleName"), label("alertname")), first_text(data("title"), data("summary"), at("$.messages[0].event.event_type"))),
        "alert_id": pick(first_text(at("$.alert_id")), first_text(alert("fingerprint"), alert("alertname"), label("fingerprint"), label("alertname")), first_text(at("$.ruleUID"), at("$.ruleId"), label("alertname")), first_text(data("id"), at("$.messages[0].event.id"))),
        "error_code": pick(first_text(at("$.error_code")), first_text(label("error_code")), first_text(label("error_code"), at("$.error_code")), first_text(data("error_code"))),
        "incident_id": pick(first_text(at("$.incident_id")), blank, blank, first_text(data("incident_id"))),
        "timestamp": F.coalesce(F.try_to_timestamp(pick(at("$.timestamp"), alert("startsAt"), F.coalesce(alert("startsAt"), at("$.startsAt")), data("created_at"))), F.lit(now).cast("timestamp")),
    })
    error = (
        F.when(at("$").isNull() | ~F.col("body").rlike(r"^\s*\{"), "invalid_json")
        .when(F.col("provider").isNull(), "unsupported_alert")
        .when((F.col("service") == "") | (F.col("env") == "") | (F.col("reason") == ""), "missing_fields")
    )
    return rows.withColumn("type", F.lit("alert")).withColumn("error", error)


def signal_error(now) -> Column:
    """Why a signal is refused, or null: a required field is blank, an enumeration does not know the value, or it lies over five minutes ahead."""
    blank = F.lit(False)
    for name in ("type", "source", "service", "env", "severity", "reason"):
        blank = blank | (F.coalesce(F.col(name), F.lit("")) == "")
    late = F.unix_micros(F.col("timestamp").cast("timestamp")) > F.unix_micros(F.lit(now).cast("timestamp")) + 5 * 60 * 1_000_000
    return F.when(blank | F.col("timestamp").isNull(), "missing_field").when(
        ~F.col("type").isin(*SIGNAL_TYPES) | ~F.col("severity").isin(*SEVERITIES), "invalid_enum"
    ).when(late, "future_timestamp")
