"""DuckDB SQL for the queries of this package."""

from __future__ import annotations

#: The wide events of the benchmark's table.
W = """
WITH raw AS (SELECT event_id, ts AS ts_start, CAST(floor(value) AS BIGINT) AS duration_ms, event_type, CAST(user_id AS VARCHAR) AS user_id,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
staged AS (
  SELECT *, ts_start + to_milliseconds(duration_ms) AS ts_end, 'svc_' || (k % 5) AS service, 'prod' AS env,
    CASE WHEN event_type = 'error' THEN CASE k % 10 WHEN 0 THEN 'timeout' WHEN 1 THEN 'partial' WHEN 2 THEN 'aborted' ELSE 'error' END
         WHEN event_type = 'view' AND k % 20 = 0 THEN 'suppressed' ELSE 'ok' END AS status,
    'v' || CAST(day(ts_start) // 10 AS VARCHAR) AS version, user_id || '_' || strftime(ts_start, '%Y%m%d') AS trace_id
  FROM raw),
linked AS (
  SELECT *, status IN ('error', 'timeout', 'partial', 'aborted') AS failed,
    CAST(lag(event_id) OVER (PARTITION BY trace_id ORDER BY ts_start, event_id) AS VARCHAR) AS before
  FROM staged),
w AS (
  SELECT *, CASE WHEN failed THEN 'step_' || (k % 3) END AS step, CASE WHEN failed THEN 'E' || (k % 4) END AS error_code,
    CASE WHEN before IS NULL THEN '' WHEN k % 7 = 0 THEN 'missing' ELSE before END AS parent_span_id
  FROM linked),
sig AS (
  SELECT 'sig_' || event_id AS signal_id, ['deploy', 'runtime', 'healthcheck', 'dependency', 'config', 'alert'][k % 6 + 1] AS type, ['info',
    'warning', 'critical'][k % 3 + 1] AS severity,
    'svc_' || (k % 5) AS service, ts_start AS at_, 'E' || (k % 4) AS code
  FROM raw WHERE event_type = 'signup'),
seeds AS (
  SELECT env, service, step, error_code, strftime(ts_start, '%Y%m%d') AS day, min(ts_start) AS started_at, max(ts_start) AS now, count(*) AS events,
    count(DISTINCT user_id) AS users, count(DISTINCT trace_id) AS requests, max(version) AS version, service || '|' || step || '|' || error_code
      || '|' || strftime(ts_start, '%Y%m%d') AS incident_id,
    'svc_' || ((CAST(substr(service, 5, 1) AS INTEGER) + 1) % 5) AS downstream_service
  FROM w WHERE failed GROUP BY env, service, step, error_code, strftime(ts_start, '%Y%m%d')),
dep AS (
  SELECT 'otlp:' || service || ':' || env || ':' || version AS id, service, env, version, ts_start AS first_seen, event_id FROM (
    SELECT *, lag(version) OVER (PARTITION BY service, env ORDER BY ts_start, event_id) AS old FROM w) WHERE old IS NOT NULL AND old <> version),
depm AS (
  SELECT incident_id, id AS deploy_id, first_seen AS deploy_first_seen FROM (
    SELECT s.incident_id, d.id, d.first_seen, row_number() OVER (PARTITION BY s.incident_id ORDER BY d.first_seen DESC, d.id) AS r
    FROM seeds s JOIN dep d ON d.service = s.service AND d.version = s.version AND d.first_seen BETWEEN s.now - INTERVAL 72 HOUR AND s.now) WHERE r = 1),
dpm AS (
  SELECT incident_id, signal_id, at_ AS signal_at FROM (
    SELECT s.incident_id, g.signal_id, g.at_, row_number() OVER (PARTITION BY s.incident_id ORDER BY g.at_ DESC, g.signal_id DESC) AS r
    FROM seeds s JOIN sig g ON g.type = 'dependency' AND g.service = s.downstream_service AND g.at_ BETWEEN s.started_at AND s.now) WHERE r = 1),
rtm AS (
  SELECT s.incident_id, g.signal_id, CAST(row_number() OVER (PARTITION BY s.incident_id ORDER BY CASE g.severity WHEN 'critical' THEN 3 WHEN
    'warning' THEN 2 ELSE 1 END DESC, g.at_, g.signal_id) AS INTEGER) AS place
  FROM seeds s JOIN sig g ON g.type IN ('runtime', 'healthcheck') AND g.service = s.service AND g.at_ BETWEEN s.started_at - INTERVAL 120 MINUTE AND s.now),
times AS (
  SELECT s.*, d.signal_at AS dependency_at, p.deploy_first_seen AS deploy_at, r.incident_id IS NOT NULL AS has_runtime, s.events > 3 AS has_downstream
  FROM seeds s LEFT JOIN dpm d USING (incident_id) LEFT JOIN depm p USING (incident_id) LEFT JOIN (SELECT DISTINCT incident_id FROM rtm) r USING (incident_id)),
judged AS (
  SELECT *, CASE WHEN deploy_at IS NULL THEN 'dependency' WHEN dependency_at IS NULL THEN 'deploy'
      WHEN (dependency_at <= started_at) <> (deploy_at <= started_at) THEN CASE WHEN deploy_at <= started_at THEN 'deploy' ELSE 'dependency' END
      WHEN abs(epoch_us(deploy_at) - epoch_us(started_at)) < abs(epoch_us(dependency_at) - epoch_us(started_at)) THEN 'deploy' ELSE 'dependency' END AS winner
  FROM times),
causes AS (
  SELECT *, CASE WHEN dependency_at IS NOT NULL AND deploy_at IS NOT NULL THEN winner || '/high' WHEN dependency_at IS NOT NULL THEN
    'dependency/high' WHEN deploy_at IS NOT NULL THEN 'deploy/high'
      WHEN has_downstream THEN 'dependency/medium' WHEN has_runtime THEN 'runtime/high' WHEN events > 0 AND coalesce(step, '') <> '' THEN
        'app/medium' ELSE 'unknown/low' END AS cause
  FROM judged),
samples AS (
  SELECT service, step, error_code, string_agg(trace_id, ',' ORDER BY r) AS samples FROM (
    SELECT *, row_number() OVER (PARTITION BY service, step, error_code ORDER BY latest DESC, trace_id) AS r FROM (
      SELECT service, step, error_code, trace_id, max(ts_start) AS latest FROM w WHERE failed GROUP BY ALL)) WHERE r <= 3 GROUP BY ALL),
rollup AS (
  SELECT w.service, w.step, w.error_code, count(*) AS events, count(DISTINCT trace_id) AS traces, nullif(count(DISTINCT user_id), 0) AS users,
    any_value(s.samples) AS samples
  FROM w JOIN samples s ON s.service = w.service AND s.step = w.step AND s.error_code = w.error_code WHERE failed GROUP BY w.service, w.step, w.error_code)
"""

_SEARCH = (
    "SELECT event_id, ts_start, service, status, trace_id FROM w WHERE service = 'svc_1' AND status <> 'suppressed' AND ts_start "
    "BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'"
)
_RANKED = "SELECT *, row_number() OVER (ORDER BY ts_start DESC, event_id) AS r, count(*) OVER () AS n FROM (" + _SEARCH + ")"


def _blast(where: str) -> str:
    return W + f"""
, hit AS (SELECT DISTINCT trace_id FROM w WHERE failed AND {where}),
whole AS (SELECT w.* FROM w JOIN hit USING (trace_id)),
top AS (SELECT service, count(DISTINCT trace_id) AS n FROM whole GROUP BY service ORDER BY n DESC, service LIMIT 10)
SELECT (SELECT count(DISTINCT trace_id) FROM whole) AS requests, (SELECT nullif(count(DISTINCT user_id), 0) FROM whole) AS users, (SELECT count(DISTINCT service) FROM whole) AS services,
  (SELECT string_agg(service || ':' || n, ',' ORDER BY n DESC, service) FROM top) AS top_services"""


#: Depth-first order of the traces whose every parent is an event of theirs, with the chain of roots to each.
_TREE = """
, spans AS (SELECT trace_id, CAST(event_id AS VARCHAR) AS id, ts_start, service, status, failed, parent_span_id FROM w),
graph AS (
  SELECT c.trace_id, bool_and(c.parent_span_id = '' OR (p.id IS NOT NULL AND p.id <> c.id)) AND count(p.id) > 0 AS usable
  FROM spans c LEFT JOIN spans p ON p.trace_id = c.trace_id AND p.id = c.parent_span_id GROUP BY c.trace_id),
ids AS (SELECT s.*, g.usable, row_number() OVER (PARTITION BY s.trace_id ORDER BY ts_start, service, id) AS by_time FROM spans s JOIN graph g USING (trace_id)),
"""
_WALK = """
walk AS (
  SELECT trace_id, id, [by_time] AS path, [id] AS chain FROM ids WHERE usable AND parent_span_id = ''
  UNION ALL
  SELECT c.trace_id, c.id, list_append(p.path, c.by_time), list_append(p.chain, c.id) FROM walk p JOIN ids c ON c.trace_id = p.trace_id AND
    c.parent_span_id = p.id)
"""
_ORDER = W.replace("WITH raw", "WITH RECURSIVE raw") + _TREE + _WALK + """,
placed AS (SELECT i.*, k.path, count(k.path) OVER (PARTITION BY i.trace_id) = count(*) OVER (PARTITION BY i.trace_id) AND i.usable AS causal FROM
  ids i LEFT JOIN walk k ON k.trace_id = i.trace_id AND k.id = i.id),
ordered AS (
  SELECT trace_id, id AS event_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY CASE WHEN causal THEN path ELSE [by_time] END) AS INTEGER) AS place,
    CASE WHEN causal THEN 'causal' ELSE 'timestamp_fallback' END AS linkage
  FROM placed)
"""

#: The anchor event of each trace.
_ANCHOR = W.replace("WITH raw", "WITH RECURSIVE raw") + _TREE + _WALK + """,
above AS (SELECT trace_id, id AS descendant, unnest(chain[:-2]) AS ancestor FROM walk),
bad AS (SELECT * FROM ids WHERE failed),
leaf AS (
  SELECT b.trace_id, b.id, row_number() OVER (PARTITION BY b.trace_id ORDER BY len(k.path) DESC, b.by_time) AS r
  FROM bad b JOIN walk k ON k.trace_id = b.trace_id AND k.id = b.id
  WHERE b.usable AND NOT EXISTS (SELECT 1 FROM above a JOIN bad x ON x.trace_id = a.trace_id AND x.id = a.descendant WHERE a.trace_id = b.trace_id
    AND a.ancestor = b.id)),
early AS (SELECT trace_id, id, row_number() OVER (PARTITION BY trace_id ORDER BY by_time) AS r FROM bad),
root AS (SELECT trace_id, id, row_number() OVER (PARTITION BY trace_id ORDER BY CASE WHEN parent_span_id = '' THEN 0 ELSE 1 END, by_time) AS r
  FROM ids WHERE status <> 'suppressed'),
orphan AS (
  SELECT c.trace_id, c.id, row_number() OVER (PARTITION BY c.trace_id ORDER BY c.by_time) AS r FROM ids c LEFT JOIN ids p ON p.trace_id =
    c.trace_id AND p.id = c.parent_span_id
  WHERE c.status <> 'suppressed' AND c.parent_span_id <> '' AND (p.id IS NULL OR EXISTS (SELECT 1 FROM ids x WHERE x.trace_id = c.trace_id AND
    x.parent_span_id = 'missing' AND CAST(x.id AS BIGINT) < CAST(c.id AS BIGINT)))),
open_root AS (SELECT trace_id, id FROM root JOIN ids USING (trace_id, id) WHERE r = 1 AND parent_span_id = ''),
anchors AS (
SELECT t.trace_id, coalesce(l.id, e.id, o.id, q.id, r.id) AS event_id
FROM (SELECT DISTINCT trace_id FROM ids) t LEFT JOIN leaf l ON l.trace_id = t.trace_id AND l.r = 1 LEFT JOIN early e ON e.trace_id = t.trace_id AND e.r = 1
LEFT JOIN open_root o ON o.trace_id = t.trace_id LEFT JOIN orphan q ON q.trace_id = t.trace_id AND q.r = 1 LEFT JOIN root r ON r.trace_id =
  t.trace_id AND r.r = 1)
"""
#: Services of each trace in its order, and summaries of traces with an anchor event.
_SUMMARY = _ANCHOR + """,
placed AS (SELECT i.*, k.path, count(k.path) OVER (PARTITION BY i.trace_id) = count(*) OVER (PARTITION BY i.trace_id) AND i.usable AS causal FROM
  ids i LEFT JOIN walk k ON k.trace_id = i.trace_id AND k.id = i.id),
spot AS (SELECT trace_id, service, row_number() OVER (PARTITION BY trace_id ORDER BY CASE WHEN causal THEN path ELSE [by_time] END) AS place FROM placed),
used AS (SELECT trace_id, string_agg(service, ',' ORDER BY place) AS services FROM (SELECT trace_id, service, min(place) AS place FROM spot GROUP
  BY ALL) GROUP BY trace_id),
summary AS (
  SELECT w.trace_id, min(ts_start) AS started, max(ts_end) AS ended, CAST(floor((epoch_us(max(ts_end)) - epoch_us(min(ts_start))) / 1000) AS
    BIGINT) AS duration_ms, count(*) AS events, any_value(u.services) AS services,
    max(CASE WHEN CAST(w.event_id AS VARCHAR) = a.event_id THEN status END) AS status, max(CASE WHEN CAST(w.event_id AS VARCHAR) = a.event_id THEN
      service || ':' || step || ':' || error_code END) AS anchor
  FROM w JOIN anchors a ON a.trace_id = w.trace_id JOIN used u ON u.trace_id = w.trace_id WHERE a.event_id IS NOT NULL GROUP BY w.trace_id)
"""

#: The events with four steps and logs: what their stories are made of, rule by rule.
_STORY = """
, four AS (SELECT event_id, k, trace_id, service, status, CASE WHEN failed THEN CASE WHEN k % 11 = 0 THEN 'absent' ELSE step END END AS
  anchor_step, unnest([0, 1, 2, 3]) AS j FROM w),
steps AS (
  SELECT *, 'step_' || ((k + j) % 3) AS name, (k + 1) * (j + 1) * 7 % 50 AS start_ms, (k + j * 13) % 40 AS duration_ms, CASE WHEN (k + j) % 4 = 0
    THEN 'error' ELSE 'ok' END AS step_status,
    CASE WHEN (k + j) % 2 = 0 THEN 'svc_' || ((k + j) % 5) END AS called
  FROM four),
chosen AS (
  SELECT event_id, start_ms + duration_ms AS until FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN step_status = 'error' THEN 0 ELSE 1 END, start_ms DESC, j) AS r FROM
      steps WHERE name = anchor_step) WHERE r = 1),
path AS (SELECT s.* FROM steps s LEFT JOIN chosen c USING (event_id) WHERE status <> 'suppressed' AND (c.until IS NULL OR start_ms + duration_ms <= c.until)),
paths AS (
  SELECT event_id, string_agg(name || '@' || start_ms, ',' ORDER BY start_ms, j) AS path, min(start_ms) AS first_ms, string_agg(name || '|' ||
    called || '|/' || j, ',' ORDER BY start_ms, j) FILTER (called IS NOT NULL) AS downstream
  FROM path GROUP BY event_id),
loud AS (
  SELECT f.event_id, string_agg('m' || j || '@' || (k * 11 + j * 17) % 90, ',' ORDER BY j) AS logs
  FROM four f LEFT JOIN chosen c USING (event_id) LEFT JOIN paths p USING (event_id)
  WHERE status <> 'suppressed' AND (k + j) % 3 > 0 AND (c.until IS NULL OR (k * 11 + j * 17) % 90 BETWEEN coalesce(p.first_ms, 0) AND c.until)
    GROUP BY f.event_id),
story AS (
  SELECT w.trace_id, CAST(w.event_id AS VARCHAR) AS event_id, service, status, coalesce(path, '') AS path, coalesce(logs, '') AS logs,
    coalesce(downstream, '') AS downstream
  FROM w LEFT JOIN paths USING (event_id) LEFT JOIN loud USING (event_id))
"""

_WEEKS = """
, win AS (SELECT k AS win, TIMESTAMP '2024-01-29' - (k + 1) * INTERVAL 7 DAY AS since, TIMESTAMP '2024-01-29' - k * INTERVAL 7 DAY AS until FROM
  range(0, 4) r(k))
"""


def _lifecycle() -> str:
    """Three ticks: an active incident that isn't seen recovers; a recovering one is resolved when it was last seen two minutes ago or more; a resolved one that is seen again opens."""
    text = W + """, r AS (SELECT service || '|' || step || '|' || error_code AS incident_id, day, started_at, now AS last_seen, 'd-' || day AS suspect_deploy_id FROM seeds),
t10 AS (SELECT incident_id, 'active' AS status, started_at, last_seen, suspect_deploy_id, NULL::VARCHAR AS transition FROM r WHERE day = '20240110')"""
    for day in (11, 12, 13):
        text += f""", s{day} AS (SELECT * FROM r WHERE day = '202401{day}'),
t{day} AS (
  SELECT coalesce(o.incident_id, s.incident_id) AS incident_id,
    CASE WHEN s.incident_id IS NOT NULL THEN 'active' WHEN o.status = 'active' THEN 'recovering'
         WHEN o.status = 'recovering' AND TIMESTAMP '2024-01-{day} 23:59:59' - o.last_seen >= INTERVAL 2 MINUTE THEN 'resolved' ELSE o.status END AS status,
    coalesce(o.started_at, s.started_at) AS started_at, coalesce(s.last_seen, o.last_seen) AS last_seen, coalesce(s.suspect_deploy_id, o.suspect_deploy_id) AS suspect_deploy_id,
    CASE WHEN s.incident_id IS NOT NULL AND (o.incident_id IS NULL OR o.status = 'resolved') THEN 'opened'
         WHEN s.incident_id IS NULL AND o.status = 'recovering' AND TIMESTAMP '2024-01-{day} 23:59:59' - o.last_seen >= INTERVAL 2 MINUTE THEN 'resolved' END AS transition
  FROM t{day - 1} o FULL JOIN s{day} s ON o.incident_id = s.incident_id)"""
    return text + " SELECT * FROM t13"


#: The spans of otlp_events, with what their attributes say.
_SPANS = W + """
, span AS (
  SELECT *, substr(md5(CAST(event_id AS VARCHAR)), 1, 16) AS span_id, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 200 ELSE 503 END END AS
    answered, k % 4 = 1 AS routed, k % 7 = 0 AS threw,
    k % 7 = 0 OR k % 11 = 0 AS wrong, k % 6 AS kind
  FROM w),
outcome AS (
  SELECT *, answered IS NOT NULL OR k % 3 = 1 OR routed AS http, coalesce(answered, CASE WHEN wrong THEN 500 ELSE 200 END) AS code_, wrong OR
    coalesce(answered >= 500, false) AS bad,
    CASE WHEN routed THEN '/r' || k % 7 ELSE 'GET /' END AS step_name
  FROM span),
told AS (
  SELECT *, CASE WHEN threw THEN 'Boom' ELSE 'HTTP_' || code_ END AS error_, CASE WHEN threw THEN 'm' || k WHEN k % 22 = 0 THEN 'bad' ELSE
    'otlp span reported error' END AS reason_, kind IN (3, 4) AND k % 5 <> 0 AS calls_
  FROM outcome)
"""

#: 28 daily ticks one after another: the state of every family follows from its state at the tick before.
_STEPS = """, ticks AS (SELECT k AS no, TIMESTAMP '2024-01-03' + k * INTERVAL 1 DAY AS tick FROM range(0, 28) r(k)),
spans AS (SELECT no, tick, j AS win, tick - (j + 1) * INTERVAL 1 DAY AS since, tick - j * INTERVAL 1 DAY AS until FROM ticks, range(0, 4) r(j)),
sums AS (
  SELECT no, service, service || ':' || step || ':' || error_code AS family, count(*) FILTER (win = 0) AS n0, min(ts_start) FILTER (win = 0) AS started,
    list_sort([count(*) FILTER (win = 1), count(*) FILTER (win = 2), count(*) FILTER (win = 3)])[2] AS base
  FROM w JOIN spans ON ts_start BETWEEN since AND until WHERE failed GROUP BY no, service, step, error_code),
spike AS (SELECT no, family, service, started FROM sums WHERE n0 >= 2 AND (base = 0 OR n0 / base >= 1.5::DOUBLE)),
step AS (
  SELECT -1::BIGINT AS no, family, service, NULL::VARCHAR AS status, NULL::VARCHAR AS transition, NULL::TIMESTAMP AS started_at, NULL::TIMESTAMP AS last_seen, false AS changed
  FROM (SELECT DISTINCT family, service FROM spike)
  UNION ALL
  SELECT s.no + 1, s.family, s.service,
    CASE WHEN p.family IS NOT NULL THEN 'active' WHEN s.status = 'active' THEN 'recovering' WHEN s.status = 'recovering' AND t.tick - s.last_seen >=
      INTERVAL 60 HOUR THEN 'resolved' WHEN s.status = 'recovering' THEN 'recovering' END,
    CASE WHEN p.family IS NOT NULL AND (s.status IS NULL OR s.status = 'resolved') THEN 'opened' WHEN p.family IS NULL AND s.status = 'recovering' AND
      t.tick - s.last_seen >= INTERVAL 60 HOUR THEN 'resolved' END,
    CASE WHEN p.family IS NOT NULL AND (s.status IS NULL OR s.status = 'resolved') THEN p.started WHEN s.status = 'resolved' THEN NULL ELSE s.started_at END,
    CASE WHEN p.family IS NOT NULL THEN t.tick WHEN s.status = 'resolved' THEN NULL ELSE s.last_seen END,
    p.family IS NOT NULL OR s.status = 'active' OR (s.status = 'recovering' AND t.tick - s.last_seen >= INTERVAL 60 HOUR)
  FROM step s JOIN ticks t ON t.no = s.no + 1 LEFT JOIN spike p ON p.no = s.no + 1 AND p.family = s.family),
told AS (
  SELECT family, 'inc_' || substr(sha256('prod|' || service || '|' || family || '|' || strftime(time_bucket(INTERVAL 5 MINUTE, started_at),
    '%Y-%m-%dT%H:%M:%SZ')), 1, 16) AS incident_id, tick, status, transition, started_at, last_seen FROM step JOIN ticks USING (no) WHERE changed)
"""


ORACLES: dict[str, str] = {
    "event_search": W + ", r AS (" + _RANKED + ") SELECT event_id, ts_start, service, status, trace_id, n > 50 AS more FROM r WHERE r <= 50",
    "event_search_page2": W + ", r AS (" + _RANKED + ") SELECT event_id, ts_start, service, status, trace_id, n > 100 AS more FROM r WHERE r BETWEEN 51 AND 100",
    "status_filter": W + "SELECT event_id, ts_start, service, status, trace_id FROM w WHERE status IN ('timeout', 'suppressed')",
    "cold_event_search": W + (
        ", m AS (SELECT * FROM w WHERE service = 'svc_2' AND error_code = 'E1') SELECT event_id, trace_id, service, error_code, (SELECT "
        "count(*) FROM m) AS total FROM m ORDER BY event_id DESC LIMIT 50"
    ),
    "error_rollup": W + "SELECT * FROM rollup",
    "error_rollup_page2": W + (
        ", r AS (SELECT *, row_number() OVER (ORDER BY events DESC, service, step, error_code) AS r, count(*) OVER () AS n FROM rollup) "
        "SELECT service, step, error_code, events, traces, users, samples, n > 40 AS more FROM r WHERE r BETWEEN 21 AND 40"
    ),
    "blast_single": _blast("error_code = 'E1' AND service = 'svc_1' AND step = 'step_1' AND ts_start BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'"),
    "blast_cross": _blast("error_code = 'E1'"),
    "top_services": W + (
        ", hit AS (SELECT DISTINCT trace_id FROM w WHERE failed AND error_code = 'E2') SELECT service, count(DISTINCT trace_id) AS traces "
        "FROM w JOIN hit USING (trace_id) GROUP BY service ORDER BY traces DESC, service LIMIT 10"
    ),
    "sample_traces": W + "SELECT * FROM samples",
    "service_stats_p95": W + (
        ", r AS (SELECT service, duration_ms, row_number() OVER (PARTITION BY service ORDER BY duration_ms) AS r, count(*) OVER (PARTITION "
        "BY service) AS n FROM w) SELECT service, any_value(n) AS count, max(CASE WHEN r = (95 * n + 99) // 100 THEN duration_ms END) AS "
        "latency_ms FROM r GROUP BY service"
    ),
    "line_quantity_p95": (
        "WITH r AS (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r, count(*) OVER "
        "(PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, any_value(n) AS count, max(CASE WHEN r = (95 * n + 99) // 100 "
        "THEN l_quantity END) AS latency_ms FROM r GROUP BY l_returnflag"
    ),
    "service_index": W + "SELECT service, min(ts_end) AS first_seen, max(ts_end) AS last_seen FROM w GROUP BY service",
    "error_index": W + (
        "SELECT service, step, error_code, count(*) AS failures, min(ts_end) AS first_seen, max(ts_end) AS last_seen FROM w WHERE failed "
        "GROUP BY service, step, error_code"
    ),
    "call_edges": W + (
        "SELECT service AS from_service, 'svc_' || ((k + 1) % 5) AS to_service, '/' || event_type AS endpoint, count(*) AS calls, "
        "min(ts_end) AS first_seen, max(ts_end) AS last_seen FROM w WHERE status <> 'suppressed' GROUP BY ALL"
    ),
    "index_sizes": W + (
        "SELECT count(DISTINCT event_id) AS events, count(DISTINCT trace_id) AS traces, count(DISTINCT service) AS services, count(DISTINCT "
        "CASE WHEN failed THEN service || '|' || step || '|' || error_code END) AS errors, count(DISTINCT CASE WHEN status <> 'suppressed' "
        "THEN service || '|' || (k + 1) % 5 || '|' || event_type END) AS calls FROM w"
    ),
    "minute_counters": W + "SELECT date_trunc('minute', ts_start) AS minute, count(*) AS total, count(*) FILTER (failed) AS errors FROM w GROUP BY 1",
    "service_error_rate": W + (
        "SELECT count(*) AS requests, count(*) FILTER (failed) AS failures FROM w WHERE service = 'svc_3' AND ts_start BETWEEN TIMESTAMP "
        "'2024-01-10' AND TIMESTAMP '2024-01-20'"
    ),
    "trace_order": _ORDER + "SELECT trace_id, event_id, place, linkage FROM ordered",
    "trace_linkage": _ORDER + "SELECT linkage, count(DISTINCT trace_id) AS traces FROM ordered GROUP BY linkage",
    "trace_anchor": _ANCHOR + " SELECT trace_id, event_id FROM anchors",
    "trace_story_path": W + _STORY + "SELECT * FROM story",
    "story_by_trace": _ANCHOR + _STORY + "SELECT s.* FROM story s JOIN anchors a ON a.trace_id = s.trace_id AND a.event_id = s.event_id",
    "recent_traces": _SUMMARY + "SELECT * FROM summary WHERE trace_id IN (SELECT trace_id FROM w WHERE error_code = 'E3' AND status <> 'suppressed')",
    "recent_traces_page2": _SUMMARY + """, r AS (
  SELECT *, row_number() OVER (ORDER BY started DESC, trace_id) AS r, count(*) OVER () AS n FROM summary WHERE trace_id IN (SELECT trace_id FROM w
    WHERE service = 'svc_2' AND status <> 'suppressed' AND ts_start >= TIMESTAMP '2024-01-10'))
SELECT trace_id, started, status, anchor, n > 60 AS more FROM r WHERE r BETWEEN 31 AND 60""",
    "spike_detect": W + _WEEKS + """, c AS (SELECT service, step, error_code, count(*) FILTER (win = 0) AS n0, list_sort([count(*) FILTER (win = 1), count(*) FILTER (win = 2), count(*) FILTER (win = 3)])[2] AS baseline FROM w JOIN win ON ts_start BETWEEN since AND until WHERE failed GROUP BY ALL)
SELECT service, step, error_code, n0, baseline, round(CASE WHEN baseline > 0 THEN n0 / baseline ELSE n0::DOUBLE END, 6) AS lift FROM c WHERE n0 >= 5 AND (baseline = 0 OR n0 / baseline >= 1.2::DOUBLE)""",
    "traffic_anomaly": W + _WEEKS + """, c AS (SELECT service, count(*) FILTER (win = 0) AS n0, list_sort([count(*) FILTER (win = 1), count(*) FILTER (win = 2), count(*) FILTER (win = 3)])[2] AS baseline FROM w JOIN win ON ts_start BETWEEN since AND until GROUP BY ALL)
SELECT service, n0, baseline, CASE WHEN n0 <= 0.98::DOUBLE * baseline THEN 'drop' WHEN n0 >= 1.02::DOUBLE * baseline THEN 'surge' END AS direction FROM c WHERE baseline >= 20""",
    "latency_anomaly": W + _WEEKS + """, r AS (SELECT win, service, duration_ms, row_number() OVER (PARTITION BY win, service ORDER BY duration_ms) AS r, count(*) OVER (PARTITION BY win, service) AS n FROM w JOIN win ON ts_start BETWEEN since AND until),
p AS (SELECT win, service, any_value(n) AS n, max(CASE WHEN r = (95 * n + 99) // 100 THEN duration_ms END) AS ms FROM r GROUP BY win, service
  HAVING any_value(n) >= 20),
g AS (SELECT service, max(ms) FILTER (win = 0) AS latency_ms, list(ms ORDER BY ms) FILTER (win > 0) AS before FROM p GROUP BY service)
SELECT service, latency_ms, before[(len(before) - 1) // 2 + 1] AS baseline_ms, before[(len(before) - 1) // 2 + 1] > 0 AND latency_ms >= 1.01::DOUBLE * before[(len(before) - 1) // 2 + 1] AS anomalous FROM g WHERE latency_ms IS NOT NULL AND len(before) >= 2""",
    "incident_fold": W.replace("WITH", "WITH RECURSIVE", 1) + _STEPS + """
SELECT family, incident_id, last(status ORDER BY tick) AS status, last(started_at ORDER BY tick) AS started_at, last(last_seen ORDER BY tick) AS last_seen, count(*) FILTER (status = 'active') AS ticks,
  max(tick) FILTER (status = 'recovering') AS recovering_at, max(tick) FILTER (status = 'resolved') AS resolved_at FROM told GROUP BY family, incident_id""",
    "incident_transitions": W.replace("WITH", "WITH RECURSIVE", 1) + _STEPS + "SELECT * FROM told",
    "sustained_gate": W + """, tick AS (SELECT TIMESTAMP '2024-01-29' - k * INTERVAL 12 HOUR AS tick FROM range(0, 8) r(k)),
win AS (SELECT tick, k AS win, tick - (k + 1) * INTERVAL 3 DAY AS since, tick - k * INTERVAL 3 DAY AS until FROM tick, range(0, 4) r(k)),
c AS (SELECT tick, service, count(*) FILTER (win = 0) AS n0, list_sort([count(*) FILTER (win = 1), count(*) FILTER (win = 2), count(*) FILTER (win
  = 3)])[2] AS baseline FROM w JOIN win ON ts_start BETWEEN since AND until GROUP BY ALL),
d AS (SELECT CAST(epoch(tick) // 43200 AS INTEGER) AS tick_no, service, CASE WHEN n0 <= 0.95::DOUBLE * baseline THEN 'drop' WHEN n0 >=
  1.05::DOUBLE * baseline THEN 'surge' END AS direction FROM c WHERE baseline >= 5),
i AS (SELECT *, tick_no - row_number() OVER (PARTITION BY service, direction ORDER BY tick_no) AS island FROM d WHERE direction IS NOT NULL),
l AS (SELECT service, tick_no, direction, CAST(row_number() OVER (PARTITION BY service, direction, island ORDER BY tick_no) AS INTEGER) AS run_length FROM i)
SELECT * FROM l WHERE run_length >= 2""",
    "stable_incident_id": W + (
        "SELECT incident_id AS seed, 'inc_' || substr(sha256(env || '|' || service || '|' || service || ':' || step || ':' || error_code || "
        "'|' || strftime(time_bucket(INTERVAL 5 MINUTE, started_at), '%Y-%m-%dT%H:%M:%SZ')), 1, 16) AS incident_id FROM seeds"
    ),
    "severity_score": W + (
        "SELECT incident_id, CAST(least(10, 1 + events // 5 + users + CASE WHEN events / 2 >= 10 THEN 3 WHEN events / 2 >= 3 THEN 2 ELSE 0 "
        "END) AS INTEGER) AS severity FROM seeds"
    ),
    "incident_lifecycle": _lifecycle(),
    "deploy_detect": W + "SELECT id, service, version, first_seen FROM dep",
    "deploy_upsert": W + (
        ", u AS (SELECT service || ':' || version AS id, service, CASE WHEN k % 50 = 7 THEN 'stage' ELSE env END AS env, CASE WHEN k % 2 = 0 THEN version ELSE '' END AS version, ts_start, "
        "ts_end, event_id FROM w) SELECT id, min(service) AS service, min(env) AS env, arg_max(version, event_id) FILTER (version <> '') AS "
        "version, min(ts_start) AS first_seen, max(ts_end) AS last_seen, count(*) AS writes FROM u GROUP BY id HAVING count(DISTINCT env) = "
        "1"
    ),
    "deploy_rate_delta": W + """, d AS (SELECT DISTINCT id, service, first_seen FROM dep), c AS (
SELECT d.id, count(*) FILTER (ts_start BETWEEN first_seen - INTERVAL 600 MINUTE AND first_seen) AS n_before, count(*) FILTER (failed AND ts_start
  BETWEEN first_seen - INTERVAL 600 MINUTE AND first_seen) AS bad_before,
  count(*) FILTER (ts_start BETWEEN first_seen AND first_seen + INTERVAL 600 MINUTE) AS n_after, count(*) FILTER (failed AND ts_start BETWEEN
    first_seen AND first_seen + INTERVAL 600 MINUTE) AS bad_after
FROM d JOIN w ON w.service = d.service AND ts_start BETWEEN first_seen - INTERVAL 600 MINUTE AND first_seen + INTERVAL 600 MINUTE GROUP BY d.id)
SELECT id, n_before, bad_before, n_after, bad_after, round(CASE WHEN n_before >= 1 AND n_after >= 1 AND bad_before > 0 THEN (bad_after / n_after) / greatest(bad_before / n_before, 0.001::DOUBLE) END, 6) AS ratio FROM c""",
    "deploy_match": W + "SELECT * FROM depm",
    "dependency_match": W + "SELECT * FROM dpm",
    "runtime_match": W + "SELECT * FROM rtm",
    "alert_match": W + """, a AS (SELECT *, CASE CAST(substr(signal_id, 5) AS BIGINT) % 7 WHEN 0 THEN service || '|step_0|' || code || '|' || strftime(at_, '%Y%m%d') WHEN 1 THEN 'none' ELSE '' END AS named FROM sig WHERE type = 'alert')
SELECT s.incident_id, a.signal_id, 'incident_id' AS strategy FROM seeds s JOIN a ON a.named = s.incident_id AND a.at_ BETWEEN s.started_at -
  INTERVAL 360 MINUTE AND s.now
UNION ALL SELECT s.incident_id, a.signal_id, 'family' FROM seeds s JOIN a ON a.named = '' AND a.service = s.service AND a.code = s.error_code AND a.at_ BETWEEN s.started_at - INTERVAL 360 MINUTE AND s.now""",
    "cause_classify": W + "SELECT incident_id, cause FROM causes",
    "onset_tiebreak": W + "SELECT incident_id, winner FROM judged",
    "evidence_cap": W + """, e AS (SELECT service AS incident_id, CASE WHEN k % 9 = 0 THEN 'runtime' WHEN k % 31 = 0 THEN 'deployment' ELSE 'event' END AS kind, 't' || (k % 13) AS title, date_trunc('hour', ts_start) AS at_, user_id AS signal_id, trace_id, event_id FROM w),
u AS (SELECT *, row_number() OVER (PARTITION BY incident_id, kind, title, signal_id, trace_id ORDER BY at_, kind, title, event_id) AS c FROM e),
v AS (SELECT *, kind IN ('runtime', 'deployment') AS kept FROM u WHERE c = 1),
x AS (SELECT *, count(*) OVER (PARTITION BY incident_id) AS n, count(*) FILTER (kept) OVER (PARTITION BY incident_id) AS must, count(*) FILTER
  (NOT kept) OVER (PARTITION BY incident_id ORDER BY at_, kind, title, event_id ROWS UNBOUNDED PRECEDING) AS other FROM v)
SELECT incident_id, kind, title, signal_id, trace_id, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY at_, kind, title, event_id) AS INTEGER) AS place FROM x WHERE n <= 12 OR kept OR other <= 12 - must""",
    "impact_queue": W + (
        "SELECT incident_id, users, requests, split_part(cause, '/', 1) AS cause, split_part(cause, '/', 1) = 'unknown' OR "
        "split_part(cause, '/', 2) = 'low' OR deploy_at IS NULL AS needs_judgment FROM causes WHERE events % 5 <> 4 ORDER BY users DESC, "
        "requests DESC, incident_id LIMIT 50"
    ),
    "evidence_fingerprint": W + (
        "SELECT trace_id AS incident_id, sha256(string_agg(DISTINCT status || ':' || service, chr(10) ORDER BY status || ':' || service)) "
        "AS fingerprint FROM w GROUP BY trace_id"
    ),
    "head_sample": W + """, t AS (SELECT DISTINCT trace_id, 'sample' || trace_id AS s FROM w), h AS (SELECT trace_id, list_reduce(list_prepend(2166136261::UBIGINT, [ascii(c)::UBIGINT for c in string_split(s, '')]), lambda a, c: (xor(a, c) * 16777619::UBIGINT) % 4294967296::UBIGINT) AS h FROM t)
SELECT event_id, trace_id, status FROM w JOIN h USING (trace_id) WHERE failed OR duration_ms >= 400 OR h % 100 < 2""",
    "per_second_cap": W + (
        ", c AS (SELECT event_id, status, failed, row_number() OVER (PARTITION BY date_trunc('day', ts_start), failed ORDER BY event_id) AS "
        "r FROM w) SELECT event_id, status FROM c WHERE failed OR r <= 3"
    ),
    "dedup_first": W + "SELECT trace_id, min(event_id) AS event_id FROM w GROUP BY trace_id",
    "dedup_events": W + "SELECT event_id, CASE WHEN k % 3 = 0 THEN 'early' ELSE status END AS status FROM w",
    "family_format": W + "SELECT event_id, service || '\\:a:' || step || ':' || error_code AS family FROM w WHERE failed",
    "signal_query": W + (
        "SELECT signal_id, type, severity, at_ AS timestamp FROM sig WHERE service = 'svc_1' AND type IN ('alert', 'runtime') ORDER BY at_ "
        "DESC, signal_id DESC LIMIT 200"
    ),
    "deploy_list": W + "SELECT id, service, first_seen FROM dep WHERE first_seen BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-25'",
    "naive_rollup": W + (
        ", p AS (SELECT code, count(DISTINCT w.service) AS services FROM (SELECT DISTINCT trace_id, error_code AS code FROM w WHERE failed) "
        "h JOIN w USING (trace_id) GROUP BY code), e AS (SELECT error_code AS code, count(*) AS events FROM w WHERE failed GROUP BY 1) "
        "SELECT code, events, services, events * services AS naive FROM e JOIN p USING (code)"
    ),
    "validate_reasons": W + (
        "SELECT event_id, CASE WHEN k % 11 = 0 THEN 'invalid_json' WHEN k % 13 = 0 THEN 'bridge_not_implemented' WHEN k % 17 = 0 THEN "
        "'schema_validation_failed' END AS reason FROM w"
    ),
    "span_event_ids": W + (
        ", h AS (SELECT event_id, sha256(trace_id || ':' || event_id) AS h FROM w) SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, "
        "4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) "
        "|| '-' || substr(h, 21, 12) AS uuid FROM h"
    ),
    "alert_normalize": W + (
        "SELECT event_id, CASE k % 4 WHEN 0 THEN 'native' WHEN 1 THEN 'alertmanager' WHEN 2 THEN 'grafana' ELSE 'pagerduty' END AS "
        "provider, service, CASE k % 4 WHEN 1 THEN 'info' WHEN 2 THEN 'critical' ELSE 'warning' END AS severity, CASE k % 4 WHEN 0 THEN "
        "'why' WHEN 1 THEN 'Alert' WHEN 2 THEN 't' ELSE 'late' END AS reason, CASE WHEN k % 4 = 3 THEN 'missing_fields' END AS error FROM w "
        "WHERE failed"
    ),
    "counter_window": W + (
        "SELECT count(*) AS total, count(*) FILTER (failed) AS errors FROM w WHERE date_trunc('minute', ts_start) BETWEEN TIMESTAMP "
        "'2024-01-20' - INTERVAL 90 MINUTE AND TIMESTAMP '2024-01-20'"
    ),
    "schema_rules": W + "SELECT event_id, CASE WHEN k % 17 IN (1, 3, 4, 5, 6, 8, 9, 11, 13, 14, 15) THEN 'schema_validation_failed' END AS reason FROM w",
    "otlp_events": _SPANS + """SELECT span_id, CASE WHEN k % 13 = 0 THEN 'missing_service' WHEN NOT http THEN 'unsupported_kind' WHEN ts_start > TIMESTAMP '2024-01-25' + INTERVAL 5 MINUTE THEN 'future_timestamp' END AS drop,
  CASE WHEN bad THEN 'error' ELSE 'ok' END AS status, duration_ms, '' AS parent_span_id, CASE WHEN bad THEN error_ END AS code, CASE WHEN bad THEN
    reason_ END AS reason, step_name AS step, CASE WHEN calls_ THEN 'db' || k % 3 END AS calls,
  CASE WHEN calls_ THEN CASE WHEN routed THEN '/r' || k % 7 ELSE '' END END AS endpoint, CASE WHEN bad THEN reason_ END AS log, CAST(code_ AS
    VARCHAR) AS http_status,
  ['SPAN_KIND_UNSPECIFIED', 'SPAN_KIND_INTERNAL', 'SPAN_KIND_SERVER', 'SPAN_KIND_CLIENT', 'SPAN_KIND_PRODUCER', 'SPAN_KIND_CONSUMER'][kind + 1] AS kind FROM told""",
    "alert_to_incident": _ANCHOR + """,
inc AS (SELECT incident_id, service, error_code, env, CASE WHEN events % 3 = 0 THEN 'resolved' ELSE 'active' END AS status, events AS severity,
  started_at, now AS updated_at FROM seeds),
al AS (
  SELECT 'sig_' || event_id AS signal_id, 'svc_' || k % 5 AS service, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'test' ELSE 'prod' END AS env, CASE
    WHEN k % 17 <> 0 THEN ts_start END AS at_, CASE WHEN k % 3 = 0 THEN trace_id END AS trace_id,
    CASE k % 7 WHEN 0 THEN 'svc_' || k % 5 || '|step_' || k % 3 || '|E' || k % 4 || '|' || strftime(ts_start, '%Y%m%d') WHEN 1 THEN 'none' ELSE ''
      END AS named, CASE WHEN k % 5 <> 4 THEN 'E' || k % 4 ELSE '' END AS code
  FROM w WHERE event_type = 'signup'),
asked AS (
  SELECT al.signal_id, 2 AS way, w.service AS s, w.error_code AS c, al.env, al.at_ FROM al JOIN anchors a ON a.trace_id = al.trace_id JOIN w ON
    w.trace_id = a.trace_id AND CAST(w.event_id AS VARCHAR) = a.event_id WHERE w.error_code IS NOT NULL
  UNION ALL SELECT signal_id, 3, service, code, env, at_ FROM al WHERE code <> ''),
hits AS (
  SELECT signal_id, incident_id, 1 AS way, severity, started_at FROM al JOIN inc ON incident_id = named
  UNION ALL
  SELECT signal_id, incident_id, way, severity, started_at FROM asked JOIN inc ON inc.service = s AND inc.error_code = c AND inc.status = 'active'
    AND (asked.env = '' OR asked.env = inc.env)
    AND (at_ IS NULL OR at_ BETWEEN started_at - INTERVAL 600 MINUTE AND updated_at + INTERVAL 600 MINUTE))
SELECT signal_id, incident_id, way FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY way, severity DESC, started_at DESC, incident_id) AS r FROM hits) WHERE r = 1""",
    "alert_evidence": W + """SELECT s.incident_id, g.signal_id, CAST(row_number() OVER (PARTITION BY s.incident_id ORDER BY CASE g.severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END DESC, g.at_ DESC, g.signal_id) AS INTEGER) AS place
FROM seeds s JOIN sig g ON g.type = 'alert' AND g.service = s.service AND g.at_ BETWEEN s.started_at - INTERVAL 360 MINUTE AND s.now""",
    "deploy_fallback": W + """SELECT incident_id, signal_id, at_ AS signal_at FROM (
  SELECT s.incident_id, g.signal_id, g.at_, row_number() OVER (PARTITION BY s.incident_id ORDER BY g.at_ DESC, g.signal_id DESC) AS r FROM seeds s
    JOIN sig g ON g.type = 'deploy' AND g.service = s.service AND g.at_ BETWEEN s.now - INTERVAL 24 HOUR AND s.now
  WHERE NOT EXISTS (SELECT 1 FROM dep d WHERE d.service = s.service AND d.version = s.version AND d.first_seen BETWEEN s.now - INTERVAL 24 HOUR AND s.now)) WHERE r = 1""",
    "suspect_change": W + """, d AS (SELECT id, min(service) AS service, min(first_seen) AS first_seen, any_value(version) AS version FROM dep GROUP BY id),
c AS (SELECT d.id, count(*) FILTER (ts_start <= first_seen) AS n_before, count(*) FILTER (failed AND ts_start <= first_seen) AS bad_before, count(*) FILTER (ts_start >= first_seen) AS n_after, count(*) FILTER (failed AND ts_start >= first_seen) AS bad_after
  FROM d JOIN w ON w.service = d.service AND ts_start BETWEEN first_seen - INTERVAL 600 MINUTE AND first_seen + INTERVAL 600 MINUTE GROUP BY d.id)
SELECT s.incident_id, 'otlp:' || s.service || ':' || s.env || ':' || s.version AS suspect_deploy_id, d.version AS deploy_version, d.first_seen AS deploy_first_seen,
  coalesce(n_before, -1) AS n_before, coalesce(bad_before, -1) AS bad_before, coalesce(n_after, -1) AS n_after, coalesce(bad_after, -1) AS bad_after FROM seeds s LEFT JOIN c ON c.id = 'otlp:' || s.service || ':' || s.env || ':' || s.version LEFT JOIN d ON d.id = 'otlp:' || s.service || ':' || s.env || ':' || s.version""",
    "family_samples": W + """, n AS (
  SELECT s.incident_id, s.step AS own, w.step, w.trace_id, w.ts_start, row_number() OVER (PARTITION BY s.incident_id ORDER BY w.ts_start DESC, w.event_id) AS r
  FROM seeds s JOIN w ON w.failed AND w.service = s.service AND w.error_code = s.error_code AND w.ts_start BETWEEN s.started_at AND s.now),
m AS (SELECT * FROM n WHERE r <= 4 AND step = own),
base AS (SELECT s.incident_id, CASE WHEN s.events % 3 = 0 THEN ['kept', 'too'] ELSE (SELECT list(trace_id ORDER BY ts_start, trace_id)[1:1] FROM m
  WHERE m.incident_id = s.incident_id) END AS start FROM seeds s),
rest AS (SELECT incident_id, trace_id, max(ts_start) AS latest FROM m GROUP BY ALL),
tail AS (SELECT b.incident_id, list(trace_id ORDER BY latest DESC, trace_id) FILTER (trace_id IS NOT NULL AND NOT list_contains(coalesce(start,
  []), trace_id)) AS more FROM base b LEFT JOIN rest USING (incident_id) GROUP BY b.incident_id)
SELECT incident_id, array_to_string(list_concat(coalesce(start, []), coalesce(more, []))[1:3], ',') AS samples FROM base JOIN tail USING (incident_id)""",
    "anomaly_incidents": W + _WEEKS + """, j AS (SELECT w.*, win FROM w JOIN win ON ts_start BETWEEN since AND until),
c AS (SELECT service, count(*) FILTER (win = 0) AS n0, list_sort([count(*) FILTER (win = 1), count(*) FILTER (win = 2), count(*) FILTER (win =
  3)])[2] AS b FROM j GROUP BY ALL),
t AS (SELECT service, '<traffic>' AS step, CASE WHEN n0 <= 0.98::DOUBLE * b THEN 'TRAFFIC_DROP' ELSE 'TRAFFIC_SURGE' END AS error_code, n0 AS cur,
  b AS base FROM c WHERE b >= 20 AND (n0 <= 0.98::DOUBLE * b OR n0 >= 1.02::DOUBLE * b)),
r AS (SELECT win, service, duration_ms, row_number() OVER (PARTITION BY win, service ORDER BY duration_ms) AS r, count(*) OVER (PARTITION BY win,
  service) AS n FROM j),
p AS (SELECT win, service, any_value(n) AS n, max(CASE WHEN r = (95 * n + 99) // 100 THEN duration_ms END) AS ms FROM r GROUP BY win, service
  HAVING any_value(n) >= 20),
g AS (SELECT service, max(ms) FILTER (win = 0) AS ms, list(ms ORDER BY ms) FILTER (win > 0) AS before FROM p GROUP BY service),
l AS (SELECT service, '<latency>' AS step, 'LATENCY_SPIKE' AS error_code, ms AS cur, before[(len(before) - 1) // 2 + 1] AS base FROM g WHERE ms IS
  NOT NULL AND len(before) >= 2 AND before[(len(before) - 1) // 2 + 1] > 0 AND ms >= 1.01::DOUBLE * before[(len(before) - 1) // 2 + 1]),
u AS (SELECT * FROM t UNION ALL SELECT * FROM l),
v AS (SELECT *, service = 'svc_1' AND step = '<latency>' AS known, CASE error_code WHEN 'TRAFFIC_DROP' THEN base / greatest(cur, 1) ELSE cur /
  greatest(base, 1) END AS lift FROM u)
SELECT CASE WHEN known THEN 'open' ELSE 'inc_' || substr(sha256('prod|' || service || '|' || service || ':' || step || ':' || error_code ||
  '|2024-01-29T00:00:00Z'), 1, 16) END AS incident_id, service, step, error_code,
  CAST(least(10, 1 + greatest(cur, base) // 5 + 1 + CASE WHEN lift >= 10 THEN 3 WHEN lift >= 3 THEN 2 ELSE 0 END) AS INTEGER) AS severity, CASE WHEN known THEN TIMESTAMP '2024-01-10' ELSE TIMESTAMP '2024-01-29' END AS started_at, round(lift, 6) AS lift FROM v""",
    "rebuild_store": W + """, r AS (SELECT service || '|' || step || '|' || error_code AS incident_id, env, service, step, error_code, CASE WHEN events % 2 = 0 THEN 'resolved' ELSE 'active' END AS status, events AS severity, started_at, CASE WHEN events % 3 = 0 THEN day ELSE '' END AS suspect_deploy_id, day FROM seeds),
o AS (SELECT * FROM r WHERE day = '20240110' AND status = 'resolved'), n AS (SELECT * FROM r WHERE day = '20240111')
SELECT coalesce(o.incident_id, n.incident_id) AS incident_id, coalesce(o.env, n.env) AS env, coalesce(o.service, n.service) AS service,
  coalesce(o.step, n.step) AS step, coalesce(o.error_code, n.error_code) AS error_code,
  CASE WHEN n.incident_id IS NOT NULL THEN 'active' ELSE o.status END AS status, coalesce(n.severity, o.severity) AS severity,
    coalesce(o.started_at, n.started_at) AS started_at, coalesce(nullif(n.suspect_deploy_id, ''), o.suspect_deploy_id) AS suspect_deploy_id
FROM o FULL JOIN n ON o.incident_id = n.incident_id""",
    "report_signals": W + """SELECT * FROM (SELECT s.incident_id, g.signal_id, g.type AS signal_type, CAST(row_number() OVER (PARTITION BY s.incident_id ORDER BY g.at_ DESC, g.signal_id DESC) AS INTEGER) AS place
FROM seeds s JOIN sig g ON g.at_ BETWEEN s.now - INTERVAL 120 MINUTE AND s.now) WHERE place <= 200""",
    "newest_ids": W.replace("WITH", "WITH RECURSIVE", 1) + """, placed AS MATERIALIZED (SELECT event_id, trace_id, dense_rank() OVER (ORDER BY trace_id) AS t, row_number() OVER (ORDER BY event_id) AS place FROM w),
ids AS MATERIALIZED (SELECT list(t ORDER BY place) AS t FROM placed),
scan AS (
  SELECT 0::BIGINT AS place, false AS fresh, []::BIGINT[] AS held
  UNION ALL
  SELECT s.place + 1, NOT list_contains(s.held, ids.t[s.place + 1]), CASE WHEN list_contains(s.held, ids.t[s.place + 1]) THEN s.held ELSE list_append(s.held[-99:], ids.t[s.place + 1]) END
  FROM scan s, ids WHERE s.place < len(ids.t))
SELECT event_id, trace_id FROM scan JOIN placed USING (place) WHERE fresh""",
    "assembled_events": W + """, r AS (SELECT *, k % 17 = 0 AS supp, failed AND k % 5 <> 0 AS bad, CASE k % 13 WHEN 0 THEN 'panic' WHEN 1 THEN 'timeout' WHEN 2 THEN 'aborted' ELSE 'close' END AS ended FROM w)
SELECT CAST(event_id AS VARCHAR) AS request_id,
  CASE WHEN supp THEN 'suppressed' WHEN ended = 'panic' THEN 'error' WHEN ended = 'timeout' THEN 'timeout' WHEN bad THEN 'error' WHEN ended = 'aborted' THEN 'aborted' ELSE 'ok' END AS status,
  CASE WHEN supp THEN NULL WHEN bad THEN step WHEN ended = 'close' THEN NULL WHEN k % 6 = 0 THEN 'inner' WHEN k % 5 = 0 THEN 'step_' || (k % 3) ELSE 'request' END AS anchor_step,
  CASE WHEN supp THEN NULL WHEN bad THEN error_code WHEN ended <> 'close' THEN upper(ended) END AS anchor_code,
  CASE WHEN supp THEN -1 ELSE (k % 5 <> 0)::INTEGER + CASE WHEN ended = 'close' THEN 0 ELSE (k % 6 = 0)::INTEGER + (k % 5 = 0)::INTEGER END END AS n_steps,
  CASE WHEN supp THEN -1 ELSE (k % 4 = 0)::INTEGER END AS n_logs,
  CASE WHEN supp THEN NULL ELSE array_to_string(list_filter([CASE WHEN bad THEN error_code END, CASE WHEN ended = 'panic' THEN 'PANIC' END], lambda x: x IS NOT NULL), ',') END AS errors,
  CASE WHEN supp THEN -1 ELSE CASE WHEN k % 5 <> 0 THEN 7 + k % 30 ELSE 0 END + CASE WHEN ended = 'close' THEN 0 ELSE CASE WHEN k % 6 = 0 THEN 45 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 48 ELSE 0 END END END AS step_ms,
  50::BIGINT AS duration_ms
FROM r""",
    "report_hash": W + """, s AS (SELECT *, CASE events % 3 WHEN 0 THEN 'deploy' WHEN 1 THEN 'dependency' ELSE 'unknown' END AS cause FROM seeds),
c AS (SELECT s.incident_id, s.service, w.step, w.error_code, count(*) AS count FROM s JOIN w ON w.failed AND w.service = s.service AND w.ts_start BETWEEN s.now - INTERVAL 48 HOUR AND s.now GROUP BY ALL),
f AS (SELECT incident_id, '[' || string_agg(format('{{"service":"{}","step":"{}","error_code":"{}","count":{}}}', service, step, error_code, count), ',' ORDER BY place) || ']' AS families
  FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY count DESC, step, error_code) AS place FROM c) WHERE place <= 5 GROUP BY incident_id),
g AS (SELECT incident_id, '[' || string_agg(format('{{"id":"{0}","type":"{1}","evidence_ids":["{0}"]}}', signal_id, type), ',' ORDER BY place) || ']' AS signals, list('signal:' || signal_id) AS signal_ids
  FROM (SELECT s.incident_id, g.signal_id, g.type, row_number() OVER (PARTITION BY s.incident_id ORDER BY g.at_ DESC, g.signal_id DESC) AS place
    FROM s JOIN sig g ON g.at_ BETWEEN s.now - INTERVAL 120 MINUTE AND s.now) WHERE place <= 200 GROUP BY incident_id),
t AS (SELECT signal_id, strftime(at_, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(at_) % 1000000 = 0 THEN '' ELSE '.' || rtrim(strftime(at_, '%f'), '0') END || 'Z' AS at_text FROM sig),
r AS (SELECT m.incident_id, '[' || string_agg('{"signal_id":"' || m.signal_id || '","subtype":"","service":"' || g.service || '","source":"bench","severity":"' || g.severity || '","reason":"seen \\u003c ' || m.signal_id ||
    '","occurred_at":"' || at_text || '"}', ',' ORDER BY m.place) || ']' AS runtime, list('runtime:' || m.signal_id) AS runtime_ids
  FROM rtm m JOIN sig g USING (signal_id) JOIN t USING (signal_id) GROUP BY m.incident_id),
d AS (SELECT incident_id, deploy_id, split_part(deploy_id, ':', 2) AS deploy_service, strftime(deploy_first_seen, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(deploy_first_seen) % 1000000 = 0 THEN '' ELSE '.' || rtrim(strftime(deploy_first_seen, '%f'), '0') END || 'Z' AS deployed FROM depm),
p AS (SELECT s.incident_id, '{"schema_version":"triage.v1","incident_ref":{"id":"' || s.incident_id || '","window":"15m"},"blast_snapshot":{"requests":' || requests || ',"users":' || users || ',"services":1,"top_error_families":' || coalesce(families, 'null') || '}' ||
    CASE WHEN deploy_id IS NULL THEN '' ELSE ',"suspect_change":{"deploy_id":"' || deploy_id || '","service":"' || deploy_service || '","deployed_at":"' || deployed || '"}' END ||
    ',"sample_traces":[{"trace_id":"' || s.service || '_' || day || '","summary":""},{"trace_id":"other","summary":""}]' || coalesce(',"signals":' || signals, '') || coalesce(',"runtime":' || runtime, '') || ',"next_checks":[' ||
    CASE cause WHEN 'deploy' THEN '{"id":"deploy-diff","prompt":"Compare ' || s.service || ' before and after ' || coalesce(deploy_id, 'its last deployment') || ', and consider taking it back."}'
      WHEN 'dependency' THEN '{"id":"dependency-health","prompt":"Look at the health of ' || downstream_service || ' as ' || s.service || ' sees it."}'
      ELSE '{"id":"widen","prompt":"Widen the window around ' || s.service || '; nothing explains the failures yet."}' END ||
    CASE WHEN events % 2 = 0 THEN ',{"id":"partial_trace","prompt":"Pass the parent span on, so that traces link up."}' ELSE '' END ||
    '],"confidence":"' || CASE WHEN users > 1 THEN 'high' ELSE 'low' END || '","generated_at":"","report_hash":""}' AS body,
  list_sort(list_distinct(list_concat(['incident:' || s.incident_id, 'trace:' || s.service || '_' || day, 'trace:other'], CASE WHEN deploy_id IS NULL THEN [] ELSE ['deploy:' || deploy_id] END, coalesce(signal_ids, []), coalesce(runtime_ids, [])))) AS ids
  FROM s LEFT JOIN f USING (incident_id) LEFT JOIN g USING (incident_id) LEFT JOIN r USING (incident_id) LEFT JOIN d USING (incident_id))
SELECT incident_id, 'sha256:' || sha256(body) AS report_hash, 'sha256:' || sha256(array_to_string(ids, chr(10))) AS evidence_fingerprint FROM p""",
    "top_families": W + """, c AS (SELECT s.incident_id, w.step, w.error_code, count(*) AS count FROM seeds s JOIN w ON w.failed AND w.service = s.service AND w.ts_start BETWEEN s.now - INTERVAL 48 HOUR AND s.now GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY count DESC, step, error_code) AS INTEGER) AS place FROM c) WHERE place <= 5""",
    "retention": W + """SELECT incident_id AS id FROM seeds WHERE NOT (events % 2 = 0 AND epoch(TIMESTAMP '2024-01-20') - floor(epoch(now)) > 168 * 3600)
UNION ALL SELECT signal_id FROM sig WHERE at_ >= TIMESTAMP '2024-01-20' - INTERVAL 72 HOUR""",
    "instrumentation_warnings": W + (
        "SELECT event_id, array_to_string(list_filter([CASE WHEN k % 2 = 0 AND k % 3 <> 0 THEN 'missing_dependency_signal' END, CASE WHEN k "
        "% 4 = 0 THEN 'missing_service_version' END, CASE WHEN k % 5 = 0 THEN 'partial_trace' END], lambda x: x IS NOT NULL), ',') AS "
        "warnings FROM w"
    ),
    "top_insight": W + """SELECT incident_id, CASE users % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE users % 3 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.65::DOUBLE ELSE 0.35::DOUBLE END AS confidence_value
FROM seeds WHERE events % 7 <> 0 ORDER BY events DESC, started_at DESC, incident_id LIMIT 1""",
    "legacy_problems": W + """SELECT event_id, array_to_string(list_filter([CASE WHEN failed AND k % 3 = 0 THEN 'error' END, CASE WHEN failed AND k % 3 = 2 THEN 'error.code' END, CASE WHEN k % 17 = 0 THEN 'outcome.status_code' END, CASE WHEN k % 11 = 0 THEN 'request.http_method' END,
  CASE WHEN k % 7 = 0 THEN 'request.span_id' END, CASE WHEN k % 13 = 0 THEN 'schema_version' END, CASE WHEN k % 5 = 0 THEN 'user.id' END], lambda x: x IS NOT NULL), ',') AS problems FROM w""",
}
