"""Events assembled from records, against a plain reading of the rules."""

import random

from gritstone.operators import assembly

NAMES = [f.split()[0] for f in assembly.RECORD.split(", ")]


def record(request, seq, kind, at=0, **more):
    return tuple(({"request_id": request, "seq": seq, "kind": kind, "at_ms": at} | more).get(n) for n in NAMES)


def plain(rows):
    """Record after record, with a stack of running steps."""
    out = {}
    for request in dict.fromkeys(r[0] for r in rows if r[0]):
        own = sorted((dict(zip(NAMES, r, strict=True)) for r in rows if r[0] == request), key=lambda r: r["seq"])
        opened = end = anchor = None
        steps, running, logs, errors, fields, suppressed, at = [], {}, [], {}, {}, False, 0
        begin = next((r["at_ms"] for r in own if r["kind"] == "open"), None)
        names = {}
        for r in own:
            at, kind = r["at_ms"], r["kind"]
            if kind == "open":
                opened = opened or r
            elif kind == "step":
                names.setdefault(r["span_id"], r)
                running.setdefault(r["span_id"], r)
            elif kind == "step_end":
                first = next((x for x in own if x["kind"] == "step" and x["span_id"] == r["span_id"]), None)
                running[r["span_id"]] = None
                start = first["at_ms"] if first else at
                steps.append((r["name"] or first["name"], r["span_id"], start - begin if begin is not None else 0, max(0, at - start), r["status"], r["code"] if r["status"] == "error" else None))
                if r["status"] == "error":
                    anchor = anchor or (steps[-1][0], r["code"])
                    errors.setdefault(r["code"], r["reason"])
            elif kind == "log":
                logs.append((at - begin if begin is not None else 0, r["name"], r["value"]))
            elif kind == "field":
                fields[r["name"]] = r["value"]
            elif kind == "error":
                errors.setdefault(r["code"], r["reason"])
            elif kind == "suppress":
                suppressed = True
            elif kind in assembly.ENDS:
                end = kind
                break
        if opened is None:
            continue
        active = [r for r in running.values() if r]
        status = "error" if anchor else "ok"
        if end in ("panic", "timeout", "aborted"):
            status = {"panic": "error", "timeout": "timeout", "aborted": status if anchor else "aborted"}[end]
            anchor = anchor or (active[-1]["name"] if active else "request", "X_" + end.upper())
            steps += [(r["name"], r["span_id"], r["at_ms"] - begin, max(0, at - r["at_ms"]), "ok", None) for r in active]
            if end == "panic":
                errors.setdefault("X_PANIC", "runtime panic recovered")
        out[request] = ("suppressed", None, None, None, None, fields) if suppressed else (status, anchor, steps, logs, list(errors.items()), fields)
    return out


def test_requests_as_by_the_rules(spark):
    rng, rows = random.Random(4), []
    for k in range(150):
        request, seq, at, spans = f"r{k}", 0, 1000 * k, []
        def add(kind, **more):
            nonlocal seq, at
            seq, at = seq + 1, at + rng.randrange(0, 9)
            rows.append(record(request, seq, kind, at, **more))  # noqa: B023
        if k % 20:
            add("open", service="s", env="prod", trace_id=f"t{k}", parent_span_id="")
        for j in range(rng.randrange(0, 9)):
            what = rng.choice(("step", "step", "end", "log", "field", "error", "suppress" if k % 9 == 0 else "step"))
            if what == "step":
                spans.append(f"x{j}")
                add("step", name=f"n{j}", span_id=spans[-1])
            elif what == "end" and spans:
                bad = rng.random() < 0.4
                add("step_end", span_id=spans.pop(), status="error" if bad else "ok", code=f"E{rng.randrange(3)}" if bad else None, reason=f"why{j}")
            elif what == "log":
                add("log", name="warn", value=f"m{j}")
            elif what == "field":
                add("field", name=f"f{rng.randrange(2)}", value=str(j))
            elif what == "error":
                add("error", code=f"E{rng.randrange(4)}", reason=f"seen{j}")
            elif what == "suppress":
                add("suppress")
        if k % 7:
            add(rng.choice(tuple(assembly.ENDS)))
            add(rng.choice(("log", "panic")), name="late", value="late")
    rows.append(record(None, 1, "open", 0))
    want = plain(rows)
    shuffled = rng.sample(rows, len(rows))
    got = assembly.assemble(spark.createDataFrame(shuffled, assembly.RECORD).repartition(3), "X_").collect()
    pairs = lambda x: None if x is None else [tuple(y) for y in x]
    assert {r.request_id: (r.status, r.anchor and tuple(r.anchor), pairs(r.steps), pairs(r.logs), pairs(r.errors), r.fields) for r in got} == want
    assert {w[0] for w in want.values()} == {"ok", "error", "timeout", "aborted", "suppressed"}
    assert all(r.duration_ms == r.ts_end_ms - r.ts_start_ms >= 0 for r in got)
    assert assembly.assemble(spark.createDataFrame([], assembly.RECORD)).collect() == []
