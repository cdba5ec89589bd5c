"""Admission by the newest ids, stored tables that are replaced as a whole, and the event log as a sink and a source."""

import json
import os
import random
import re
import time
from collections import Counter
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gritstone.operators import admission, filters, state
from gritstone.sources import intake, log
from gritstone.sources.store import Conflict, Store


def simulated(rows, capacity):
    """One event after another, with a queue of the ids that were admitted last."""
    queue, held, out = [], set(), []
    for seq, key in rows:
        if not key:
            out.append(seq)
        elif key not in held:
            out.append(seq)
            queue.append(key)
            held.add(key)
            if len(queue) > capacity:
                held.discard(queue.pop(0))
    return out


def test_newest_ids_as_simulated(spark):
    rng = random.Random(1)
    for capacity, n, ids in ((100, 4000, 400), (100, 3000, 90), (1, 300, 5), (7, 1500, 30)):
        keys = [rng.choice((None, "", "hot", "hot")) if rng.random() < 0.3 else f"e{int(rng.expovariate(1) * ids / 3)}" for _ in range(n)]
        rows = list(enumerate(keys))
        df = spark.createDataFrame(rng.sample(rows, n), "seq bigint, event_id string").withColumn("_one", F.lit("x"))
        got = [r.seq for r in admission.newest(df, capacity=capacity).orderBy("seq").collect()]
        assert got == simulated(rows, capacity), capacity
    assert admission.newest(df.limit(0)).collect() == []
    assert admission.newest(df).count() == len(simulated(rows, 65536))


def test_an_id_counts_again_after_enough_others(spark):
    rows = list(enumerate(["a", "b", "a", "c", "d", "a", "a"]))
    df = spark.createDataFrame(rows, "seq bigint, event_id string")
    assert [r.seq for r in admission.newest(df, capacity=3).orderBy("seq").collect()] == [0, 1, 3, 4, 5]  # a refused one doesn't renew an id


def test_first_of_each_id_but_nameless_ones_all_stay(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "a"), (5, None), (6, "")], "seq bigint, event_id string")
    assert sorted(r.seq for r in filters.dedup_first(df).collect()) == [1, 2, 3, 5, 6]


STORE = "incident_id string, env string, service string, step string, error_code string, status string, started_at bigint, suspect_deploy_id string"


def incident(k, status="active", started=0):
    return (f"i{k}", "prod", "s", "st", "E", status, started, "")


def test_store_is_replaced_as_a_whole(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/incidents")
    assert store.read() is None and store.versions() == []
    first = spark.createDataFrame([incident(1), incident(2, "resolved")], STORE)
    assert store.write(first) == 1
    pinned = store.read()
    fresh = spark.createDataFrame([incident(3), incident(2, "active", 5)], STORE)
    assert store.replace(lambda old: state.replace_unresolved(old, fresh)) == 2  # reads itself
    assert {(r.incident_id, r.status, r.started_at) for r in store.read().collect()} == {("i2", "active", 0), ("i3", "active", 0)}
    assert {r.incident_id for r in pinned.collect()} == {"i1", "i2"} == {r.incident_id for r in store.read(1).collect()}
    assert store.read(9) is None
    with pytest.raises(Conflict):
        store.write(first, based_on=1)
    assert store.versions() == [1, 2] and store.read().count() == 2
    empty = first.limit(0)
    assert store.write(empty) == 3 and store.read().count() == 0 and store.read().columns == first.columns


def test_killed_between_write_and_publish(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/incidents")
    rows = spark.createDataFrame([incident(k) for k in range(50)], STORE)
    store.write(rows)

    def die(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(Store, "_publish", die)
    with pytest.raises(KeyboardInterrupt):
        store.write(rows.limit(1))
    monkeypatch.undo()
    again = Store(spark, f"file://{tmp_path}/incidents")
    assert again.read().count() == 50 and len(again._names("versions")) == 2
    assert len(again.vacuum(1)) == 1 and again.read().count() == 50 and len(again._names("versions")) == 1
    assert again.write(rows.limit(3)) == 2 and again.read().count() == 3
    # one that dies within publishing leaves a draft, which no reader takes for a version
    (tmp_path / "incidents" / "_published" / "_draft").write_text("{")
    assert again.read().count() == 3 and again.versions() == [1, 2]


def test_a_writer_that_loses_makes_it_anew(spark, tmp_path):
    store, calls = Store(spark, f"file://{tmp_path}/n"), []

    def add_one(old):
        calls.append(1)
        if len(calls) == 1:
            Store(spark, store.folder).write(spark.range(5))  # another one comes first
        return spark.range((old.count() if old is not None else 0) + 1)

    store.write(spark.range(1))
    assert store.replace(add_one) == 3 and store.read().count() == 6 and len(calls) == 2


# the event log


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_log_is_written_in_files_and_read_back(spark, tmp_path):
    spark.dataSource.register(log.EventLog)
    folder = f"{tmp_path}/log"
    rows = [json.dumps({"k": k, "text": "é" * (k % 50)}) for k in range(500)]
    lines(spark, rows).repartition(3).write.format("event_log").option("max_bytes", 4000).mode("append").save(folder)
    names = sorted(p.name for p in (tmp_path / "log").iterdir())
    assert len(names) > 6 and all(re.fullmatch(r"events-\d{8}-\d{6}(-\d+)?\.jsonl", n) for n in names)
    assert all(p.stat().st_size < 4400 for p in (tmp_path / "log").iterdir())
    assert sorted(r.value for r in intake.read_log(spark, folder).collect()) == sorted(rows)
    got = spark.read.format("event_log").load(folder)
    assert sorted(r.value for r in got.collect()) == sorted(rows) and got.where("line_no = 1").count() == len(names)
    intake.append_log(spark.createDataFrame([(1, "x")], "a int, b string"), folder)
    assert '{"a":1,"b":"x"}' in [r.value for r in intake.read_log(spark, folder).collect()]
    assert lines(spark, rows).limit(0).write.format("event_log").mode("append").save(folder) is None


def test_a_task_that_is_tried_again_leaves_no_line_twice(spark, tmp_path):
    writer = log.BatchWriter({"path": f"{tmp_path}/log", "max_bytes": "10"})
    batch = pa.RecordBatch.from_pydict({"value": ["first line", "second line", None]})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))  # the first try's message never came
    writer.commit([kept, None])
    assert sorted(r.value for r in spark.read.format("event_log").load(f"{tmp_path}/log").collect()) == ["first line", "second line"]
    writer.abort([lost])
    assert len(list((tmp_path / "log").iterdir())) == 2 == len(kept.drafts)


def place(folder, name, rows, age):
    (folder / name).write_text("".join(r + "\n" for r in rows))
    at = 1_700_000_000 - age
    os.utime(folder / name, (at, at))


def test_stream_reads_what_the_batch_reads(spark, tmp_path):
    """Files that come out of order, within the slack, and a restart after each run."""
    spark.dataSource.register(log.EventLog)
    folder = tmp_path / "log"
    folder.mkdir()
    arrivals = [[("events-b.jsonl", 100), ("events-a.jsonl", 250)], [("events-d.jsonl", 0)], [("events-c.jsonl", 60), ("other.jsonl", 5)], [("events-e.jsonl", 0)], []]  # an availableNow run is a batch, here of a file
    for k, files in enumerate(arrivals):
        for name, age in files:
            place(folder, name, [f"{name}-{j}" for j in range(3)] + (["x" * (2 << 20)] if k == 0 else []), age)
        stream = spark.readStream.format("event_log").option("max_files", 1).option("slack_seconds", 300).load(str(folder))
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, spark.read.format("event_log").load(str(folder)).collect())) and len(got) == 15
    since = datetime.fromtimestamp(1_700_000_000, timezone.utc).isoformat()
    recent = spark.read.format("event_log").option("since", since).option("slack_seconds", 90).load(str(folder))
    assert {r.file_name for r in recent.collect()} == {"events-c.jsonl", "events-d.jsonl", "events-e.jsonl"}
    now = datetime.fromtimestamp(1_700_000_000, timezone.utc) + timedelta(hours=1)
    assert log.expired(str(folder), now, hours=1) == ["events-a.jsonl", "events-b.jsonl", "events-c.jsonl"]
    assert log.expired(str(folder), now, most_bytes=1) == ["events-d.jsonl"] and (folder / "events-e.jsonl").exists()


def test_stream_to_the_log(spark, tmp_path):
    """A batch that is run again after it was published leaves nothing twice."""
    spark.dataSource.register(log.EventLog)
    source, out = tmp_path / "in", tmp_path / "log"
    source.mkdir()
    (source / "a.txt").write_text("one\ntwo\n")
    run = lambda: spark.readStream.text(str(source)).writeStream.format("event_log").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(str(out)).awaitTermination(120)
    run()
    for p in (tmp_path / "check" / "commits").iterdir():  # as if the driver had died before it noted the batch
        p.unlink()
    run()
    (source / "b.txt").write_text("three\n")
    run()
    assert sorted(r.value for r in intake.read_log(spark, str(out)).collect()) == ["one", "three", "two"]


def test_counts_are_observed_while_data_flows(spark, tmp_path):
    """As envelope() counts them, in one pass; and in a stream, by a listener."""
    valid = {
        "schema_version": "2.0", "event_id": "e0", "ts_start": "2024-01-01T00:00:00Z", "ts_end": "2024-01-01T00:00:01Z", "kind": "http", "service": "s", "env": "prod", "trace_id": "a" * 32,
        "status": "ok"
    }
    rng = random.Random(3)
    texts = [rng.choice(("{", json.dumps(valid | {"schema_version": "1.1"}), json.dumps(valid | {"kind": "x"}), json.dumps(valid | {"event_id": f"e{rng.randrange(40)}"}))) for _ in range(300)]
    parsed = intake.parse(spark.createDataFrame([("b", k, t) for k, t in enumerate(texts)], "batch string, line int, value string"))
    seen = Observation("seen")
    events = intake.admitted(parsed, counts=seen).collect()
    want = intake.envelope(parsed).first()
    refused = Counter(r.reason for r in want.rejected)
    assert seen.get == {"accepted": want.accepted, "duplicate": want.duplicate} | {r: refused[r] for r in intake.REASONS}
    assert len(events) == want.accepted == len({e.event_id for e in events}) and want.duplicate > 30

    (tmp_path / "in").mkdir()
    listener = intake.Counts()
    spark.streams.addListener(listener)
    try:
        for k in (0, 1):
            (tmp_path / "in" / f"{k}.txt").write_text("\n".join(texts[150 * k : 150 * k + 150]))
            stream = intake.admitted(intake.parse(spark.readStream.text(str(tmp_path / "in"))), counts="flow")
            stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
        for _ in range(50):
            if sum(listener.total.get("flow", Counter()).values()) >= 300:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert {r: listener.total["flow"][r] for r in intake.REASONS} == {r: refused[r] for r in intake.REASONS}
    assert listener.total["flow"]["accepted"] == want.accepted + want.duplicate == spark.read.parquet(f"{tmp_path}/out").count()
