"""Event intake: NDJSON to valid events and refused ones, the event log, and replay."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.filters import dedup_first
from ..operators.validation import EVENT as FIELDS
from ..operators.validation import fields, reject_reason
from ..schema import EVENT
from .log import MOST_FILE, EventLog

#: Lines of a batch, and bytes of a line or body, that are taken.
MOST_LINES, MOST_BYTES = 256, 1 << 20


def parse(lines: DataFrame) -> DataFrame:
    """value and event (parsed; null where malformed) and reason (null where valid) of each line that is not blank."""
    names = [c for c in lines.columns if c not in ("event", "reason")]
    # In brackets, since what follows a whole value is passed over. A row for a row, twice: what is parsed here isn't parsed again for every rule.
    listed = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))).alias("list")
    rows = lines.where(F.trim("value") != "").select(*names, F.inline(F.array(F.struct(listed))))
    item = lambda k: F.try_variant_get("list", f"$[{k}]", "variant")
    one = item(0).isNotNull() & item(1).isNull()
    made = F.struct(F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("event"), one.alias("fine"), fields(item(0), FIELDS).alias("own"))
    rows = rows.select(*names, F.inline(F.array(made)))
    return rows.select(*names, "event", reject_reason(F.col("fine"), F.col("own"), F.col("event")).alias("reason"))


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events as columns, and the refused lines with their reasons."""
    keep = [c for c in parsed.columns if c not in ("value", "event", "reason")]
    return parsed.where("reason is null").select(*keep, "event.*"), parsed.where("reason is not null").drop("event")


def envelope(parsed: DataFrame, known_ids: DataFrame | None = None) -> DataFrame:
    """One row for each batch (column `batch`, lines numbered by `line`): accepted, duplicate, rejected (line and reason)."""
    rows = parsed.withColumn("event_id", F.when(F.col("reason").isNull(), F.col("event.event_id")))
    first = dedup_first(rows.where("event_id is not null"), "event_id", "line").select("batch", "line", F.lit(True).alias("first"))
    rows = rows.join(first, ["batch", "line"], "left")
    if known_ids is not None:
        rows = rows.join(known_ids.select("event_id", F.lit(True).alias("known")), "event_id", "left")
    else:
        rows = rows.withColumn("known", F.lit(False))
    fresh = F.coalesce("first", F.lit(False)) & ~F.coalesce("known", F.lit(False))
    rejected = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("line", "reason"))))
    return rows.groupBy("batch").agg(
        F.count_if(fresh).alias("accepted"), F.count_if(F.col("event_id").isNotNull() & ~fresh).alias("duplicate"), rejected.alias("rejected")
    )


#: Why a line is refused.
REASONS = ("invalid_json", "bridge_not_implemented", "schema_validation_failed")


def _tallies() -> list:
    verdict = lambda what: F.count_if(F.col("_verdict") == what)
    return [verdict("").alias("accepted"), verdict("duplicate").alias("duplicate"), *[verdict(r).alias(r) for r in REASONS]]


def admitted(parsed: DataFrame, order: str = "line", counts: Observation | str = "intake") -> DataFrame:
    """The events of parse() that are valid and the first of their id (by `order`), and, as they flow by, how many lines were accepted, duplicate, or
    refused for each reason: no second pass. counts: an Observation, for batches, whose get is there once something has run; or the name of the metrics,
    which Counts reads of a stream (there the watermark's dropDuplicates takes duplicates away before, so that none are counted)."""
    rows = parsed.withColumn("_id", F.when(F.col("reason").isNull(), F.col("event.event_id")))
    if not parsed.isStreaming:
        place = F.row_number().over(Window.partitionBy("_id", F.when(F.col("_id").isNull(), F.col(order))).orderBy(order))
        again = (place > 1) & F.col("_id").isNotNull()
    else:
        again = F.lit(False)
    rows = rows.withColumn("_verdict", F.when(F.col("reason").isNotNull(), F.col("reason")).when(again, "duplicate").otherwise(""))
    keep = [c for c in parsed.columns if c not in ("value", "event", "reason")]
    return rows.observe(counts, *_tallies()).where("_verdict = ''").select(*keep, "event.*")


class Counts(StreamingQueryListener):
    """Sums of the tallies of all batches of a stream, by name: total[name]["accepted"] and so on."""

    def __init__(self) -> None:
        self.total: dict[str, Counter] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.total.setdefault(name, Counter()).update(row.asDict())

    def onQueryTerminated(self, event) -> None:
        pass


def oversized(lines: DataFrame) -> DataFrame:
    """Batches with too many lines or too long a body: they are refused as a whole."""
    sizes = lines.where(F.trim("value") != "").groupBy("batch").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value")).alias("bytes"))
    return sizes.where((F.col("lines") > MOST_LINES) | (F.col("bytes") > MOST_BYTES))


def read_log(spark: SparkSession, folder: str, since: datetime | None = None, slack: timedelta = timedelta(minutes=5)) -> DataFrame:
    """Lines of the event log's files events-*.jsonl, without those last written more than the slack before `since` and without lines of over a MiB;
    replay() orders them by file and line_id."""
    reader = spark.read.option("pathGlobFilter", "events-*.jsonl")
    reader = reader.option("modifiedAfter", (since - slack).strftime("%Y-%m-%dT%H:%M:%S")) if since else reader
    rows = reader.text(folder).select("value", "_metadata.file_modification_time", "_metadata.file_name")
    return rows.where(F.octet_length("value") <= MOST_BYTES).withColumn("line_id", F.monotonically_increasing_id())


def replay(lines: DataFrame, since) -> tuple[DataFrame, DataFrame]:
    """The log's events that ended since then, the first of each id; and the skipped lines by reason: malformed_json, schema_invalid, stale."""
    rows = parse(lines)
    reason = F.when(
        F.col("reason") == "invalid_json", "malformed_json"
    ).when(F.col("reason").isNotNull(), "schema_invalid").when(F.col("event.ts_end") < since, "stale")
    rows = rows.withColumn("skip", reason)
    events = rows.where("skip is null").select("event.*", F.struct("file_modification_time", "file_name", "line_id").alias("seq"))
    return dedup_first(events), rows.where("skip is not null").groupBy("skip").agg(F.count(F.lit(1)).alias("lines"))


def append_log(events: DataFrame, folder: str, max_bytes: int = MOST_FILE) -> None:
    """Adds events to the log as JSON lines, in files of about max_bytes each that read_log() finds once all of them are written."""
    events.sparkSession.dataSource.register(EventLog)
    lines = events.select(F.to_json(F.struct("*")).alias("value"))
    lines.write.format("event_log").option("max_bytes", max_bytes).mode("append").save(folder)


def legacy_entries(lines: DataFrame, schema) -> DataFrame:
    """Version 1 log lines: entries with logged_at and event, or bare events, logged when they happened."""
    entry = F.from_json("value", f"logged_at timestamp, event {schema.simpleString()}")
    rows = lines.withColumn("entry", entry).withColumn("bare", F.from_json("value", schema))
    event = F.when(F.col("entry.event").isNotNull(), F.col("entry.event")).otherwise(F.col("bare"))
    return rows.select(
        event.alias("event"), F.coalesce("entry.logged_at", event.getField("timestamp").cast("timestamp")).alias("logged_at")
    ).where("event is not null")
