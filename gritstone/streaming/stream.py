"""The engine as Structured Streaming queries."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import detect
from ..operators.filters import failed
from ..sources.intake import parse, split


def read_events(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    """Lines of the NDJSON files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(folder)


def ingest(lines: DataFrame, out: str, refused: str, checkpoint: str, late: str = "24 hours", once: bool = True) -> list[StreamingQuery]:
    """Valid events, the first of each id within the watermark, to `out`, and refused lines to `refused`, each exactly once."""
    valid, bad = split(parse(lines))
    valid = valid.withWatermark("ts_end", late).dropDuplicatesWithinWatermark(["event_id"])
    trigger = {"availableNow": True} if once else {"processingTime": "5 seconds"}
    start = lambda df, path, name: df.writeStream.format("parquet").option(
        "checkpointLocation", f"{checkpoint}/{name}"
    ).trigger(**trigger).start(path)
    return [start(valid, out, "events"), start(bad, refused, "refused")]


def minute_counters(events: DataFrame, late: str = "24 hours") -> DataFrame:
    """Requests and failures of each minute; events without a start are in none, a null status is no failure."""
    windows = events.withWatermark("ts_start", late).groupBy(F.window("ts_start", "1 minute"))
    return windows.agg(F.count(F.lit(1)).alias("total"), F.count_if(failed()).alias("errors")).select(F.col("window.start").alias("minute"), "total", "errors")


def service_counters(events: DataFrame, late: str = "24 hours") -> DataFrame:
    """Requests and failures of each service and minute; a null service is one of its own."""
    windows = events.withWatermark("ts_start", late).groupBy(F.window("ts_start", "1 minute"), "service")
    return windows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(failed()).alias("errors")
    ).select(F.col("window.start").alias("minute"), "service", "total", "errors")


def detector(
    events: DataFrame, history: Callable[[SparkSession], DataFrame], report: Callable[[DataFrame, datetime], None], checkpoint: str,
    now: Callable[[], datetime], length: timedelta = timedelta(minutes=10), every: str = "30 seconds", once: bool = False, **thresholds
) -> StreamingQuery:
    """At each trigger, error spikes over the last four windows go to `report`. history: reads the stored events, of which the windows' bounds choose
    the files; the stream only says that there are new ones."""

    def tick(batch: DataFrame, _: int) -> None:
        at = now()
        spark = batch.sparkSession
        report(detect.error_spikes(history(spark), detect.windows([at], length), **thresholds), at)

    trigger = {"availableNow": True} if once else {"processingTime": every}
    return events.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def notify(transitions: DataFrame, send: Callable[[list[dict]], None], at_once: int = 1000) -> None:
    """Hands all opened and resolved incidents to a sender, in lists of at most so many; a list that it fails on is left out and the others still go.
    Rows come to the driver part by part."""
    part: list[dict] = []

    def hand(rows: list[dict]) -> None:
        try:
            send(rows)
        except Exception as error:  # a sender's failure is not the batch's
            warnings.warn(f"{len(rows)} transitions were not sent: {error}", stacklevel=2)

    for row in transitions.where("transition is not null").toLocalIterator():
        part.append(row.asDict())
        if len(part) == at_once:
            hand(part)
            part = []
    if part:
        hand(part)
