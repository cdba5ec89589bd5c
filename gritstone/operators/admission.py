"""Admission of events by the newest ids: exact, with a bounded memory of what was admitted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut

#: Ids that are remembered. A fixed value.
CAPACITY = 65_536


def _before(rows: DataFrame, count: str, to: str) -> DataFrame:
    """rows with `to`: the sum of `count` over all rows before (by _part, then _place). Parts are ranges of rows; only a row a part meets in one
    place."""
    sums = rows.groupBy("_part").agg(F.sum(count).alias("_sum"))
    up_to = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(up_to), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    return rows.join(F.broadcast(sums), "_part").withColumn(to, F.col("_offset") + F.col("_inside")).drop("_offset", "_inside")  # a row a part


def _decided(rows: DataFrame, capacity: int) -> DataFrame:
    """_id, _part, _place, _again of each row of (_id, _part, _place, _number): whether it is refused, if _number others were admitted before it.

    An id's rows follow each other in their task and are looked at one by one, with one number carried along; none are gathered.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = at = None
        for batch in batches:
            again = np.zeros(len(batch), bool)
            for k, (key, number) in enumerate(zip(batch.column("_id").to_pylist(), batch.column("_number").to_pylist(), strict=True)):
                if key == own and number - at <= capacity:
                    again[k] = True
                else:
                    own, at = key, number
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_part", "_place")), pa.array(again)], ["_id", "_part", "_place", "_again"])

    kinds = dict(rows.dtypes)
    dealt = rows.select("_id", "_part", "_place", "_number").repartition("_id").sortWithinPartitions("_id", "_part", "_place")
    return dealt.mapInArrow(scan, f"_id {kinds['_id']}, _part int, _place bigint, _again boolean")


def newest(events: DataFrame, key: str = "event_id", order: str | list[str] = "seq", capacity: int = CAPACITY) -> DataFrame:
    """The events that are admitted one after another, in that order, where an id is refused while it is among the last `capacity` ids admitted; a
    refused one counts for nothing. A null or empty key is always admitted and never remembered. Rows whose order is the same come in any order.

    Which rows are refused depends on how many were admitted before, so the numbers are found by rounds: each one takes the refusals of the round
    before as given. A row's verdict follows from the rows before it alone, so a round that changes nothing has found the one answer, and each
    round that does makes at least one more row right, from the start on; few are needed. Rounds look only at rows of ids that come more than once. A
    hot id's rows are one stream through one task, of two numbers each.
    """
    order = [order] if isinstance(order, str) else order
    rows = events.select(F.struct("*").alias("_row"), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(order)], F.col(key).alias("_id"))
    by = [f"_by{k}" for k in range(len(order))]
    rows = rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*by)).cast("bigint")).drop(*by)
    rows = cut(rows.withColumn("_id", F.when(F.coalesce(F.col("_id").cast("string"), F.lit("")) != "", F.col("_id"))))
    rows = rows.withColumn("_one", F.col("_id").isNotNull().cast("bigint"))
    twice = rows.where("_id is not null").groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id")
    known = cut(_before(rows.select("_id", "_part", "_place", "_one"), "_one", "_rank").join(twice, "_id").select("_id", "_part", "_place", "_rank"))
    marked, before = known.withColumn("_again", F.lit(False)), None
    while True:
        counted = _before(marked.withColumn("_refused", F.col("_again").cast("bigint")), "_refused", "_gone")
        verdicts = _decided(counted.withColumn("_number", F.col("_rank") - F.col("_gone")), capacity)
        marked = cut(known.join(verdicts, ["_id", "_part", "_place"]))
        now = tuple(marked.where("_again").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("_part", "_place").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            break
        before = now
    refused = marked.where("_again").select("_part", "_place")
    return rows.join(refused, ["_part", "_place"], "left_anti").select("_row.*")
