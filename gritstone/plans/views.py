"""The benchmark's tables as the engine's collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.filters import failed


def wide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request event of each row of `events`: service, step and code from its key, a trace for each user and day, each event called by the one
    before it, with some parents that nothing owns."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    # A row for a row: the key is parsed once here, and not again for each column made of it.
    rows = e.select(
        "event_id", F.col("ts").alias("ts_start"), F.floor("value").cast("bigint").alias("duration_ms"), "event_type",
        F.col("user_id").cast("string").alias("user_id"), F.explode(F.array(k)).alias("k")
    )
    status = (
        F.when(F.col("event_type") == "error", F.when(F.col("k") % 10 == 0, "timeout").when(F.col("k") % 10 == 1, "partial").when(F.col("k") % 10 == 2, "aborted").otherwise("error"))
        .when((F.col("event_type") == "view") & (F.col("k") % 20 == 0), "suppressed")
        .otherwise("ok")
    )
    rows = rows.select(
        "event_id", "ts_start", "duration_ms", "event_type", "user_id", "k",
        (F.col("ts_start") + F.expr("make_dt_interval(0, 0, 0, cast(duration_ms as decimal(15, 6)) / 1000)")).alias("ts_end"),
        F.concat(F.lit("svc_"), F.col("k") % 5).alias("service"), F.lit("prod").alias("env"), status.alias("status"),
        F.concat(F.lit("v"), F.floor(F.dayofmonth("ts_start") / 10)).alias("version"),
        F.concat_ws("_", "user_id", F.date_format("ts_start", "yyyyMMdd")).alias("trace_id"), F.col("event_id").alias("seq"),
    )
    rows = rows.withColumn("step", F.when(failed(), F.concat(F.lit("step_"), F.col("k") % 3))).withColumn(
        "error_code", F.when(failed(), F.concat(F.lit("E"), F.col("k") % 4))
    )
    before = F.lag("event_id").over(Window.partitionBy("trace_id").orderBy("ts_start", "event_id")).cast("string")
    rows = rows.withColumn("parent_span_id", F.when(before.isNull(), "").when(F.col("k") % 7 == 0, "missing").otherwise(before))
    step = F.struct(
        F.concat(F.lit("step_"), F.col("k") % 3).alias("name"), F.col("event_id").cast("string").alias("span_id"), F.lit(0).cast("bigint").alias("start_ms"), F.col("duration_ms").alias("duration_ms"), F.when(failed(), "error").otherwise("ok").alias("status"),
        F.struct(F.concat(F.lit("svc_"), (F.col("k") + 1) % 5).alias("service"), F.concat(F.lit("/"), "event_type").alias("endpoint")).alias("downstream"),
    )
    return rows.withColumn("steps", F.array(step))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal of each signup."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'signup'")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kinds = F.array(*[F.lit(x) for x in ("deploy", "runtime", "healthcheck", "dependency", "config", "alert")])
    return e.select(
        F.concat(F.lit("sig_"), "event_id").alias("signal_id"), F.get(kinds, (k % 6).cast("int")).alias("type"),
        F.get(F.array(F.lit("info"), F.lit("warning"), F.lit("critical")), (k % 3).cast("int")).alias("severity"),
        F.concat(F.lit("svc_"), k % 5).alias("service"), F.lit("prod").alias("env"), F.lit("bench").alias("source"), F.col("ts").alias("timestamp"),
        F.lit(None).cast("string").alias("alert_incident_id"), F.concat(F.lit("E"), k % 4).alias("alert_code"), F.lit("").alias("alert_step")
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incident of each error family and day: its first failure starts it, its last is now."""
    w = wide_events(spark, sf_dir).where(failed())
    day = F.date_format("ts_start", "yyyyMMdd")
    rows = w.groupBy("env", "service", "step", "error_code", day.alias("day")).agg(
        F.min("ts_start").alias("started_at"), F.max("ts_start").alias("now"), F.count(F.lit(1)).alias("events"),
        F.count_distinct("user_id").alias("users"), F.count_distinct("trace_id").alias("requests"), F.max("version").alias("version")
    )
    return rows.withColumn("incident_id", F.concat_ws("|", "service", "step", "error_code", "day")).withColumn(
        "downstream_service", F.concat(F.lit("svc_"), (F.substring("service", 5, 1).cast("int") + 1) % 5)
    )


def long_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide events with four steps and four logs each, made of the key; every eleventh failed one's anchor names no step."""
    w = wide_events(spark, sf_dir)
    steps = F.transform(F.array(*[F.lit(j) for j in range(4)]), lambda j: F.struct(
        F.concat(F.lit("step_"), (F.col("k") + j) % 3).alias("name"), F.concat_ws("-", F.col("event_id").cast("string"), j.cast("string")).alias("span_id"), ((F.col("k") + 1) * (j + 1) * 7 % 50).alias("start_ms"), ((F.col("k") + j * 13) % 40).alias("duration_ms"),
        F.when((F.col("k") + j) % 4 == 0, "error").otherwise("ok").alias("status"),
        F.when((F.col("k") + j) % 2 == 0, F.struct(F.concat(F.lit("svc_"), (F.col("k") + j) % 5).alias("service"), F.concat(F.lit("/"), j.cast("string")).alias("endpoint"))).alias("downstream"),
    ))
    levels = F.array(*[F.lit(x) for x in ("info", "warn", "error")])
    logs = F.transform(F.array(*[F.lit(j) for j in range(4)]), lambda j: F.struct((F.col("k") * 11 + j * 17).alias("n"), j.alias("j"))) 
    logs = F.transform(
        logs,
        lambda x: F.struct(
            (x["n"] % 90).alias("ts_offset_ms"), F.get(levels, ((F.col("k") + x["j"]) % 3).cast("int")).alias("level"),
            F.concat(F.lit("m"), x["j"].cast("string")).alias("msg")
        )
    )
    anchor = F.when(failed(), F.struct(F.when(F.col("k") % 11 == 0, "absent").otherwise(F.col("step")).alias("step"), "error_code"))
    return w.withColumn("steps", steps).withColumn("logs", logs).withColumn("anchor", anchor)
