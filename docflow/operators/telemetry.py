"""Aggregates over audit rows, telemetry events and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def action_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("agent", "action").agg(F.count("*").alias("n"), F.sum("llm_tokens_used").alias("tokens"))


def action_rollup(audit: DataFrame) -> DataFrame:
    return audit.rollup("agent", "action").agg(F.count("*").alias("n"))


def token_usage(calls: DataFrame) -> DataFrame:
    """Tokens by kind, instance and model: the two counters are unpivoted first."""
    long = calls.unpivot(["instance", "model"], ["input_tokens", "output_tokens"], "type", "tokens")
    return long.groupBy(F.regexp_replace("type", "_tokens$", "").alias("type"), "instance", "model").agg(F.sum("tokens").alias("tokens"))


def latency_histogram(calls: DataFrame, low: float, high: float, buckets: int) -> DataFrame:
    return calls.groupBy("model", F.width_bucket("seconds", F.lit(low), F.lit(high), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))


def latency_quantiles(calls: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Median, 90th and 99th percentile of each model, with a rank error of 1 / accuracy."""
    return calls.groupBy("model").agg(F.percentile_approx("seconds", [0.5, 0.9, 0.99], accuracy).alias("q"))


def log_stream(log: DataFrame, agent: str, most: int = 100) -> DataFrame:
    """The latest rows of one agent, the newest first."""
    return log.where(F.col("agent") == agent).orderBy(F.desc("ts"), F.desc("id")).limit(most)


def step_summary(events: DataFrame) -> DataFrame:
    """(run_id, step, n, seconds, items) from events whose payload names step, seconds and items."""
    p = F.from_json("payload", "step string, seconds double, items long")
    return events.where("event = 'step.completed'").select("run_id", p.alias("p")).groupBy("run_id", F.col("p.step").alias("step")).agg(F.count("*").alias("n"), F.sum("p.seconds").alias("seconds"), F.sum("p.items").alias("items"))


def run_totals(events: DataFrame) -> DataFrame:
    """(run_id, seconds, n_tasks) of completed runs."""
    p = F.from_json("payload", "seconds double, task_count long")
    return events.where("event = 'run.completed'").select("run_id", p.alias("p")).groupBy("run_id").agg(F.sum("p.seconds").alias("seconds"), F.sum("p.task_count").alias("n_tasks"))


def retries(events: DataFrame) -> DataFrame:
    """(model, n_calls, n_retries, wait_seconds): calls and repeated calls of each model."""
    p = F.from_json("payload", "model string, wait_seconds double")
    rows = events.where("event in ('llm.call', 'llm.retry')").select("event", p.alias("p"))
    again = F.col("event") == "llm.retry"
    return rows.groupBy(F.col("p.model").alias("model")).agg(F.count_if(~again).alias("n_calls"), F.count_if(again).alias("n_retries"), F.coalesce(F.sum(F.when(again, F.col("p.wait_seconds"))), F.lit(0.0)).alias("wait_seconds"))


def recent_cost(events: DataFrame, now, hours: int = 6) -> DataFrame:
    """One row: the cost of the last hours before now (a timestamp column or literal)."""
    return events.where((F.col("ts") > now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") <= now)).agg(F.sum("cost").alias("cost"))


def last_lines(log: DataFrame, most: int = 50) -> DataFrame:
    n = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("id")))
    return log.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def log_filter(log: DataFrame, noise: tuple[str, ...] = ()) -> DataFrame:
    """Without DEBUG rows and rows whose message holds a word of noise."""
    rows = log.where("level <> 'DEBUG'")
    for word in noise:
        rows = rows.where(~F.contains(F.coalesce("message", F.lit("")), F.lit(word)))
    return rows


def run_status(events: DataFrame) -> DataFrame:
    """The latest event of each run."""
    return events.groupBy("run_id").agg(F.max_by("event", F.struct("ts", "id")).alias("event"), F.max("ts").alias("ts"), F.count("*").alias("n_events"))


def audit_of_run(audit: DataFrame, run_id) -> DataFrame:
    return audit.where(F.col("run_id") == run_id).orderBy("id")
