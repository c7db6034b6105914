"""Calls of a model that survive failures and restarts: a log of attempts, and a step that sends only what is open and due.

The log is a Parquet folder with a row for each attempt. Prompts with equal text are one prompt, told by its hash, and
are sent once. A failed attempt is tried again, not before its wait is over, if it may pass (functions.retry) and the
prompt's attempts and time aren't used up; permanent failures end at once. A run that stops goes on where its log ends:
answered prompts are never sent again. A task that is lost in the middle of its batch sends that batch again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions import retry as R

LOG = "prompt_hash string, attempt int, at double, ok boolean, content string, error string, status int, headers map<string,string>, retryable boolean, not_before double"
#: Attempts for a prompt, and seconds: from its first attempt on, and to wait at most for the next.
MOST_ATTEMPTS = 8
MOST_ELAPSED = 300.0
MOST_WAIT = 300.0


def _hash(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The attempts so far; an empty log is begun where there is none."""
    spark.createDataFrame([], LOG).write.mode("append").parquet(path)
    return spark.read.schema(LOG).parquet(path)


def states(log: DataFrame, most_attempts: int = MOST_ATTEMPTS, most_elapsed: float = MOST_ELAPSED) -> DataFrame:
    """(prompt_hash, state, attempts, content, error, not_before): state is answered, failed (for good, or nothing is left to try) or waiting."""
    last = lambda c: F.max_by(c, F.struct("attempt", "at")).alias(c)
    per = log.groupBy("prompt_hash").agg(
        F.max("ok").alias("ok"), F.count("*").cast("int").alias("attempts"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.max_by("content", F.when(F.col("ok"), F.struct("attempt", "at"))).alias("content"), *[last(c) for c in ("error", "retryable", "not_before")],
    )
    over = ~F.col("retryable") | (F.col("attempts") >= most_attempts) | (F.col("last_at") - F.col("first_at") >= most_elapsed)
    state = F.when(F.col("ok"), "answered").when(over, "failed").otherwise("waiting")
    return per.select("prompt_hash", state.alias("state"), "attempts", "content", F.when(~F.col("ok"), F.col("error")).alias("error"), F.when(state == "waiting", F.col("not_before")).alias("not_before"))


def open_prompts(prompts: DataFrame, log: DataFrame, prompt_col: str = "prompt", **limits) -> DataFrame:
    """(prompt_hash, prompt, attempt, not_before) of the prompts without an end: attempt is the number of the next one, not_before null for new ones."""
    asked = prompts.where(F.col(prompt_col).isNotNull()).select(_hash(F.col(prompt_col)).alias("prompt_hash"), F.col(prompt_col).alias("prompt")).dropDuplicates(["prompt_hash"])
    known = states(log, **limits).select("prompt_hash", "state", "attempts", "not_before")
    met = asked.join(known.hint("merge"), "prompt_hash", "left").where("state is null or state = 'waiting'")
    return met.select("prompt_hash", "prompt", (F.coalesce("attempts", F.lit(0)) + 1).alias("attempt"), "not_before")


def send(due: DataFrame, answer: Callable[[str, int], str], at: float, workers: int = 4, most_wait: float = MOST_WAIT) -> DataFrame:
    """The log's rows of one attempt for each row of due. answer(prompt, attempt) gives the text or raises; a raised error's status_code and headers are kept where it has them."""

    def one(prompt: str, attempt: int) -> tuple:
        try:
            return True, answer(prompt, attempt), None, None, None
        except Exception as e:  # noqa: BLE001  a row: whether it may pass is decided over the log
            status, headers = getattr(e, "status_code", None), getattr(e, "headers", None) or getattr(getattr(e, "response", None), "headers", None) or {}
            return False, None, str(e)[:2000], status if isinstance(status, int) else None, {str(k).lower(): str(v) for k, v in dict(headers).items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                got = list(pool.map(one, batch["prompt"], batch["attempt"].tolist()))
                out = pd.DataFrame(got, columns=["ok", "content", "error", "status", "headers"])
                out.insert(0, "attempt", batch["attempt"].to_numpy())
                out.insert(0, "prompt_hash", batch["prompt_hash"].to_numpy())
                yield out.astype({"status": "Int32"})

    shape = "prompt_hash string, attempt int, ok boolean, content string, error string, status int, headers map<string,string>"
    said = due.select("prompt_hash", "prompt", "attempt").mapInPandas(run, shape).withColumn("at", F.lit(float(at)))
    wait = R.wait_seconds(R.wait_hint(F.coalesce("headers", F.create_map().cast("map<string,string>")), F.col("error"), F.col("at")), F.col("attempt"), most_wait)
    failed = ~F.col("ok")
    said = said.withColumn("retryable", F.when(failed, R.retryable(F.col("status"), F.col("error")))).withColumn("not_before", F.when(failed, F.col("at") + wait))
    return said.select(*[x.split(" ")[0] for x in LOG.split(", ")])


def results(prompts: DataFrame, log: DataFrame, keys: tuple[str, ...] = ("doc_id", "node_id"), prompt_col: str = "prompt", **limits) -> DataFrame:
    """keys, state, attempts, content, error for each row of prompts; state is open for what hasn't been sent. A null prompt stays open."""
    own = prompts.select(*keys, _hash(F.col(prompt_col)).alias("prompt_hash"))
    met = own.join(states(log, **limits).drop("not_before").hint("merge"), "prompt_hash", "left").drop("prompt_hash")
    return met.withColumn("state", F.coalesce("state", F.lit("open"))).withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def resumable_step(
    prompts: DataFrame, path: str, answer: Callable[[str, int], str], keys: tuple[str, ...] = ("doc_id", "node_id"), prompt_col: str = "prompt", workers: int = 4,
    most_attempts: int = MOST_ATTEMPTS, most_elapsed: float = MOST_ELAPSED, most_wait: float = MOST_WAIT, most_rounds: int | None = None,
    clock: Callable[[], float] = time.time, pause: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """results of prompts, once every prompt is answered or failed, or after most_rounds rounds; another call with the same path goes on from there.

    Each round sends what is due in one job and appends its attempts to the log at path; between rounds it pauses until the
    first wait is over.
    """
    spark, limits = prompts.sparkSession, {"most_attempts": most_attempts, "most_elapsed": most_elapsed}
    rounds = 0
    while most_rounds is None or rounds < most_rounds:
        left, now = open_prompts(prompts, read_log(spark, path), prompt_col, **limits), clock()
        first = left.agg(F.count("*").alias("n"), F.min(F.coalesce("not_before", F.lit(0.0))).alias("at")).first()
        if not first.n:
            break
        if first["at"] > now:
            pause(first["at"] - now)
            continue
        send(left.where(F.coalesce("not_before", F.lit(0.0)) <= now), answer, now, workers, most_wait).write.mode("append").parquet(path)
        rounds += 1
    return results(prompts, read_log(spark, path), keys, prompt_col, **limits)
