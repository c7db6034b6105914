"""Streams of telemetry and audit events, and the task lifecycle as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docflow import schemas
from docflow.operators.lifecycle import RESULT, Lifecycle, _raw_columns, frame_of

END = "__end__"


def read_events(spark: SparkSession, path: str, schema=schemas.TELEMETRY, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and kind; rows later than the watermark are left out."""
    w = F.window("ts", window)
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(w.alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event", "n")


def run_status_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The latest event of each run and day, for update mode; a day's state goes when the watermark has passed it."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    day = F.window("ts", "1 day")
    return kept.groupBy("run_id", day.alias("d")).agg(F.max_by("event", "ts").alias("event"), F.max("ts").alias("ts")).select("run_id", F.col("d.start").alias("day"), "event", "ts")


def token_usage_stream(calls: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tokens of calls (ts, instance, model, input_tokens, output_tokens) by tumbling window, instance and model."""
    kept = calls.withWatermark("ts", late) if calls.isStreaming else calls
    w = F.window("ts", window)
    per = kept.groupBy(w.alias("w"), "instance", "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return per.select(F.col("w.start").alias("window_start"), "instance", "model", "input_tokens", "output_tokens")


def step_summary_stream(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Completed steps (ts, run_id, event, payload) by tumbling window, run and step."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    p = F.from_json("payload", "step string, seconds double, items long")
    rows = kept.where("event = 'step.completed'").select("ts", "run_id", p.alias("p"))
    per = rows.groupBy(F.window("ts", window).alias("w"), "run_id", F.col("p.step").alias("step")).agg(F.count("*").alias("n"), F.sum("p.seconds").alias("seconds"), F.sum("p.items").alias("items"))
    return per.select(F.col("w.start").alias("window_start"), "run_id", "step", "n", "seconds", "items")


def once(events: DataFrame, keys: tuple[str, ...] = ("id",), late: str = "1 day") -> DataFrame:
    """Events without replays: of those that share keys and come within the watermark's delay of each other one counts. Their state goes when the watermark has passed it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def append_stream(events: DataFrame, path: str, checkpoint: str):
    """An append-only sink; start() is left to the caller by returning the writer."""
    return events.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)


STATE = "state string"


def _plain(record: dict) -> dict:
    """A row as JSON can hold it."""
    out = {k: (list(x) if hasattr(x, "tolist") and getattr(x, "ndim", 0) else x) for k, x in record.items()}
    return {k: None if isinstance(x, float) and x != x else (x.item() if hasattr(x, "item") else x) for k, x in out.items()}


def lifecycle_stream(raws: DataFrame, idle_seconds: float | None = None) -> DataFrame:
    """Closed tasks as a document's sections come in. raws: (doc_id, node_id, pos, ord, id, title, ...), a row with node_id END closes the document.

    The state of a document is its open tasks and the rows of the section that came last: a section counts as complete
    when a later one begins, so its rows may come in several batches. Sections must come in order of pos. A document that
    gets no rows for idle_seconds is closed by a timer as END would close it, and its state goes; without, it waits for END.
    """
    import json

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = json.loads(state.get[0]) if state.exists else {"open": [], "held": []}
        life, over = Lifecycle(old["open"]), state.hasTimedOut
        rows = old["held"] + ([] if over else [_plain(r) for r in pd.concat(list(frames)).to_dict("records")])
        rows.sort(key=lambda r: (r["pos"], r["ord"]))
        held = [] if over else [r for r in rows if r["pos"] == rows[-1]["pos"]]
        out = []
        for pos in sorted({r["pos"] for r in rows}):
            part = [r for r in rows if r["pos"] == pos]
            if part[0]["node_id"] == END:
                out += life.end()
                held = []
            elif part != held:
                out += life.step(part[0]["node_id"], [r for r in part if r["id"]])
        if over:
            out += life.end()
        if life.open or held:
            state.update((json.dumps({"open": life.open, "held": held}),))
            if idle_seconds is not None:
                state.setTimeoutDuration(int(idle_seconds * 1000))
        elif state.exists:
            state.remove()
        yield frame_of(key[0], out)

    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    return raws.select(*_raw_columns(raws)).groupBy("doc_id").applyInPandasWithState(run, RESULT, STATE, "append", timeout)
