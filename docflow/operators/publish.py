"""Issues from approved tasks: types, containers, payloads, and what pushing them gave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.functions import issues as I
from docflow.operators.review import section_of

# Issue types for each hierarchy, with what stands in for them.
CONTAINER = {"epic_task": ("Epic", ["Story"]), "story_subtask": ("Story", ["Task"])}
CHILD = {"flat": ("Task", ["Story", "Bug"]), "epic_task": ("Task", ["Story", "Bug"]), "story_subtask": ("Sub-task", ["Subtask", "Task"])}


def containers(tasks: DataFrame) -> DataFrame:
    """(run_id, section, container_no, summary): sections in the order in which they are first seen."""
    seen = tasks.select("run_id", "pos", section_of(tasks).alias("section")).groupBy("run_id", "section").agg(F.min("pos").alias("pos"))
    no = F.row_number().over(W.partitionBy("run_id").orderBy("pos"))
    return seen.select("run_id", "section", no.alias("container_no"), I.container_summary(F.col("section")).alias("summary"))


def payloads(tasks: DataFrame, types: DataFrame, hierarchy: str = "epic_task") -> DataFrame:
    """One row an issue to create: containers first, then tasks with their container's number. types: (run_id, available)."""
    kids = tasks.join(types, "run_id", "left").withColumn("available", F.coalesce("available", F.array().cast("array<string>"))).withColumn("section", section_of(tasks))
    desired, rest = CHILD[hierarchy]
    child_type = I.issue_type(F.lit(desired), rest, F.col("available"))
    rows = kids.select("run_id", "id", "pos", "section", I.summary(F.col("title")).alias("summary"), I.description({c: F.col(c) for c in tasks.columns}).alias("description"), child_type.alias("issue_type"), I.labels(F.col("flags")).alias("labels"))
    if hierarchy == "flat":
        return rows.withColumn("step", F.lit(2)).withColumn("container_no", F.lit(None).cast("int"))
    desired, rest = CONTAINER[hierarchy]
    tops = containers(tasks)
    own = tops.join(types, "run_id", "left").select(
        "run_id", F.lit(None).cast("string").alias("id"), F.col("container_no").cast("long").alias("pos"), "section", "summary", F.lit(None).cast("string").alias("description"),
        I.issue_type(F.lit(desired), rest, F.coalesce("available", F.array().cast("array<string>"))).alias("issue_type"), F.array().cast("array<string>").alias("labels"), F.lit(1).alias("step"), "container_no",
    )
    kids_rows = rows.join(tops.select("run_id", "section", "container_no"), ["run_id", "section"]).withColumn("step", F.lit(2)).withColumn("pos", F.col("pos").cast("long"))
    return own.unionByName(kids_rows)


def as_json(rows: DataFrame, project: str, keys: DataFrame | None = None) -> DataFrame:
    """Payloads as JSON. A task under a container names its parent: by the key that creating the container gave (keys: run_id, container_no, key), else by the container's number."""
    rows = rows.withColumn("_key", F.lit(None).cast("string")) if keys is None else rows.join(keys.select("run_id", "container_no", F.col("key").alias("_key")).hint("merge"), ["run_id", "container_no"], "left")
    under = (F.col("step") == 2) & F.col("container_no").isNotNull()
    parent = F.when(under, F.struct(F.coalesce("_key", F.concat(F.lit("#"), F.col("container_no").cast("string"))).alias("key")))
    fields = F.struct(F.struct(F.lit(project).alias("key")).alias("project"), "summary", "description", F.struct(F.col("issue_type").alias("name")).alias("issuetype"), "labels", parent.alias("parent"))
    return rows.select("run_id", "step", "pos", F.to_json(F.struct(fields.alias("fields"))).alias("payload"))


def parent_fallback(results: DataFrame) -> DataFrame:
    """A failure that the parent caused (400, or the word parent) counts as the retry without it; results has retry_success, retry_key, retry_error."""
    again = ~F.col("success") & F.col("had_parent") & (F.contains("error", F.lit("400")) | F.contains(F.lower("error"), F.lit("parent")))
    again = F.coalesce(again, F.lit(False))
    warned = again & F.coalesce("retry_success", F.lit(False))
    return results.select(
        "task_id",
        (F.col("success") | warned).alias("success"),
        F.when(warned, F.col("retry_key")).otherwise(F.col("jira_issue_key")).alias("jira_issue_key"),
        F.when(warned, F.lit(None)).when(again, F.col("retry_error")).otherwise(F.col("error")).cast("string").alias("error"),
        F.when(warned, F.lit("Created without parent (flat fallback)")).alias("warning"),
    )


def all_failed(tasks: DataFrame, error: str) -> DataFrame:
    """A failure row for each task, for a project that can't be reached."""
    return tasks.select(F.col("id").alias("task_id"), F.lit(False).alias("success"), F.lit(None).cast("string").alias("jira_issue_key"), F.lit(error).alias("error"))


def apply_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Approved tasks that were pushed become PUSHED."""
    own = results.select(F.col("task_id").alias("id"), F.col("success").alias("_ok"))
    status = F.when(F.coalesce("_ok", F.lit(False)) & (F.col("status") == "APPROVED"), F.lit("PUSHED")).otherwise(F.col("status"))
    return tasks.join(own, "id", "left").withColumn("status", status).drop("_ok")


def push_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id").agg(
        F.count_if("success").alias("passed"), F.count_if(~F.col("success")).alias("failed"), F.substring(F.min_by("error", F.when(~F.col("success"), F.col("pos"))), 1, 100).alias("first_error")
    )
