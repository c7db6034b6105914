"""Review state of tasks: counts, filters, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def review_stats(tasks: DataFrame, by: str = "run_id") -> DataFrame:
    n = {s.lower(): F.count_if(F.col("status") == s) for s in ("APPROVED", "REJECTED", "PUSHED")}
    return tasks.groupBy(by).agg(F.count("*").alias("total"), *[c.alias(k) for k, c in n.items()], (F.count("*") - n["approved"] - n["rejected"] - n["pushed"]).alias("pending"))


def section_of(tasks: DataFrame) -> Column:
    return F.coalesce(F.get("source_refs", F.lit(0))["section_title"], F.lit("General"))


def group_by_section(tasks: DataFrame, by: str = "run_id") -> DataFrame:
    done = F.count_if(F.col("status").isin("APPROVED", "PUSHED"))
    return tasks.groupBy(by, section_of(tasks).alias("section")).agg(F.count("*").alias("n_tasks"), done.alias("n_approved"))


def shown(tasks: DataFrame, pending: bool = True, approved: bool = True, rejected: bool = True, flagged_only: bool = False) -> DataFrame:
    """Tasks that the check boxes leave visible; PUSHED goes only if both pending and approved are off."""
    s = F.col("status")
    hide = F.lit(False)
    for off, name in ((not pending, "CLOSED"), (not approved, "APPROVED"), (not rejected, "REJECTED"), (not pending and not approved, "PUSHED")):
        hide = hide | (F.lit(off) & (s == name))
    if flagged_only:
        hide = hide | (F.coalesce(F.size("flags"), F.lit(0)) <= 0)
    return tasks.where(~hide)


def approved(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'APPROVED'")


def approve_all(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("status", F.when(F.col("status") == "CLOSED", F.lit("APPROVED")).otherwise(F.col("status")))


def approve_count(tasks: DataFrame, by: str = "run_id") -> DataFrame:
    return tasks.groupBy(by).agg(F.count_if(F.col("status") == "CLOSED").alias("n_approved"))


def upsert(tasks: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks with the given fields replaced, updates of unknown ids). A null in updates is a field that wasn't given, unless its name is in the row's array cleared (if there is one), which sets it to null. Of several updates with one id the last isn't defined, so ids must be unique there."""
    fields = [c for c in updates.columns if c not in ("id", "cleared")]
    none = F.array().cast("array<string>")
    cleared = F.coalesce("cleared", none) if "cleared" in updates.columns else none
    met = tasks.join(updates.select("id", *[F.col(c).alias(f"_{c}") for c in fields], cleared.alias("_cleared")).hint("merge"), "id", "left")
    for c in fields:
        met = met.withColumn(c, F.when(F.array_contains("_cleared", c), F.lit(None)).otherwise(F.coalesce(f"_{c}", c)))
    return met.select(tasks.columns), updates.join(tasks.select("id"), "id", "left_anti")


def insert(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """tasks plus tasks written by hand: APPROVED, confidence 1, empty lists where nothing is given."""
    own = new.withColumn("status", F.lit("APPROVED")).withColumn("confidence", F.lit(1.0))
    for f in tasks.schema.fields:
        if f.dataType.typeName() == "array" and f.name not in own.columns:
            own = own.withColumn(f.name, F.array().cast(f.dataType))
    return tasks.unionByName(own.select([c for c in own.columns if c in tasks.columns]), allowMissingColumns=True)


def delete_run(tasks: DataFrame, gone: DataFrame) -> DataFrame:
    return tasks.join(gone.select("run_id").distinct(), "run_id", "left_anti")

