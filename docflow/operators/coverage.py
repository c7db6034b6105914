"""Which sections have tasks, what share that is, and a second pass over those without."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.functions import text as T
from docflow.operators import tasks as K
from docflow.operators.tree import in_order


def covered_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return nodes.join(links.select("doc_id", "node_id").distinct().hint("merge"), ["doc_id", "node_id"], "left_semi")


def gaps(nodes: DataFrame, links: DataFrame, least_chars: int = 0) -> DataFrame:
    """Nodes without a task and with enough text."""
    none = nodes.join(links.select("doc_id", "node_id").distinct().hint("merge"), ["doc_id", "node_id"], "left_anti")
    return none.where(F.length(T.stripped(F.coalesce("text", F.lit("")))) >= least_chars) if least_chars else none


def task_counts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    n = links.groupBy("doc_id", "node_id").agg(F.count("*").alias("n_tasks"))
    return nodes.join(n.hint("merge"), ["doc_id", "node_id"], "left").withColumn("n_tasks", F.coalesce("n_tasks", F.lit(0)))


def carried(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """covered, also where tasks of the node before are still open or close here; links may have dangling (a continuation that never came), which covers all later nodes."""
    rows = task_counts(nodes, links)
    dangling = F.lit(False)
    if "dangling" in links.columns:
        first = links.where("dangling").join(nodes.select("doc_id", "node_id", "pos").hint("merge"), ["doc_id", "node_id"]).groupBy("doc_id").agg(F.min("pos").alias("_from"))
        rows = rows.join(first.hint("merge"), "doc_id", "left")
        dangling = F.coalesce(F.col("pos") > F.col("_from"), F.lit(False))
    before = F.coalesce(F.lag("n_tasks").over(in_order()), F.lit(0))
    return rows.withColumn("covered", (F.col("n_tasks") > 0) | (before > 0) | dangling).drop("_from")


def coverage_report(nodes: DataFrame, links: DataFrame, compat: bool = False) -> DataFrame:
    """(doc_id, total, covered, gap, pct): pct with one decimal, 0 for a document without nodes."""
    rows = carried(nodes, links) if compat else task_counts(nodes, links).withColumn("covered", F.col("n_tasks") > 0)
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if("covered").alias("covered"), F.count_if(~F.col("covered")).alias("gap"), F.round(100.0 * F.count_if("covered") / F.greatest(F.count("*"), F.lit(1)), 1).alias("pct")
    )


def gap_cap(found: DataFrame, most: int = 10) -> DataFrame:
    """The first uncovered nodes of each document, in order."""
    return found.withColumn("_n", F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))).where(F.col("_n") <= most).drop("_n")


def gap_recovery(nodes: DataFrame, links: DataFrame, most: int = 10, least_chars: int = 100, most_chars: int = 16000, extract=K.extract_rules) -> DataFrame:
    """Raw tasks of uncovered nodes, flagged GAP_RECOVERED and INCOMPLETE, closed; for dedup.recover_and_dedup."""
    again = K.cut_text(K.long_enough(gap_cap(gaps(nodes, links), most), least_chars), most_chars, notice=False)
    flags = F.array_union("flags", F.array(F.lit("GAP_RECOVERED"), F.lit("INCOMPLETE")))
    return extract(again).withColumn("flags", flags).withColumn("status", F.lit("CLOSED"))
