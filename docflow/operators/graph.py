"""Connected components of link tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.sources.io import stored


def joined_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """labels (of each place the smallest place that it is joined to) after i[k] and j[k] are joined, for all k. For use inside a task."""
    labels = labels.copy()
    while True:
        a, b = labels[i], labels[j]
        if np.array_equal(a, b):
            return labels
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b), both of one orderable type: root is the smallest node that it reaches.

    Each round every node's larger neighbours, then its smaller ones, are linked to the smallest of them, by a grouped
    minimum and a join; so chains halve. Rounds are written to the shared folder, joins lie between plain exchanges.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        up = stored(both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"), (F.col("m") < F.col("a")).alias("moved")), "up")
        low = stored(up.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"), F.max("moved").alias("moved")), "low")
        if not low.agg(F.max(F.col("moved") | (F.col("m") < F.col("most")))).first()[0]:  # each node hangs on its root alone
            roots = low.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()
            return low.select(F.col("a").alias("node"), F.col("m").alias("root")).unionByName(roots)
        down = up.join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = stored(down.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
    raise RuntimeError("the components did not settle")
