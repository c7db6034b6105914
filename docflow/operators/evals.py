"""Golden sets and scores: what was expected against what was found."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.functions import text as T
from docflow.sources.io import stored


def golden_set(features: DataFrame, epics: DataFrame) -> DataFrame:
    """Epics (epic_id, title, description, feature_ids) with their features as expected tickets, and the section's full text."""
    listed = epics.select("epic_id", F.posexplode("feature_ids").alias("_i", "feature_id"))
    met = listed.join(features.hint("merge"), "feature_id")
    ticket = F.struct("_i", F.concat(F.lit("Implement "), "feature_name").alias("title"), F.col("description").alias("short_description"), T.sentences(F.col("acceptance_criteria")).alias("acceptance_criteria"))
    per = met.groupBy("epic_id").agg(F.array_sort(F.collect_list(ticket)).alias("t"))
    said = F.array_join(F.concat(F.array("description"), F.transform("t", lambda x: x["short_description"])), "\n\n")
    return epics.join(per.hint("merge"), "epic_id").select("epic_id", "title", said.alias("section_text"), F.transform("t", lambda x: x.dropFields("_i")).alias("tickets"))


def _words(c: str):
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\W+"), lambda x: x != ""))


def _rare_first(tickets: DataFrame, key: str, counts: DataFrame, least: float) -> DataFrame:
    """(section, key, word) for the rarest words of each ticket: so many that two tickets with an index of least share one of them."""
    each = tickets.select("section", key, F.size("w").alias("n"), F.explode("w").alias("word")).join(counts.hint("merge"), ["section", "word"])
    rank = F.row_number().over(W.partitionBy("section", key).orderBy("seen", "word"))
    return each.withColumn("_r", rank).where(F.col("_r") <= F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).select("section", key, "word")


def golden_pairs(golden: DataFrame, actual: DataFrame, least: float = 0.5) -> DataFrame:
    """(section, golden_id, actual_id, score): tickets of one section whose words have a Jaccard index of at least least. Ids are unique within a section.

    Only pairs that share one of their rarest words meet, so words that stand in every ticket make no pairs; which words
    are rare is counted over the section. The words' counts are written out, so adaptive execution can split a common word.
    """
    g, a = (rows.select("section", key, _words("title").alias("w")) for rows, key in ((golden, "golden_id"), (actual, "actual_id")))
    both = g.select("section", F.explode("w").alias("word")).unionByName(a.select("section", F.explode("w").alias("word")))
    counts = stored(both.groupBy("section", "word").agg(F.count("*").alias("seen")), "words")
    pairs = _rare_first(g, "golden_id", counts, least).join(_rare_first(a, "actual_id", counts, least).hint("merge"), ["section", "word"]).select("section", "golden_id", "actual_id").distinct()
    met = pairs.join(g.withColumnRenamed("w", "wg").hint("merge"), ["section", "golden_id"]).join(a.withColumnRenamed("w", "wa").hint("merge"), ["section", "actual_id"])
    n = F.size(F.array_intersect("wg", "wa"))
    return met.withColumn("score", n / (F.size("wg") + F.size("wa") - n)).where(F.col("score") >= least).select("section", "golden_id", "actual_id", "score")


def golden_match(golden: DataFrame, actual: DataFrame, least: float = 0.5, unique: bool = False) -> DataFrame:
    """(section, golden_id, actual_id, score): the best actual ticket of the same section by the Jaccard index of words, ties by id; unique: none taken twice, the scores' sum as large as can be."""
    scored = golden_pairs(golden, actual, least)
    if unique:
        return one_to_one(scored)
    first = F.row_number().over(W.partitionBy("section", "golden_id").orderBy(F.desc("score"), "actual_id"))
    return scored.withColumn("_n", first).where("_n = 1").select("section", "golden_id", "actual_id", "score")


def one_to_one(scored: DataFrame) -> DataFrame:
    """Of pairs (section, golden_id, actual_id, score > 0) those of an assignment in which no id stands twice and the scores' sum is as large as can be.

    A section's pairs are one group, as an assignment is found over them together, by augmenting paths: each golden id in
    turn takes the path that gains most, over ids that move to others of theirs. Pairs come from golden_pairs, which
    leaves only those above a score.
    """

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["golden_id", "actual_id"], ignore_index=True)
        near: dict = {}
        for g, a, s in zip(group["golden_id"], group["actual_id"], group["score"], strict=True):
            near.setdefault(g, {})[a] = s
        holder: dict = {}  # the golden id of each actual one
        for _ in near:
            # the best gain of an alternating path from any golden id without an actual one; gains settle as in Bellman and Ford
            held = {g: a for a, g in holder.items()}
            gain = {g: 0.0 for g in near if g not in held}
            reach: dict = {}
            changed = True
            while changed:
                changed = False
                for g in list(gain):
                    for a, s in near[g].items():
                        if held.get(g) != a and gain[g] + s > reach.get(a, (-1e18,))[0] + 1e-12:
                            reach[a] = (gain[g] + s, g)
                            changed = True
                            if a in holder and reach[a][0] - near[holder[a]][a] > gain.get(holder[a], -1e18) + 1e-12:
                                gain[holder[a]] = reach[a][0] - near[holder[a]][a]
            free = [(reach[a][0], -k, a) for k, a in enumerate(sorted(reach)) if a not in holder]
            if not free or max(free)[0] <= 1e-12:
                break
            a = max(free)[2]
            while True:
                g = reach[a][1]
                before = held.get(g)
                holder[a] = g
                if before is None:
                    break
                a = before
        rows = [(group["section"].iloc[0], g, a, near[g][a]) for a, g in holder.items()]
        return pd.DataFrame(rows, columns=["section", "golden_id", "actual_id", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in scored.schema.fields}
    return scored.groupBy("section").applyInPandas(assign, ", ".join(f"{c} {kinds[c]}" for c in ("section", "golden_id", "actual_id", "score")))


def alignment(golden: DataFrame, actual: DataFrame) -> DataFrame:
    """(section, alignment): the Jaccard index of the words of the expected and the found epic's title. Both: (section, title), a row a section."""
    met = golden.select("section", _words("title").alias("a")).join(actual.select("section", _words("title").alias("b")).hint("merge"), "section", "left")
    n = F.size(F.array_intersect("a", "b"))
    all_words = F.size("a") + F.size("b") - n
    return met.select("section", F.when(F.col("b").isNotNull() & (all_words > 0), n / all_words).otherwise(F.lit(0.0)).alias("alignment"))


def eval_scores(golden: DataFrame, actual: DataFrame, matched: DataFrame, aligned: DataFrame | None = None) -> DataFrame:
    """(section, recall, hallucination, fidelity) for each section of the golden set; and alignment, where that of the epics is given."""
    g = golden.groupBy("section").agg(F.count("*").alias("ng"))
    a = actual.groupBy("section").agg(F.count("*").alias("na"))
    m = matched.groupBy("section").agg(F.count("*").alias("nm"), F.countDistinct("actual_id").alias("nu"), F.avg("score").alias("fidelity"))
    met = g.join(a.hint("merge"), "section", "left").join(m.hint("merge"), "section", "left")
    if aligned is not None:
        met = met.join(aligned.hint("merge"), "section", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return met.select(
        "section",
        (zero("nm") / F.col("ng")).alias("recall"),
        F.when(zero("na") > 0, (zero("na") - zero("nu")) / zero("na")).otherwise(F.lit(0.0)).alias("hallucination"),
        F.coalesce("fidelity", F.lit(0.0)).alias("fidelity"),
        *([F.coalesce("alignment", F.lit(0.0)).alias("alignment")] if aligned is not None else []),
    )
