"""Near-duplicate tasks: similar vectors, decisions, and what they change."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docflow import schemas
from docflow.functions.text import embedding_text
from docflow.operators.graph import components, joined_labels
from docflow.sources.io import stored

BLOCK = 2000


def text_vectors(tasks: DataFrame, features: int = 1 << 12, sparse: bool = False) -> DataFrame:
    """(run_id, id, v): hashed words of title and description, weighted by rarity, of unit length. sparse: v has size, indices and values, a small part of the numbers."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
    from pyspark.ml.functions import vector_to_array

    rows = tasks.select("run_id", "id", embedding_text(F.col("title"), F.col("short_description")).alias("said"))
    model = Pipeline(stages=[Tokenizer(inputCol="said", outputCol="w"), HashingTF(inputCol="w", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="n")]).fit(rows)
    if sparse:
        told = model.transform(rows).select("run_id", "id", F.unwrap_udt("n").alias("n"))
        return told.select("run_id", "id", F.struct("n.size", "n.indices", F.col("n.values").cast("array<float>").alias("values")).alias("v"))
    return model.transform(rows).select("run_id", "id", vector_to_array("n", "float32").alias("v"))


def model_vectors(tasks: DataFrame, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(run_id, id, v) from a function of texts, batch by batch."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"run_id": b["run_id"], "id": b["id"], "v": list(np.asarray(embed(b["said"].tolist()), np.float32))})

    return tasks.select("run_id", "id", embedding_text(F.col("title"), F.col("short_description")).alias("said")).mapInPandas(run, "run_id string, id string, v array<float>")


def _dealt(vectors: DataFrame, block: int) -> DataFrame:
    """vectors once for each pair (a, b) of blocks of their run that their own block, part, is one of."""
    sizes = vectors.groupBy("run_id").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("parts"))
    rows = vectors.join(sizes.hint("merge"), "run_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"a": F.least("part", "other"), "b": F.greatest("part", "other")}).drop("parts", "other")
    return rows.select("*", "v.*").drop("v") if isinstance(vectors.schema["v"].dataType, StructType) else rows


def _matrix(group: pd.DataFrame) -> np.ndarray:
    """The vectors of a group as rows, from arrays or from indices and values."""
    if "v" in group:
        return np.array(group["v"].tolist(), np.float64)
    out = np.zeros((len(group), int(group["size"].max()) if len(group) else 0))
    out[np.repeat(np.arange(len(group)), group["indices"].map(len)), np.concatenate([np.zeros(0, np.int64), *group["indices"]]).astype(np.int64)] = np.concatenate([np.zeros(0), *group["values"]])
    return out


def similar_classes(vectors: DataFrame, least: float = 0.85, block: int = BLOCK) -> DataFrame:
    """(run_id, id, class_id, n_links) for each row of vectors (run_id, id, v): how many others of its run are similar to it, and the smallest id that it reaches over such links. Exact.

    Equal vectors are one node with a count, so copies cost one row. Blocks of nodes meet in pairs, as in similar_pairs,
    but return only what grows with the rows: for each node its links, weighted by copies, and a spanning forest. A null id
    or vector has no links; rows that repeat an id count each. Vectors of one run have one length.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    known = vectors.where("id is not null and v is not null")
    nodes = stored(known.groupBy("run_id", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "nodes")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group["a"].iloc[0], group["b"].iloc[0]
        group = group.sort_values("id", ignore_index=True)
        x, copies, part = _matrix(group), group["copies"].to_numpy(), group["part"].to_numpy()
        left, right = np.flatnonzero(part == a), np.flatnonzero(part == b)
        links, labels = np.zeros(len(x), np.int64), np.arange(len(x))
        for at in range(0, len(left) if len(right) else 0, 512):
            own = left[at : at + 512]
            near = x[own] @ x[right].T >= least
            links[own] += near @ copies[right]
            if a != b:
                links[right] += near.T @ copies[own]
            i, j = np.nonzero(near)
            labels = joined_labels(labels, own[i], right[j])
        if a == b:  # none is its own link; of copies that aren't even similar to themselves none is linked
            links -= (np.einsum("ij,ij->i", x, x) >= least).astype(np.int64)
        hit = (links > 0) | (labels != np.arange(len(x)))
        ids = group["id"].to_numpy()
        return pd.DataFrame({"run_id": group["run_id"].iloc[0], "id": ids[hit], "up": ids[labels[hit]], "n": links[hit]})

    met = stored(_dealt(nodes, block).groupBy("run_id", "a", "b").applyInPandas(run, f"run_id string, id {kind}, up {kind}, n long"), "similar")
    counts = met.groupBy("run_id", "id").agg(F.sum("n").alias("n"))
    node = lambda c: F.struct("run_id", F.col(c).alias("id"))
    roots = components(met.select(node("id").alias("a"), node("up").alias("b"))).select("node.run_id", F.col("node.id").alias("id"), F.col("root.id").alias("root"))
    told = nodes.join(counts.hint("merge"), ["run_id", "id"], "left").join(roots.hint("merge"), ["run_id", "id"], "left").withColumnRenamed("id", "rep")
    out = vectors.join(stored(told, "classes").hint("merge"), ["run_id", "v"], "left")
    linked = F.coalesce(F.col("n"), F.lit(0)) > 0
    return out.select("run_id", "id", F.when(linked & F.col("id").isNotNull(), F.coalesce("root", "rep")).otherwise(F.col("id")).alias("class_id"), F.when(F.col("id").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def similar_pairs(vectors: DataFrame, least: float = 0.85, block: int = BLOCK) -> DataFrame:
    """(run_id, id_a, id_b, similarity), id_a < id_b: pairs of one run with a product of at least `least`. Exact.

    A run's vectors are dealt to blocks of about `block`; each pair of blocks is one group and one matrix product, so a
    run with a third of all rows is many groups. vectors: (run_id, id, v), v of unit length, an array or as the sparse ones
    of text_vectors: those stay small on their way, and are dense inside a pair of blocks alone.
    """
    rows = _dealt(vectors.select("run_id", "id", "v"), block)
    kind = vectors.schema["id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group["a"].iloc[0], group["b"].iloc[0]
        left, right = group[group["part"] == a], group[group["part"] == b]
        out = []
        if len(left) and len(right):
            x, y = _matrix(left), _matrix(right)
            la, rb = left["id"].to_numpy(), right["id"].to_numpy()
            for at in range(0, len(x), 512):
                s = x[at : at + 512] @ y.T
                i, j = np.nonzero(s >= least)
                one, two = la[i + at], rb[j]
                keep = one < two if a == b else np.ones(len(i), bool)
                out.append(pd.DataFrame({"id_a": np.where(one < two, one, two)[keep], "id_b": np.where(one < two, two, one)[keep], "similarity": s[i, j][keep]}))
        found = pd.concat(out) if out else pd.DataFrame({"id_a": [], "id_b": [], "similarity": []})
        found.insert(0, "run_id", group["run_id"].iloc[0])
        return found

    return rows.groupBy("run_id", "a", "b").applyInPandas(run, f"run_id string, id_a {kind}, id_b {kind}, similarity double")


def similar_pairs_lsh(vectors: DataFrame, least: float = 0.85, seed: int = 42) -> DataFrame:
    """Like similar_pairs, by random projections and an exact check; recall is below 1. For very many vectors in one run."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    far = float(np.sqrt(2 * (1 - least)))
    rows = vectors.select("run_id", "id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("vec"))
    model = BucketedRandomProjectionLSH(inputCol="vec", outputCol="h", bucketLength=2 * far, numHashTables=8, seed=seed).fit(rows)
    met = model.approxSimilarityJoin(rows, rows, far, "d").where("datasetA.run_id = datasetB.run_id and datasetA.id < datasetB.id")
    return met.select(F.col("datasetA.run_id").alias("run_id"), F.col("datasetA.id").alias("id_a"), F.col("datasetB.id").alias("id_b"), (1 - F.col("d") * F.col("d") / 2).alias("similarity"))


def decide(pairs: DataFrame, tasks: DataFrame) -> DataFrame:
    """decision for each pair: keep_second or keep_first where one's words are among the other's, else merge."""
    words = F.array_distinct(F.split(F.lower(embedding_text(F.col("title"), F.col("short_description"))), r"\s+"))
    own = tasks.select("id", words.alias("w"))
    met = pairs.join(own.withColumnsRenamed({"id": "id_a", "w": "wa"}).hint("merge"), "id_a").join(own.withColumnsRenamed({"id": "id_b", "w": "wb"}).hint("merge"), "id_b")
    a_in_b, b_in_a = F.size(F.array_except("wa", "wb")) == 0, F.size(F.array_except("wb", "wa")) == 0
    return met.select("id_a", "id_b", F.when(b_in_a, F.lit("keep_first")).when(a_in_b, F.lit("keep_second")).otherwise(F.lit("merge")).alias("decision"))


def known_decisions(decisions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Decisions whose two ids are tasks."""
    return decisions.join(tasks.select(F.col("id").alias("id_a")).hint("merge"), "id_a", "left_semi").join(tasks.select(F.col("id").alias("id_b")).hint("merge"), "id_b", "left_semi")


def dropped(decisions: DataFrame) -> DataFrame:
    """(id, into): tasks that go, and the one that takes them in or stands for them."""
    second = decisions.where("decision in ('merge', 'keep_first')").select(F.col("id_b").alias("id"), F.col("id_a").alias("into"))
    first = decisions.where("decision = 'keep_second'").select(F.col("id_a").alias("id"), F.col("id_b").alias("into"))
    return second.unionByName(first)


def apply_decisions(tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Tasks that stay. One that merges others takes their lists, references, highest confidence and, where its own are empty, their first use_case and mockup; their ids come behind those it had merged before. Its flags stay its own."""
    sure = known_decisions(decisions, tasks)
    lists = ("acceptance_criteria", "considerations_constraints", "deliverables")
    for c, kind in (("source_refs", schemas.TASK["source_refs"].dataType), ("merged_from", "array<string>")):
        if c not in tasks.columns:
            tasks = tasks.withColumn(c, F.lit(None).cast(kind))
    part = tasks.select(F.col("id").alias("id_b"), *[F.col(c).alias(f"_{c}") for c in (*lists, "use_case", "mockup_prototype", "confidence", "source_refs")])
    first = {c: F.min_by(f"_{c}", F.when(F.coalesce(F.col(f"_{c}"), F.lit("")) != "", F.col("id_b"))) for c in ("use_case", "mockup_prototype")}
    in_order = F.array_sort(F.collect_list(F.struct("id_b", "_source_refs")))
    taken = sure.where("decision = 'merge'").join(part.hint("merge"), "id_b").groupBy(F.col("id_a").alias("id")).agg(
        *[F.flatten(F.collect_list(f"_{c}")).alias(f"_{c}") for c in lists], *[x.alias(f"_{c}") for c, x in first.items()], F.max("_confidence").alias("_confidence"),
        F.flatten(F.filter(F.transform(in_order, lambda x: x["_source_refs"]), lambda x: x.isNotNull())).alias("_source_refs"), F.array_sort(F.collect_set("id_b")).alias("_merged_from"),
    )
    stay = tasks.join(dropped(sure).select("id").distinct().hint("merge"), "id", "left_anti").join(taken.hint("merge"), "id", "left")
    for c in lists:
        both = F.array_sort(F.array_distinct(F.concat(F.coalesce(c, F.array().cast("array<string>")), F.col(f"_{c}"))))
        stay = stay.withColumn(c, F.when(F.coalesce(F.size(f"_{c}"), F.lit(0)) > 0, both).otherwise(F.col(c)))
    for c in ("use_case", "mockup_prototype"):
        stay = stay.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"), F.col(c)))
    for c in ("source_refs", "merged_from"):
        none = F.array().cast(stay.schema[c].dataType)
        stay = stay.withColumn(c, F.concat(F.coalesce(c, none), F.coalesce(f"_{c}", none)))
    stay = stay.withColumn("confidence", F.greatest("confidence", "_confidence")).withColumn("flags", F.array_distinct("flags"))
    return stay.drop(*[c for c in stay.columns if c.startswith("_")])


def merge_status(tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """All tasks; those that go have status MERGED and the ids that they went into."""
    gone = dropped(known_decisions(decisions, tasks)).groupBy("id").agg(F.array_sort(F.collect_set("into")).alias("merged_into"))
    return tasks.join(gone.hint("merge"), "id", "left").withColumn("status", F.when(F.col("merged_into").isNotNull(), F.lit("MERGED")).otherwise(F.col("status")))


def summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(run_id, started, after, removed)."""
    n = before.groupBy("run_id").agg(F.count("*").alias("started"))
    m = after.groupBy("run_id").agg(F.count("*").alias("after"))
    return n.join(m, "run_id", "left").select("run_id", "started", F.coalesce("after", F.lit(0)).alias("after"), (F.col("started") - F.coalesce("after", F.lit(0))).alias("removed"))


def union_recovered(tasks: DataFrame, recovered: DataFrame, decisions: DataFrame) -> DataFrame:
    """Tasks and those recovered later, deduplicated once more; earlier tasks stay before later ones."""
    return apply_decisions(tasks.unionByName(recovered, allowMissingColumns=True), decisions)


def recover_and_dedup(tasks: DataFrame, recovered: DataFrame, vectors, least: float = 0.85) -> DataFrame:
    """union_recovered with the decisions that vectors (a function of tasks to (run_id, id, v)) give over both."""
    both = tasks.unionByName(recovered, allowMissingColumns=True)
    return apply_decisions(both, decide(similar_pairs(vectors(both), least), both))


def dedup(tasks: DataFrame, vectors: DataFrame, least: float = 0.85) -> DataFrame:
    """Similar pairs, decisions, and the tasks that stay."""
    return apply_decisions(tasks, decide(similar_pairs(vectors, least), tasks))
