"""Tasks across the sections of a document: opened, continued, closed."""

from __future__ import annotations

import itertools
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow import schemas
from docflow.schemas import FLAGS
from docflow.sources.io import stored

LEAST_RATIO = 0.75
LISTS = ("acceptance_criteria", "considerations_constraints", "deliverables")
RAW = ("doc_id", "node_id", "pos", "ord", "id", "title", "short_description", *LISTS, "use_case", "mockup_prototype", "confidence", "flags", "continues_to_next", "section_title", "page_start", "page_end")
OUT = ("task_id", "title", "short_description", *LISTS, "use_case", "mockup_prototype", "confidence", "flags", "status", "opened_at", "closed_at", "node_ids", "source_refs")
RESULT = (
    "doc_id string, task_id string, title string, short_description string, acceptance_criteria array<string>, considerations_constraints array<string>, deliverables array<string>, use_case string, mockup_prototype string, "
    "confidence double, flags array<string>, status string, opened_at string, closed_at string, node_ids array<string>, source_refs array<struct<node_id: string, section_title: string, page_start: int, page_end: int, snippet: string>>"
)


def title_ratio(a: str, b: str) -> float:
    """difflib's ratio of lower-cased titles; the order of the two matters."""
    return SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio()


def _items(values) -> list:
    """A list of a column's array, which may be missing."""
    return [] if values is None or isinstance(values, float) else list(values)


def _text(value):
    return value if isinstance(value, str) else None


def _number(value) -> int | None:
    return None if value is None or value != value else int(value)


class Lifecycle:
    """The open tasks of one document. step() takes a node's raw tasks and returns what closes there; end() closes the rest.

    A raw task continues the open task with the best title ratio among those that expect to be continued. After a node
    the open tasks are those that still wait, then those of the node in its order, which decides later ties.
    """

    def __init__(self, open_tasks: list[dict] | None = None):
        self.open = open_tasks or []

    def _continued(self, raw: dict) -> dict | None:
        rated = [(title_ratio(raw["title"], t["title"]), -i, t) for i, t in enumerate(self.open) if t["continues"]]
        rated = [r for r in rated if r[0] >= LEAST_RATIO]
        return max(rated, key=lambda r: r[:2])[2] if rated else None

    @staticmethod
    def _reference(node_id: str, raw: dict) -> dict:
        return {"node_id": node_id, "section_title": _text(raw.get("section_title")), "page_start": _number(raw.get("page_start")), "page_end": _number(raw.get("page_end")), "snippet": ""}

    def _opened(self, node_id: str, raw: dict) -> dict:
        return {
            "task_id": raw["id"], "title": raw["title"], "short_description": _text(raw["short_description"]) or "", **{c: _items(raw.get(c)) for c in LISTS}, "use_case": _text(raw.get("use_case")),
            "mockup_prototype": _text(raw.get("mockup_prototype")), "confidence": raw["confidence"], "flags": [f for f in _items(raw["flags"]) if f in FLAGS], "continues": bool(raw["continues_to_next"]), "status": "OPEN",
            "opened_at": node_id, "closed_at": None, "node_ids": [node_id], "source_refs": [self._reference(node_id, raw)],
        }

    def step(self, node_id: str, raws: list[dict]) -> list[dict]:
        here: dict[str, dict] = {}  # tasks of this node by id, in the order in which they came
        for raw in raws:
            task = self._continued(raw)
            if task is None:
                here[raw["id"]] = self._opened(node_id, raw)
                continue
            here.setdefault(task["task_id"], task)
            task["short_description"] = f"{task['short_description']} {_text(raw['short_description']) or ''}"
            for c in LISTS:
                if _items(raw.get(c)):
                    task[c] = sorted({*task[c], *_items(raw.get(c))})
            task["confidence"] = max(task["confidence"], raw["confidence"])
            task["flags"] += [f for f in dict.fromkeys(_items(raw["flags"])) if f in FLAGS and f not in task["flags"]]
            task["continues"] = bool(raw["continues_to_next"])
            task["mockup_prototype"] = task["mockup_prototype"] or _text(raw.get("mockup_prototype"))
            task["node_ids"].append(node_id)
            task["source_refs"].append(self._reference(node_id, raw))
        closed, waiting = [], []
        for task in self.open:
            if task["task_id"] in here:
                continue
            if task["continues"]:
                if "INCOMPLETE" not in task["flags"]:
                    task["flags"].append("INCOMPLETE")
                waiting.append(task)
            else:
                closed.append(task | {"status": "CLOSED", "closed_at": node_id})
        self.open = waiting + list(here.values())
        return closed

    def end(self) -> list[dict]:
        out = [t | {"status": "CLOSED", "flags": [*t["flags"], *["INCOMPLETE"] * ("INCOMPLETE" not in t["flags"])]} for t in self.open]
        self.open = []
        return out


def frame_of(doc_id: str, closed: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(closed, columns=list(OUT))
    frame.insert(0, "doc_id", doc_id)
    return frame


def _raw_columns(df: DataFrame) -> list[Column]:
    """The columns that a lifecycle reads; what isn't there is null."""
    kinds = {f.name: f.dataType for f in schemas.RAW_TASK.fields} | {"section_title": "string", "page_start": "int", "page_end": "int"}
    return [F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in RAW]


def _not_continued(raws: DataFrame) -> DataFrame:
    """What Lifecycle gives for documents of which no raw task expects to be continued: each is a task of its own that closes at the next node. raws has rank and next, its node's place and the node behind it.

    As there, a task gives way to one of its id at the same node or the next.
    """
    later = F.lead("rank").over(W.partitionBy("doc_id", "id").orderBy("rank", "ord"))
    kept = raws.where("id is not null").withColumn("_later", later).where("_later is null or _later > rank + 1")
    known = F.filter(F.coalesce("flags", F.array().cast("array<string>")), lambda f: f.isin(*FLAGS))
    end = F.col("next").isNull() & ~F.array_contains(known, "INCOMPLETE")
    ref = F.struct("node_id", "section_title", "page_start", "page_end", F.lit("").alias("snippet"))
    return kept.select(
        "doc_id", F.col("id").alias("task_id"), "title", F.coalesce("short_description", F.lit("")).alias("short_description"), *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in LISTS], "use_case", "mockup_prototype",
        F.col("confidence").cast("double").alias("confidence"), F.when(end, F.concat(known, F.array(F.lit("INCOMPLETE")))).otherwise(known).alias("flags"), F.lit("CLOSED").alias("status"),
        F.col("node_id").alias("opened_at"), F.col("next").alias("closed_at"), F.array("node_id").alias("node_ids"), F.array(ref).alias("source_refs"),
    )


def task_lifecycle(raws: DataFrame, nodes: DataFrame) -> DataFrame:
    """All tasks of all documents, closed, with all their fields and a reference to each section that they come from. raws: (doc_id, node_id, ord, id, title, ...); nodes: (doc_id, node_id, pos, and title, page_start, page_end where known), also those without raw tasks.

    Where a raw task expects to be continued, its document is one group: the state is what is open, so documents run side
    by side and not a document's nodes. All other documents have no such state, and go by windows.
    """
    about = [F.col(c).cast(k).alias(n) for c, k, n in (("title", "string", "section_title"), ("page_start", "int", "page_start"), ("page_end", "int", "page_end")) if c in nodes.columns]
    own = raws.drop("pos", "section_title", "page_start", "page_end")
    order = W.partitionBy("doc_id").orderBy("pos", "node_id")
    at = nodes.select("doc_id", "node_id", "pos", *about).where("pos is not null and node_id is not null").dropDuplicates(["doc_id", "pos", "node_id"])
    at = at.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("node_id").over(order))
    rows = at.join(own.hint("merge"), ["doc_id", "node_id"], "left")
    rows = stored(rows.select(*_raw_columns(rows), "rank", "next"), "raw_tasks")
    open_docs = stored(rows.where("id is not null and continues_to_next").select("doc_id").distinct(), "open_docs")
    if open_docs.isEmpty():
        return _not_continued(rows)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        state, out = Lifecycle(), []
        records = group.sort_values(["rank", "ord"]).to_dict("records")
        for _, part in itertools.groupby(records, lambda r: r["rank"]):
            part = list(part)
            out += state.step(part[0]["node_id"], [r for r in part if isinstance(r["id"], str)])
        return frame_of(group["doc_id"].iloc[0], out + state.end())

    continued = rows.join(open_docs.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").applyInPandas(run, RESULT)
    return _not_continued(rows.join(open_docs.hint("merge"), "doc_id", "left_anti")).unionByName(continued)


def lifecycle_simple(raws: DataFrame, nodes: DataFrame) -> DataFrame:
    """The case without continuations, by a window: a task closes at the next node; the last node's tasks are INCOMPLETE."""
    nxt = F.lead("node_id").over(W.partitionBy("doc_id").orderBy("pos"))
    ends = nodes.select("doc_id", "node_id", nxt.alias("closed_at"))
    met = raws.join(ends.hint("merge"), ["doc_id", "node_id"])
    flags = F.when(F.col("closed_at").isNull(), F.array_union("flags", F.array(F.lit("INCOMPLETE")))).otherwise(F.col("flags"))
    return met.withColumn("flags", flags).withColumn("status", F.lit("CLOSED"))


def best_title_match(raws: DataFrame, open_tasks: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """(doc_id, raw_id, task_id, ratio): for each raw task the open task of its document with the best title ratio, the earlier of equals. open_tasks: (doc_id, task_id, pos, title).

    Titles whose lengths alone rule the ratio out never reach Python.
    """

    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([title_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    own = raws.select("doc_id", F.col("id").alias("raw_id"), F.col("title").alias("_a"))
    met = own.join(open_tasks.select("doc_id", "task_id", "pos", F.col("title").alias("_b")), "doc_id")
    n, m = F.length("_a"), F.length("_b")
    met = met.where(2.0 * F.least(n, m) >= least * (n + m))
    rated = met.withColumn("ratio", F.pandas_udf(ratios, "double")("_a", "_b")).where(F.col("ratio") >= least)
    first = F.row_number().over(W.partitionBy("doc_id", "raw_id").orderBy(F.desc("ratio"), "pos"))
    return rated.withColumn("_n", first).where("_n = 1").select("doc_id", "raw_id", "task_id", "ratio")


def promote(raws: DataFrame, nodes: DataFrame) -> DataFrame:
    """Raw tasks as managed ones: OPEN, with one reference to the section."""
    ref = F.array(F.struct(F.col("node_id"), F.col("section_title"), F.col("page_start"), F.col("page_end"), F.lit("").alias("snippet")))
    own = nodes.select("doc_id", "node_id", F.col("title").alias("section_title"), "page_start", "page_end")
    return raws.join(own.hint("merge"), ["doc_id", "node_id"]).withColumn("source_refs", ref).withColumn("status", F.lit("OPEN")).drop("section_title", "page_start", "page_end")


def continue_merge(pairs: DataFrame) -> DataFrame:
    """One row an open task (id, position of its parts in ord): descriptions joined in order, lists united, known flags, highest confidence, last continues flag, the first part's use_case, first mockup, all references in order."""
    seq = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("short_description", F.lit("")).alias("d"))))
    refs = F.array_sort(F.collect_list(F.struct("ord", "source_refs")))
    known = F.array(*[F.lit(f) for f in FLAGS])
    return pairs.groupBy("doc_id", "id").agg(
        F.min_by("title", "ord").alias("title"),
        F.array_join(F.transform(seq, lambda x: x["d"]), " ").alias("short_description"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in LISTS],
        F.min_by("use_case", "ord").alias("use_case"),
        F.max("confidence").alias("confidence"),
        F.array_sort(F.array_intersect(F.array_distinct(F.flatten(F.collect_list("flags"))), known)).alias("flags"),
        F.max_by("continues_to_next", "ord").alias("continues_to_next"),
        F.min_by("mockup_prototype", F.when(F.coalesce("mockup_prototype", F.lit("")) != "", F.col("ord"))).alias("mockup_prototype"),
        F.flatten(F.filter(F.transform(refs, lambda x: x["source_refs"]), lambda x: x.isNotNull())).alias("source_refs"),
    )
