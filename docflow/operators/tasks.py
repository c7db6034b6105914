"""Work items from sections: filters before the costly step, a rule extractor, a pluggable model step, and checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow import schemas
from docflow.functions import text as T

# The verbs that a task's title may begin with.
VERBS = ("Create", "Implement", "Design", "Configure", "Integrate", "Build", "Set up", "Develop", "Define", "Write")
MODAL = r"(?i)(?:^|[^\p{L}\p{N}])(?:must|shall|should|will|needs? to|has to|have to)(?:[^\p{L}\p{N}]|$)"


def long_enough(sections: DataFrame, least: int = 50) -> DataFrame:
    return sections.where(F.length(T.stripped(F.coalesce("text", F.lit("")))) >= least)


def too_short(sections: DataFrame, least: int = 50) -> DataFrame:
    """Audit rows for what long_enough leaves out."""
    gone = sections.where(F.length(T.stripped(F.coalesce("text", F.lit("")))) < least)
    return gone.select("doc_id", "node_id", F.lit("SKIPPED_SHORT_SECTION").alias("action"), F.length(T.stripped(F.coalesce("text", F.lit("")))).alias("n_chars"))


def cut_text(sections: DataFrame, most: int = 16000, notice: bool = True) -> DataFrame:
    """Longer texts are cut, with a notice that names the section and its pages."""
    said = F.format_string("\n\n[Section '%s' (pages %d-%d) was cut here]", F.coalesce("title", F.lit("")), F.coalesce("page_start", F.lit(0)), F.coalesce("page_end", F.lit(0)))
    short = F.substring("text", 1, most)
    return sections.withColumn("text", F.when(F.length("text") > most, F.concat(short, said) if notice else short).otherwise(F.col("text")))


def low_confidence(tasks: DataFrame, least: float = 0.6) -> DataFrame:
    flagged = F.array_union(F.coalesce("flags", F.array().cast("array<string>")), F.array(F.lit("LOW_CONFIDENCE")))
    return tasks.withColumn("flags", F.when(F.col("confidence") < least, flagged).otherwise(F.col("flags")))


def known_flags(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("flags", F.array_intersect("flags", F.array(*[F.lit(f) for f in schemas.FLAGS])))


def node_budget(nodes: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes of documents within the budget, one row for each document beyond it)."""
    over = nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes")).where(F.col("n_nodes") > most)
    return nodes.join(over.select("doc_id"), "doc_id", "left_anti"), over


def rule_checks(tasks: DataFrame) -> DataFrame:
    """A Boolean for each rule of a valid task."""
    verbs = "^(?:" + "|".join(VERBS) + r")\b"
    return tasks.select(
        "*",
        F.coalesce(F.regexp_like("title", F.lit(verbs)), F.lit(False)).alias("verb_first"),
        F.coalesce(F.length("title") <= 80, F.lit(False)).alias("title_short"),
        F.coalesce(F.forall("acceptance_criteria", lambda x: F.startswith(x, F.lit("[ ] "))), F.lit(True)).alias("criteria_listed"),
        F.coalesce(F.col("confidence").between(0, 1), F.lit(False)).alias("confidence_valid"),
    )


def read_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw tasks, audit rows of what couldn't be read) from a model's answers (doc_id, node_id, content)."""
    body = T.json_repair(F.col("content"))
    read = answers.withColumn("_j", body).withColumn("_a", F.from_json("_j", "array<string>"))
    listed = F.startswith(F.col("_j"), F.lit("[")) & F.col("_a").isNotNull()
    rows = read.where(listed).select("doc_id", "node_id", F.posexplode("_a").alias("ord", "_s")).withColumn("t", F.from_json("_s", schemas.RAW_TASK))
    valid = F.col("t").isNotNull() & F.col("t.title").isNotNull() & F.col("t.short_description").isNotNull() & F.col("t.confidence").between(0.0, 1.0)
    good = rows.where(valid).select("doc_id", "node_id", "ord", "t.*")
    bad = rows.where(~F.coalesce(valid, F.lit(False))).select("doc_id", "node_id", F.lit("TASK_PARSE_ERROR").alias("action"))
    worse = read.where(~F.coalesce(listed, F.lit(False))).select("doc_id", "node_id", F.lit("EXTRACTION_ERROR").alias("action"))
    return good, bad.unionByName(worse)


def prompt(template: str, hierarchies: dict[str, str]) -> Column:
    """The template with section, pages, text and what the hierarchy asks for; unknown hierarchies read as epic_task."""
    known = F.create_map(*[F.lit(x) for pair in hierarchies.items() for x in pair])
    context = F.coalesce(F.try_element_at(known, F.col("hierarchy")), F.try_element_at(known, F.lit("epic_task")))
    return F.format_string(template, F.coalesce("title", F.lit("")), F.coalesce("page_start", F.lit(0)), F.coalesce("page_end", F.lit(0)), context, F.coalesce("text", F.lit("")))


def extract_rules(sections: DataFrame, verbs: tuple[str, ...] = VERBS) -> DataFrame:
    """Raw tasks by rule: sentences that begin with a verb of the list or hold a modal verb; lines of criteria below a text go to its tasks.

    A title is made of at most 80 characters; confidence is 0.9 with a leading verb and 0.5 else. Lines that name a field
    (use case, constraints, deliverables, mockup) fill it in every task of their section and are no sentences of their own.
    """
    named = {
        "use_case": r"(?i)^\s*use cases?\s*:\s*",
        "considerations_constraints": r"(?i)^\s*(?:considerations?|constraints?)\s*:\s*",
        "deliverables": r"(?i)^\s*deliverables?\s*:\s*",
        "mockup_prototype": r"(?i)^\s*(?:mock-?ups?|prototypes?)\s*:\s*",
    }
    def field(pattern: str) -> Column:
        return F.transform(F.filter("_lines", lambda x: F.regexp_like(x, F.lit(pattern))), lambda x: T.stripped(F.regexp_replace(x, pattern, "")))

    said = {k: field(p) for k, p in named.items()}
    said = {k: F.nullif(F.get(c, F.lit(0)), F.lit("")) if k in ("use_case", "mockup_prototype") else F.when(F.size(c) > 0, F.filter(c, lambda x: x != "")) for k, c in said.items()}
    any_field = "(?i)" + "|".join(p.removeprefix("(?i)") for p in named.values())
    prose = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~F.regexp_like(x, F.lit(any_field))), "\n")
    verb = r"(?i)^(?:" + "|".join(verbs) + r")(?:[^\p{L}\p{N}]|$)"
    criteria = F.transform(F.filter("_lines", lambda x: F.startswith(F.ltrim(x), F.lit("[ ] "))), T.stripped)
    # what a section has once is made before there are rows of its sentences, and only sentences that are tasks become rows
    once = sections.withColumn("_lines", T.text_rows(F.col("text"))).select("doc_id", "node_id", "pos", F.struct(criteria.alias("c"), *[c.alias(k) for k, c in said.items()]).alias("_once"), T.sentences(prose).alias("_said"))
    placed = F.transform("_said", lambda x, i: F.struct(i.alias("ord"), x.alias("s"), F.regexp_like(x, F.lit(verb)).alias("led")))
    hits = once.withColumn("_hits", F.filter(placed, lambda x: x["led"] | F.regexp_like(x["s"], F.lit(MODAL)))).select("doc_id", "node_id", "pos", "_once", F.inline("_hits"))
    c = F.col("_once.c")
    return hits.select(
        "doc_id",
        "node_id",
        "pos",
        "ord",
        F.substring("s", 1, 80).alias("title"),
        F.col("s").alias("short_description"),
        F.when(F.size(c) > 0, c).alias("acceptance_criteria"),
        *[F.col(f"_once.{k}").alias(k) for k in named],
        F.when(F.col("led"), 0.9).otherwise(0.5).alias("confidence"),
        F.when(F.size(c) > 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("NO_ACCEPTANCE_CRITERIA"))).alias("flags"),
        F.endswith(T.stripped(F.col("s")), F.lit("…")).alias("continues_to_next"),
    )


def model_step(rows: DataFrame, answer: Callable[[list[str]], list[str]], prompt_col: str = "prompt", keys: tuple[str, ...] = ("doc_id", "node_id")) -> DataFrame:
    """keys, content, error: answer's texts for the prompts, batch by batch. A failing batch becomes rows with an error, not an exception."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[list(keys)].copy()
            try:
                out["content"], out["error"] = answer(batch[prompt_col].tolist()), None
            except Exception as e:  # a row, as callers count failures
                out["content"], out["error"] = None, str(e)[:500]
            yield out

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, prompt_col).mapInPandas(run, f"{kinds}, content string, error string")


def with_ids(raw: DataFrame) -> DataFrame:
    """id: a digest of document, node and place, so that runs agree."""
    return raw.withColumn("id", F.substring(F.sha2(F.concat_ws("\x1f", "doc_id", "node_id", F.col("ord").cast("string")), 256), 1, 32))
