"""Sections from markdown lines and from parsed layout elements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.functions import text as T
from docflow.operators import tree
from docflow.sources.io import stored


def markdown_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line) of docs (doc_id, content)."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("pos", "line"))


def outside_fences(lines: DataFrame) -> DataFrame:
    """lines with fenced: whether the line is or lies in a fenced block (an odd number of fence lines so far)."""
    so_far = F.sum(T.is_fence(F.col("line")).cast("int")).over(tree.in_order())
    return lines.withColumn("fenced", (so_far % 2 == 1) | T.is_fence(F.col("line")))


def markdown_nodes(docs: DataFrame, ends: Callable[[Column], Column] = T.stripped) -> DataFrame:
    """Headings with level and the text from the heading to the next one, its ends by a function; text before the first heading is left out."""
    lines = outside_fences(markdown_lines(docs)).withColumn("level", F.when(~F.col("fenced"), T.heading_level(F.col("line"))).otherwise(F.lit(0)))
    runs = lines.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(tree.in_order())).where("section > 0")
    per = runs.groupBy("doc_id", "section").agg(F.min_by("level", "pos").alias("level"), F.min_by("line", "pos").alias("_head"), F.min("pos").alias("line_no"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l"))
    return per.select("doc_id", F.col("section").alias("pos"), "level", T.heading_title(F.col("_head")).alias("title"), (F.col("line_no") + 1).alias("line_num"), ends(F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).alias("text"))


def markdown_tree(docs: DataFrame, least_tokens: int = 0) -> DataFrame:
    """Nodes with ids, parents and token counts; branches under least_tokens are thinned."""
    nodes = tree.node_numbering(markdown_nodes(docs)).withColumn("n_tokens", T.token_count(F.col("text")).cast("long"))
    if least_tokens:
        nodes = tree.node_numbering(tree.tree_thinning(stored(nodes, "sections"), least_tokens)).withColumn("n_tokens", T.token_count(F.col("text")).cast("long"))
    return tree.parents(nodes)


def section_runs(elements: DataFrame, most_level: int = 3) -> DataFrame:
    """Sections of elements (doc_id, pos, type, level, page, id, content, and rows of tables): a heading of a low level opens one; what comes first is "Preamble".

    A section's text is that of its paragraphs, lists and captions and its tables as pipe tables; a table without rows counts by its content.
    """
    opens = (F.col("type") == "heading") & (F.col("level") <= most_level)
    rows = elements.withColumn("_opens", opens).withColumn("section", F.sum(opens.cast("int")).over(tree.in_order()))
    rendered = F.nullif(T.table_markdown(T.table_rows(elements)), F.lit(""))
    rows = rows.withColumn("_said", F.when(F.col("type") == "table", F.coalesce(rendered, "content")).when(F.col("type") != "heading", F.col("content")))
    said = F.when(T.stripped(F.coalesce("_said", F.lit(""))) != "", F.struct("pos", F.col("_said").alias("content")))
    per = rows.groupBy("doc_id", "section").agg(
        F.coalesce(F.min_by(F.when(F.col("_opens"), F.col("content")), "pos"), F.lit("Preamble")).alias("heading"),
        F.min_by("page", "pos").alias("page_start"),
        F.max_by("page", "pos").alias("page_end"),
        F.array_sort(F.collect_list(said)).alias("_t"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("element_ids"),
    )
    return per.select("doc_id", "section", "heading", "page_start", "page_end", F.array_join(F.transform("_t", lambda x: x["content"]), "\n\n").alias("text"), "element_ids").where("text <> ''")


def skip_sections(sections: DataFrame, skip: list[str], heading: str = "heading", text: str = "text") -> DataFrame:
    """Sections whose heading holds none of the words to skip, and whose text isn't blank."""
    bad = F.lit(False)
    for word in skip:
        bad = bad | F.contains(F.lower(F.coalesce(heading, F.lit(""))), F.lit(word.lower()))
    return sections.where(~bad & (T.stripped(F.coalesce(text, F.lit(""))) != ""))


def flat_elements(raw: DataFrame) -> DataFrame:
    """Elements of nested kids (doc_id, kids) of any depth: (doc_id, path, type, content, ...), path the order of reading; five types are kept."""
    kinds = ("heading", "paragraph", "table", "list", "caption")
    found = tree.opened(raw, "kids")
    found = found.select(*[F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in found.columns])
    return found.where(F.col("type").isin(*kinds)).withColumn("pos", F.row_number().over(W.partitionBy("doc_id").orderBy("path")))
