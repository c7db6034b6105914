"""Section trees as flat rows: nodes(doc_id, node_id, pos, level, title, page_start, page_end, ...), pos in document order.

Every operator works for all documents at once, by windows and equi-joins on doc_id; a document's nodes are what one
window holds. Null page numbers, texts and titles take the defaults that each operator names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.sources.io import stored


def in_order():
    """A document's nodes in order. Windows are made in functions: importing a module needs no session."""
    return W.partitionBy("doc_id").orderBy("pos")


def before():
    return in_order().rowsBetween(W.unboundedPreceding, -1)


def after():
    return in_order().rowsBetween(1, W.unboundedFollowing)


def flatten_nodes(nodes: DataFrame) -> DataFrame:
    """Flat nodes with page_start and page_end for start_index and end_index, and defaults for what is missing."""
    return nodes.select(
        "doc_id", "pos", F.coalesce("node_id", F.lit("")).alias("node_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("start_index", F.lit(1)).alias("page_start"),
        F.coalesce("end_index", F.lit(1)).alias("page_end"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("text", F.lit("")).alias("text"),
    )


#: Levels of nested arrays that are opened in one job.
OPENED = 6


def opened(trees: DataFrame, children: str) -> DataFrame:
    """(doc_id, path, and the fields of a node) for every node of trees (doc_id, and children: an array of structs that hold such an array again); path has the node's place in each array from the top.

    Level by level, as deep as the schema goes (that of JSON files is as deep as they are) or until a level has no rows;
    after every OPENED levels what is left is written, so plans stay small. Fields that a level lacks are null.
    """
    level = trees.select("doc_id", F.posexplode(children).alias("_i", "n")).select("doc_id", F.array("_i").alias("path"), "n")
    found, depth = None, 0
    while True:
        fields, depth = level.schema["n"].dataType.names, depth + 1
        own = level.select("doc_id", "path", *[F.col(f"n.`{f}`").alias(f) for f in fields if f != children])
        found = own if found is None else found.unionByName(own, allowMissingColumns=True)
        if children not in fields:
            return found
        level = level.select("doc_id", "path", F.posexplode(f"n.`{children}`").alias("_i", "k")).select("doc_id", F.concat("path", F.array("_i")).alias("path"), F.col("k").alias("n"))
        if depth % OPENED == 0:
            level = stored(level, "opened")
            if level.isEmpty():
                return found


def nested_nodes(trees: DataFrame, children: str = "nodes") -> DataFrame:
    """Flat pre-order nodes (doc_id, pos, parent_pos, level, and the fields of a node) of trees (doc_id, nodes: an array of structs that hold such an array again), of any depth."""
    found = opened(trees, children).withColumnRenamed("path", "_path")
    order = W.partitionBy("doc_id").orderBy("_path")
    rows = found.withColumn("pos", F.row_number().over(order)).withColumn("level", F.size("_path"))
    ups = rows.select("doc_id", F.col("_path").alias("_up"), F.col("pos").alias("parent_pos"))
    rows = rows.withColumn("_up", F.slice("_path", 1, F.size("_path") - 1))
    return rows.join(ups.hint("merge"), ["doc_id", "_up"], "left").drop("_path", "_up")


def drop_children(nodes: DataFrame) -> DataFrame:
    return nodes.drop("nodes")


def leaf_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that are no node's parent."""
    parents = nodes.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id")).distinct()
    return nodes.join(parents, ["doc_id", "node_id"], "left_anti")


def remove_fields(df: DataFrame, *names: str) -> DataFrame:
    """Without the named fields, at the top and inside structs and arrays of structs."""
    from pyspark.sql import types as T

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name not in names])
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        return c

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in names])


def select_order(df: DataFrame, order: list[str]) -> DataFrame:
    """The columns of order that there are, in that order."""
    return df.select(*[c for c in order if c in df.columns])


def node_numbering(nodes: DataFrame) -> DataFrame:
    """node_id: four digits from 0000 in document order."""
    return nodes.withColumn("node_id", F.lpad((F.row_number().over(in_order()) - 1).cast("string"), 4, "0"))


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, pos, level, node_id, n_tokens), sorted, to (doc_id, pos, parent_id, subtree_end, branch_tokens).

    The nodes whose branch is still open, of rising levels, are what is held: a stack as deep as the tree.
    """
    doc, last, stack, kinds = None, None, [], None

    def closed(end: int) -> tuple:
        pos, _, _, parent, tokens = stack.pop()
        if stack:
            stack[-1][4] += tokens
        return doc, pos, parent, end, tokens

    def out(rows: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "pos", "parent_id", "subtree_end", "branch_tokens"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        rows = []
        kinds = (batch.column(0).type, pa.int64(), batch.column(3).type, pa.int64(), pa.int64())
        for d, pos, level, node, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            while stack and (d != doc or stack[-1][1] >= level):
                rows.append(closed(last if d != doc else pos - 1))
            doc, last = d, pos
            stack.append([pos, level, node, stack[-1][2] if stack else None, tokens])
        if rows:
            yield out(rows)
    if stack:
        yield out([closed(last) for _ in range(len(stack))])


def branches(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, parent_id, subtree_end, branch_tokens) of nodes of any levels: the nearest earlier node of a lower level, the last position of the branch, and the tokens in it (n_tokens, if there).

    One narrow sort by document and position, read as a stream; levels may be skipped and go to any depth. A null level is
    1, null tokens are 0. Positions are unique in a document.
    """
    tokens = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")) if "n_tokens" in nodes.columns else F.lit(0).cast("long")
    own = nodes.select("doc_id", F.col("pos").cast("long").alias("pos"), F.coalesce(F.col("level").cast("long"), F.lit(1).cast("long")).alias("level"), "node_id", tokens.alias("n_tokens"))
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    found = own.repartition("doc_id").sortWithinPartitions("doc_id", "pos").mapInArrow(_branches, f"doc_id {kinds['doc_id']}, pos long, parent_id {kinds['node_id']}, subtree_end long, branch_tokens long")
    return found.withColumn("pos", F.col("pos").cast(kinds["pos"])).withColumn("subtree_end", F.col("subtree_end").cast(kinds["pos"]))


def _with_branches(nodes: DataFrame, *columns: str) -> DataFrame:
    return nodes.drop(*columns).join(branches(nodes).select("doc_id", "pos", *columns).hint("merge"), ["doc_id", "pos"], "left")


def parents(nodes: DataFrame) -> DataFrame:
    """parent_id: the nearest earlier node of a lower level."""
    return _with_branches(nodes, "parent_id")


def subtree_ends(nodes: DataFrame) -> DataFrame:
    """subtree_end: the last position of the node's branch."""
    return _with_branches(nodes, "subtree_end")


def subtree_tokens(nodes: DataFrame) -> DataFrame:
    """subtree_end, and branch_tokens: tokens of the node and everything below it."""
    return _with_branches(nodes, "subtree_end", "branch_tokens")


def tree_thinning(nodes: DataFrame, least: int) -> DataFrame:
    """Nodes whose branch has fewer than least tokens take in the texts below them; those below are gone.

    Who takes in whom is told without texts; those then meet it once, and only texts that are put together go on to their
    node. nodes is read twice: what is costly to make is better written before.
    """
    told = branches(nodes).withColumn("small", F.col("branch_tokens") < least)
    # a node is gone if an earlier small node's branch reaches it
    reach = F.max(F.when(F.col("small"), F.col("subtree_end"))).over(before())
    told = told.withColumn("_gone", F.coalesce(reach >= F.col("pos"), F.lit(False)))
    told = told.withColumn("_owner", F.last(F.when(~F.col("_gone"), F.col("pos")), True).over(in_order()))
    told = told.withColumn("_own", F.count("*").over(W.partitionBy("doc_id", "_owner")))
    told = told.select("doc_id", "pos", "subtree_end", "branch_tokens", "small", "_gone", "_owner", "_own")
    met = stored(nodes.drop("subtree_end", "branch_tokens").join(told.hint("merge"), ["doc_id", "pos"]), "thinning")
    said = F.trim(F.coalesce("text", F.lit("")))
    texts = met.where("_own > 1 and text is not null").where(said != "").groupBy("doc_id", F.col("_owner").alias("pos")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("text")))), lambda x: x["text"]), "\n\n").alias("branch_text")
    )
    kept = met.where(~F.col("_gone")).withColumn("text", F.when(F.col("small"), said).otherwise(F.col("text")))
    full = kept.where("small and _own > 1").drop("text").join(texts.hint("merge"), ["doc_id", "pos"], "left").withColumn("text", F.coalesce("branch_text", F.lit(""))).drop("branch_text")
    return kept.where("not small or _own = 1").unionByName(full).drop("small", "_gone", "_owner", "_own")


def tree_parents(toc: DataFrame) -> DataFrame:
    """parent_pos: the latest earlier item whose structure code is this one's without its last part; null where there is none."""
    code = F.nullif(F.regexp_extract("structure", r"^(.*)\.[^.]+$", 1), F.lit(""))
    rows = toc.withColumn("_above", code)
    up = toc.select("doc_id", F.col("structure").alias("_above"), F.col("pos").alias("_pos"))
    found = rows.join(up, ["doc_id", "_above"]).where(F.col("_pos") < F.col("pos")).groupBy("doc_id", "pos").agg(F.max("_pos").alias("parent_pos"))
    return toc.join(found, ["doc_id", "pos"], "left")


def assign_ranges(toc: DataFrame, n_pages: str = "n_pages") -> DataFrame:
    """page_start and page_end: to the next item's page, or the page before it if that item begins its page; the last item to the end."""
    next_page, next_top = F.lead("physical_index").over(in_order()), F.lead("appear_start").over(in_order())
    end = F.when(next_page.isNull(), F.col(n_pages)).when(next_top, F.greatest(next_page - 1, F.col("physical_index"))).otherwise(next_page)
    return toc.withColumn("page_start", F.col("physical_index")).withColumn("page_end", end)


def node_texts(nodes: DataFrame, pages: DataFrame, labelled: bool = False) -> DataFrame:
    """text: the pages from page_start to page_end. An equi-join on document and page; a node's range is one row a page."""
    from docflow.functions.text import page_tag

    text = page_tag(F.col("page_no"), F.coalesce("_text", F.lit(""))) if labelled else F.coalesce("_text", F.lit(""))
    reach = nodes.where("page_start <= page_end").select("doc_id", "node_id", F.explode(F.sequence("page_start", "page_end")).alias("page_no"))
    met = reach.join(pages.select("doc_id", "page_no", F.col("text").alias("_text")).hint("merge"), ["doc_id", "page_no"])
    said = met.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("page_no", text.alias("t")))).alias("_rows"))
    said = said.select("doc_id", "node_id", F.array_join(F.transform("_rows", lambda x: x["t"]), "").alias("text"))
    return nodes.drop("text").join(said.hint("merge"), ["doc_id", "node_id"], "left")


def preface_rows(toc: DataFrame) -> DataFrame:
    """toc with a first item "Preface" on page 1 where a document's first item starts later."""
    first = toc.groupBy("doc_id").agg(F.min_by("physical_index", "pos").alias("p"), F.min("pos").alias("pos"))
    extra = first.where("p > 1").select("doc_id", (F.col("pos") - 1).alias("pos"), F.lit("0").alias("structure"), F.lit("Preface").alias("title"), F.lit(1).alias("physical_index"))
    return toc.select("doc_id", "pos", "structure", "title", "physical_index").unionByName(extra)


def text_fallback(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """text: the node's, else that of the same node in tree, else the summary."""
    other = tree.select("doc_id", "node_id", F.col("text").alias("_text"))
    return nodes.join(other, ["doc_id", "node_id"], "left").withColumn("text", F.coalesce(F.nullif("text", F.lit("")), F.nullif("_text", F.lit("")), "summary")).drop("_text")


def outline(nodes: DataFrame, levels: int = 1) -> DataFrame:
    """One row a document: its titles of the first levels, joined."""
    rows = nodes.where(F.col("level") <= levels).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("t"))
    return rows.select("doc_id", F.array_join(F.transform("t", lambda x: x["title"]), "; ").alias("description"))


def node_summary(nodes: DataFrame, least_tokens: int = 200, keep: int = 2) -> DataFrame:
    """summary for leaves, prefix_summary for others: the text if short, else its first sentences."""
    from docflow.functions.text import sentences, token_count

    short = F.when(token_count(F.col("text")) < least_tokens, F.col("text")).otherwise(F.array_join(F.slice(sentences(F.col("text")), 1, keep), ". "))
    up = nodes.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id"), F.lit(True).alias("_inner")).distinct()
    marked = nodes.join(up, ["doc_id", "node_id"], "left")
    return marked.withColumn("prefix_summary", F.when(F.col("_inner"), short)).withColumn("summary", F.when(F.col("_inner").isNull(), short)).drop("_inner")


def token_totals(pages: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_tokens)."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum("n_tokens").alias("n_tokens"))


def token_limit_report(nodes: DataFrame, most: int = 110000) -> DataFrame:
    return nodes.where(F.col("n_tokens") > most)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, page_no, tokens, budget), sorted, to (doc_id, group_no, page_no): what is open is a number of tokens and the last page."""
    doc, group, size, last, fresh = None, 0, 0, None, True
    for batch in batches:
        rows = []
        for d, page, tokens, budget in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if fresh or d != doc:
                doc, group, size, fresh = d, 0, tokens, False
            elif size + tokens > budget:
                group, size = group + 1, last[1] + tokens
                rows.append((d, group, last[0]))
            else:
                size += tokens
            rows.append((d, group, page))
            last = page, tokens
        if rows:
            kinds = (batch.column(0).type, pa.int32(), batch.column(1).type)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "group_no", "page_no"])


def pack_pages(pages: DataFrame, most: int = 20000) -> DataFrame:
    """(doc_id, group_no, page_no): pages in order packed into groups near an even budget; neighbours share a page.

    The budget comes from a document's sum; its pages then go by as one sorted, narrow stream, and no more than the last
    of them is held, however many there are. Null tokens count 0.
    """
    own = pages.select("doc_id", "page_no", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")).alias("tokens"))
    total = own.groupBy("doc_id").agg(F.sum("tokens").alias("total"))
    even = F.ceil((F.col("total") / F.ceil(F.col("total") / most) + most) / 2)
    budget = total.select("doc_id", F.when(F.col("total") <= most, F.col("total")).otherwise(even).alias("budget"))
    rows = own.join(budget.hint("merge"), "doc_id").repartition("doc_id").sortWithinPartitions("doc_id", "page_no")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return rows.select("doc_id", "page_no", "tokens", "budget").mapInArrow(_packed, f"doc_id {kinds['doc_id']}, group_no int, page_no {kinds['page_no']}")
