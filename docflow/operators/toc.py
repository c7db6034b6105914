"""Tables of contents: finding them, reading their lines, placing items on pages, checking and repairing."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.functions import text as T
from docflow.operators import tree
from docflow.sources.io import stored

#: Pages that are read with one automaton of their document's titles.
PART_PAGES = 500


def toc_runs(pages: DataFrame, flag: str = "is_toc") -> DataFrame:
    """(doc_id, run_start, run_end): runs of neighbouring pages that are contents."""
    hits = pages.where(flag).withColumn("_run", F.col("page_no") - F.row_number().over(W.partitionBy("doc_id").orderBy("page_no")))
    return hits.groupBy("doc_id", "_run").agg(F.min("page_no").alias("run_start"), F.max("page_no").alias("run_end")).drop("_run")


def first_toc_run(pages: DataFrame, scan: int = 20, flag: str = "is_toc") -> DataFrame:
    """The first run that starts within the first pages."""
    runs = toc_runs(pages, flag).where(F.col("run_start") <= scan)
    return runs.groupBy("doc_id").agg(F.min("run_start").alias("run_start"), F.min_by("run_end", "run_start").alias("run_end"))


def best_toc_run(pages: DataFrame, flag: str = "is_toc") -> DataFrame:
    """The first run with page numbers, else the first; pages has has_numbers."""
    runs = toc_runs(pages, flag)
    in_run = (F.col("r.doc_id") == F.col("p.doc_id")) & F.col("p.page_no").between(F.col("r.run_start"), F.col("r.run_end"))
    told = runs.alias("r").join(pages.alias("p"), in_run).groupBy("r.doc_id", "run_start", "run_end").agg(F.bool_or("has_numbers").alias("has_numbers"))
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("has_numbers"), "run_start"))
    return told.withColumn("_n", first).where("_n = 1").drop("_n")


def context_pages(pages: DataFrame, runs: DataFrame, most: int = 5) -> DataFrame:
    """The pages after a document's contents."""
    return pages.join(runs.hint("merge"), "doc_id").where((F.col("page_no") > F.col("run_end")) & (F.col("page_no") <= F.col("run_end") + most)).select(*pages.columns)


def toc_items(pages: DataFrame) -> DataFrame:
    """Items (doc_id, pos, structure, title, page) read from the lines of pages of contents."""
    rows = pages.select("doc_id", "page_no", F.posexplode(T.lines_of(F.col("text"))).alias("_i", "line"))
    pos = F.row_number().over(W.partitionBy("doc_id").orderBy("page_no", "_i"))
    return rows.select("doc_id", pos.alias("pos"), T.toc_line(F.col("line")).alias("x")).select("doc_id", "pos", "x.*").where("title <> ''")


def verify_sample(items: DataFrame, most: int | None = 5, seed: str = "") -> DataFrame:
    """At most so many items of each document, drawn by a hash of document, place and seed and so alike in every run; all without a bound."""
    if most is None:
        return items
    key = F.sha2(F.concat_ws("|", "doc_id", F.col("pos").cast("string"), F.lit(seed)), 256)
    return items.withColumn("_n", F.row_number().over(W.partitionBy("doc_id").orderBy(key))).where(F.col("_n") <= most).drop("_n")


def drop_unplaced(items: DataFrame) -> DataFrame:
    """Items that have a page."""
    return items.where(F.col("physical_index").isNotNull())


def extend_items(items: DataFrame, more: DataFrame) -> DataFrame:
    """items and those found later; what both have, as a shared page gives it, counts once."""
    return items.unionByName(more).dropDuplicates(["doc_id", "title", "physical_index"])


def verify(items: DataFrame, pages: DataFrame) -> DataFrame:
    """items with found: whether the page that an item names holds its title."""
    own = pages.select("doc_id", F.col("page_no").alias("physical_index"), F.col("text").alias("_text"))
    return items.join(own, ["doc_id", "physical_index"], "left").withColumn("found", T.contains_title(F.col("_text"), F.col("title"))).drop("_text")


def starts_page(items: DataFrame, pages: DataFrame) -> DataFrame:
    """items with appear_start: whether the title, with or without its number, comes first on its page."""
    own = pages.select("doc_id", F.col("page_no").alias("physical_index"), F.col("text").alias("_text"))
    return items.join(own, ["doc_id", "physical_index"], "left").withColumn("appear_start", T.starts_with_title(F.col("_text"), F.col("title")) | T.starts_with_title(F.col("_text"), F.concat("structure", "title"))).drop("_text")


def accuracy(checked: DataFrame, n_pages: DataFrame) -> DataFrame:
    """(doc_id, accuracy): share of placed items found; 0 if none is placed or the last lies in the first half. checked has found; n_pages (doc_id, n_pages)."""
    placed = F.col("physical_index").isNotNull()
    per = checked.groupBy("doc_id").agg(F.count_if(placed).alias("n"), F.count_if(placed & F.col("found")).alias("ok"), F.max_by("physical_index", F.when(placed, F.col("pos"))).alias("last"))
    good = (F.col("n") > 0) & (F.col("last") >= F.col("n_pages") / 2)
    return per.join(n_pages, "doc_id").select("doc_id", F.when(good, F.col("ok") / F.col("n")).otherwise(F.lit(0.0)).alias("accuracy"))


def _first_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, part, page_no, text, pos, low, high), sorted so that a part's titles come before its pages, to (doc_id, pos, page_no).

    One automaton holds the titles of a part, and every page is read by it once. Of each title the first page stays.
    """
    import ahocorasick

    part, titles, automaton, found, kind = None, {}, None, {}, None

    def closed() -> pa.RecordBatch:
        columns = [pa.array([part[0]] * len(found), kind), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "pos", "page_no"])

    for batch in batches:
        kind = batch.column(0).type
        for doc, number, page, text, pos, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (doc, number) != part:
                if found:
                    yield closed()
                part, titles, automaton, found = (doc, number), {}, None, {}
            if pos is not None:
                titles.setdefault(text, []).append((pos, low, high))
                continue
            if not titles or not text:
                continue
            if automaton is None:
                automaton = ahocorasick.Automaton()
                for t in titles:
                    automaton.add_word(t, t)
                automaton.make_automaton()
            for t in {t for _, t in automaton.iter(text)}:
                for pos, low, high in titles[t]:
                    if (low is None or low <= page <= high) and page < found.get(pos, page + 1):
                        found[pos] = page
    if found:
        yield closed()


def first_places(items: DataFrame, pages: DataFrame, bracketed: bool = False, part_pages: int = PART_PAGES) -> DataFrame:
    """(doc_id, pos, page_no): the first page that holds an item's title, white space and case aside; bracketed: of those from prev_page to next_page.

    A document's pages are dealt in parts of part_pages; each part gets the titles that it may hold once, as one automaton,
    and gives back a row a title at most. No page meets its titles one by one, and a long document is many parts.
    """
    part = F.floor(F.col("page_no") / part_pages)
    low, high = (F.col(c).cast("long") if bracketed else F.lit(None).cast("long") for c in ("prev_page", "next_page"))
    own = items.select("doc_id", F.col("pos").cast("long").alias("pos"), T.squeezed(F.col("title")).alias("text"), low.alias("low"), high.alias("high")).where("text <> ''")
    parts = pages.select("doc_id", part.alias("part")).distinct()
    titles = own.join(parts.hint("merge"), "doc_id")
    if bracketed:
        titles = titles.where((F.col("part") >= F.floor(F.col("low") / part_pages)) & (F.col("part") <= F.floor(F.col("high") / part_pages)))
    titles = titles.select("doc_id", "part", F.lit(None).cast("long").alias("page_no"), "text", "pos", "low", "high")
    none = [F.lit(None).cast("long").alias(c) for c in ("pos", "low", "high")]
    texts = pages.select("doc_id", part.alias("part"), F.col("page_no").cast("long").alias("page_no"), T.squeezed(F.col("text")).alias("text"), *none).where("page_no is not null")
    dealt = titles.unionByName(texts).repartition("doc_id", "part").sortWithinPartitions("doc_id", "part", F.col("page_no").asc_nulls_first())
    kind = pages.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(_first_hits, f"doc_id {kind}, pos long, page_no long").groupBy("doc_id", "pos").agg(F.min("page_no").alias("page_no"))


def locate(items: DataFrame, pages: DataFrame) -> DataFrame:
    """items with physical_index: the first page that holds the title, or null."""
    kind = pages.schema["page_no"].dataType
    first = first_places(items, pages).withColumn("pos", F.col("pos").cast(items.schema["pos"].dataType))
    return items.drop("physical_index").join(first.withColumn("page_no", F.col("page_no").cast(kind)).withColumnRenamed("page_no", "physical_index").hint("merge"), ["doc_id", "pos"], "left")


def neighbours(items: DataFrame, ok: str, first_page: int = 0) -> DataFrame:
    """items with prev_page and next_page: the pages of the nearest items before and after that are right."""
    page = F.when(F.col(ok), F.col("physical_index"))
    return items.withColumn("prev_page", F.coalesce(F.last(page, True).over(tree.before()), F.lit(first_page))).withColumn("next_page", F.coalesce(F.first(page, True).over(tree.after()), F.col("n_pages")))


def bracketed_repair(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items that aren't right are looked for on the pages between their right neighbours. items has found and n_pages."""
    near = neighbours(items, "found")
    met = first_places(near.where("not found"), pages, bracketed=True)
    fixed = met.select("doc_id", F.col("pos").cast(items.schema["pos"].dataType).alias("pos"), F.col("page_no").cast(pages.schema["page_no"].dataType).alias("_page"))
    out = near.join(fixed.hint("merge"), ["doc_id", "pos"], "left")
    return out.withColumn("physical_index", F.coalesce("_page", "physical_index")).withColumn("found", F.col("found") | F.col("_page").isNotNull()).drop("_page", "prev_page", "next_page")


def repair(items: DataFrame, pages: DataFrame, rounds: int = 3) -> DataFrame:
    """bracketed_repair again and again, until a round finds no more or for so many rounds; the right neighbours of one round narrow the next."""
    items = stored(items, "to_repair")
    wrong = items.where("not found").count()
    for _ in range(rounds):
        if not wrong:
            break
        items = stored(bracketed_repair(items, pages), "repaired")
        before, wrong = wrong, items.where("not found").count()
        if wrong == before:
            break
    return items


def truncate_pages(items: DataFrame, start: int = 1) -> DataFrame:
    """Pages behind a document's end become null; removed tells which."""
    bad = F.col("physical_index") > F.col("n_pages") + start - 1
    return items.withColumn("removed", F.coalesce(bad, F.lit(False))).withColumn("physical_index", F.when(~F.col("removed"), F.col("physical_index")))


def page_offset(items: DataFrame) -> DataFrame:
    """(doc_id, page_offset): the most common difference of physical and printed page, the smallest of equals."""
    seen = items.where("page is not null and physical_index is not null").groupBy("doc_id", (F.col("physical_index") - F.col("page")).alias("page_offset")).count()
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("count"), "page_offset"))
    return seen.withColumn("_n", first).where("_n = 1").select("doc_id", "page_offset")


def apply_offset(items: DataFrame) -> DataFrame:
    """Items without a physical page get the printed one plus the document's offset."""
    return items.join(page_offset(items), "doc_id", "left").withColumn("physical_index", F.coalesce("physical_index", F.col("page") + F.col("page_offset"))).drop("page_offset")


def completeness(pages: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, completeness): items read for each line that there was."""
    lines = pages.groupBy("doc_id").agg(F.sum(F.size(T.lines_of(F.col("text")))).alias("n_lines"))
    read = items.groupBy("doc_id").agg(F.count("*").alias("n_items"))
    return lines.join(read.hint("merge"), "doc_id", "left").select("doc_id", F.when(F.col("n_lines") > 0, F.coalesce("n_items", F.lit(0)) / F.col("n_lines")).otherwise(F.lit(1.0)).alias("completeness"))


def page_headings(pages: DataFrame, most_words: int = 12) -> DataFrame:
    """Items from pages without contents: numbered lines with few words, once for each title and page."""
    rows = pages.select("doc_id", "page_no", F.posexplode(T.lines_of(F.col("text"))).alias("_i", "line"))
    hits = rows.where(F.regexp_like("line", F.lit(r"^\s*\d+(\.\d+)*\.?\s+\S")) & (T.token_count(F.col("line")) <= most_words))
    read = hits.select("doc_id", "page_no", "_i", T.toc_line(F.col("line")).alias("x")).where("x.structure is not null")
    once = read.groupBy("doc_id", F.col("x.structure").alias("structure"), F.col("x.title").alias("title"), F.col("page_no").alias("physical_index")).agg(F.min("_i").alias("_i"))
    return once.withColumn("pos", F.row_number().over(W.partitionBy("doc_id").orderBy("physical_index", "_i"))).drop("_i")


def best_mode(scored: DataFrame) -> DataFrame:
    """scored: (doc_id, mode, accuracy), modes in order of preference. The first with accuracy 1, else the first above 0.6 (to repair), else 0 for a single node."""
    rank = F.when(F.col("accuracy") == 1.0, 1).when(F.col("accuracy") > 0.6, 2).otherwise(3)
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(rank, "mode"))
    best = scored.withColumn("_r", rank).withColumn("_n", first).where("_n = 1")
    return best.select("doc_id", F.when(F.col("_r") < 3, F.col("mode")).otherwise(F.lit(0)).alias("mode"), (F.col("_r") == 2).alias("to_repair"))


def checked_modes(modes: list[DataFrame], body: list[DataFrame], n_pages: DataFrame) -> list[DataFrame]:
    """The placed items of each mode, with found: whether their page holds them. body: the pages of each mode."""
    own = ["doc_id", "pos", "structure", "title", "physical_index", "n_pages", "found"]
    return [stored(verify(drop_unplaced(truncate_pages(m.join(n_pages.hint("merge"), "doc_id"))), b).select(*own), "checked") for m, b in zip(modes, body, strict=True)]


def mode_scores(checked: list[DataFrame], n_pages: DataFrame) -> DataFrame:
    """(doc_id, mode, accuracy) of every mode that has items, modes numbered from 1."""
    return functools.reduce(DataFrame.unionByName, (accuracy(c, n_pages).withColumn("mode", F.lit(k)) for k, c in enumerate(checked, 1)))


def ladder(checked: list[DataFrame], body: list[DataFrame], n_pages: DataFrame) -> DataFrame:
    """Items of the first mode that is above 0.6, repaired for up to three rounds where it is below 1; of the last mode whatever it has."""
    chosen = mode_scores(checked, n_pages).where((F.col("accuracy") > 0.6) | (F.col("mode") == len(checked))).groupBy("doc_id").agg(F.min("mode").alias("mode"), F.min_by("accuracy", "mode").alias("accuracy"))
    chosen = stored(chosen.select("doc_id", "mode", ((F.col("accuracy") > 0.6) & (F.col("accuracy") < 1)).alias("to_repair")), "modes")
    out = []
    for k, (c, b) in enumerate(zip(checked, body, strict=True), 1):
        mine = c.join(chosen.where(F.col("mode") == k).hint("merge"), "doc_id").drop("mode")
        out += [mine.where("not to_repair").drop("to_repair"), repair(mine.where("to_repair").drop("to_repair"), b)]
    return functools.reduce(DataFrame.unionByName, out).select("doc_id", "pos", "structure", "title", F.col("physical_index").cast("int").alias("physical_index"))


def toc_modes(pages: DataFrame, scan: int = 20, least_score: float = 0.5) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """(items of each mode, the pages of each mode, n_pages): contents with printed pages shifted by the document's offset, contents placed by their titles, and headings on the pages themselves."""
    n_pages = stored(pages.groupBy("doc_id").agg(F.max("page_no").cast("int").alias("n_pages")), "n_pages")
    early = pages.where(F.col("page_no") <= scan)  # a run may go on behind the first pages; those are only scored for documents that have one
    late = pages.where(F.col("page_no") > scan).join(early.where(T.is_contents(F.col("text"), least_score)).select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    flagged = early.unionByName(late).select("doc_id", "page_no", T.is_contents(F.col("text"), least_score).alias("is_toc"))
    run = stored(first_toc_run(flagged, scan), "runs")
    marked = stored(pages.join(run.hint("merge"), "doc_id", "left"), "marked")
    within = F.coalesce(F.col("page_no").between(F.col("run_start"), F.col("run_end")), F.lit(False))
    inside, outside = (marked.where(c).select(*pages.columns) for c in (within, ~within))
    body = marked.where("page_no > run_end").select(*pages.columns)  # documents without contents have no items to place
    read = stored(locate(stored(toc_items(inside), "toc_items"), body), "located")
    printed = read.join(page_offset(read).hint("merge"), "doc_id").withColumn("physical_index", F.coalesce(F.col("page") + F.col("page_offset"), "physical_index"))
    return [printed, read, page_headings(outside)], [body, body, outside], n_pages


def split_levels(nodes: DataFrame, pages: DataFrame, most_pages: int = 10, most_tokens: int = 20000, heads: DataFrame | None = None) -> DataFrame:
    """nodes (doc_id, ord, above, structure, title, page_start, page_end; ord an array of positions from the top, above the ord of the parent) with split_large level by level."""
    out, level = nodes, nodes
    while True:
        named = level.withColumn("node_id", F.array_join(F.transform("ord", lambda x: x.cast("string")), "."))
        kids = split_large(named, pages, most_pages, most_tokens, heads)
        known = out.select("doc_id", T.squeezed(F.col("title")).alias("_t"), F.col("page_start").alias("physical_index"))
        kids = kids.withColumn("_t", T.squeezed(F.col("title"))).join(known, ["doc_id", "_t", "physical_index"], "left_anti").drop("_t")
        group = W.partitionBy("doc_id", "parent_id").orderBy("pos")
        up = named.select("doc_id", F.col("node_id").alias("parent_id"), F.col("ord").alias("_up"), F.col("page_end").alias("n_pages"))
        kids = starts_page(kids, pages).join(up.hint("merge"), ["doc_id", "parent_id"]).withColumn("pos", F.row_number().over(group))
        key = F.concat_ws("/", "doc_id", "parent_id")
        ranged = tree.tree_parents(tree.assign_ranges(kids.withColumn("_doc", F.col("doc_id")).withColumn("doc_id", key)))
        rows = ranged.select(
            F.col("_doc").alias("doc_id"), F.concat("_up", F.array("pos")).alias("ord"),
            F.when(F.col("parent_pos").isNull(), F.col("_up")).otherwise(F.concat("_up", F.array("parent_pos"))).alias("above"),
            "structure", "title", "page_start", "page_end", "_up",
        )
        rows = stored(rows, "split")
        if rows.isEmpty():
            return out
        level = rows.drop("_up")
        first = rows.groupBy("doc_id", F.col("_up").alias("ord")).agg(F.min("page_start").alias("_end"))
        shorter = out.join(first.hint("merge"), ["doc_id", "ord"], "left").withColumn("page_end", F.coalesce("_end", "page_end")).drop("_end")
        out = stored(shorter.unionByName(level), "levels")


def document_tree(pages: DataFrame, scan: int = 20, least_score: float = 0.5, most_pages: int = 10, most_tokens: int = 20000) -> DataFrame:
    """Nodes of every document: contents found, read, placed, checked, repaired, ranged, and large nodes split; a document without any gets a single node "Document"."""
    pages = stored(pages, "pages")  # they are read by every step
    modes, body, n_pages = toc_modes(pages, scan, least_score)
    items = stored(ladder(checked_modes(modes, body, n_pages), body, n_pages), "items")
    rest = n_pages.join(items.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select("doc_id", F.lit(1).alias("pos"), F.lit("1").alias("structure"), F.lit("Document").alias("title"), F.lit(1).alias("physical_index"))
    whole = stored(starts_page(tree.preface_rows(items.unionByName(rest)), pages).join(n_pages.hint("merge"), "doc_id"), "whole")
    ranged = tree.tree_parents(tree.assign_ranges(whole))
    tops = ranged.select("doc_id", F.array("pos").alias("ord"), F.when(F.col("parent_pos").isNotNull(), F.array("parent_pos")).alias("above"), "structure", "title", "page_start", "page_end")
    nodes = split_levels(stored(tops, "ranged"), pages, most_pages, most_tokens, stored(page_headings(body[-1]), "headings"))
    order = W.partitionBy("doc_id").orderBy("ord")
    first = F.min(F.get("ord", F.lit(0))).over(W.partitionBy("doc_id"))
    nodes = stored(tree.node_numbering(nodes.withColumn("pos", (F.row_number().over(order) - 1 + first).cast("int"))), "numbered")
    ids = nodes.select("doc_id", F.col("ord").alias("above"), F.col("node_id").alias("parent_id"))
    return nodes.join(ids.hint("merge"), ["doc_id", "above"], "left").select("doc_id", "node_id", "parent_id", "pos", "structure", "title", "page_start", "page_end")


def split_large(nodes: DataFrame, pages: DataFrame, most_pages: int = 10, most_tokens: int = 20000, heads: DataFrame | None = None) -> DataFrame:
    """Children for nodes with both many pages and many tokens, from the headings on their pages (heads, as page_headings gives them, if not all pages are to be read for them); a first child that repeats the title is dropped."""
    tokens = nodes.select("doc_id", "node_id", F.explode(F.sequence("page_start", "page_end")).alias("page_no")).join(pages.select("doc_id", "page_no", "n_tokens").hint("merge"), ["doc_id", "page_no"]).groupBy("doc_id", "node_id").agg(F.sum("n_tokens").alias("branch"))
    large = nodes.join(tokens.hint("merge"), ["doc_id", "node_id"]).where((F.col("page_end") - F.col("page_start") > most_pages) & (F.col("branch") >= most_tokens))
    heads = page_headings(pages) if heads is None else heads
    met = large.select("doc_id", "node_id", F.col("title").alias("_above"), "page_start", "page_end").join(heads.hint("merge"), "doc_id").where("physical_index between page_start and page_end")
    first = F.row_number().over(W.partitionBy("doc_id", "node_id").orderBy("physical_index", "pos"))
    return met.withColumn("_n", first).where((F.col("_n") > 1) | (T.squeezed(F.col("title")) != T.squeezed(F.col("_above")))).select("doc_id", F.col("node_id").alias("parent_id"), "structure", "title", "physical_index", "pos")
