"""Benchmark decontamination with DataFrame expressions only.

Words are runs of [0-9a-z] and of characters from U+0080 on, after A-Z is lower-cased. A benchmark item's windows are
all its runs of 13 words; an item with fewer words (but not none) is one window. A document word is hit if it lies in
an occurrence of a window.

How it works: four words of each benchmark window are hashed into a table of one byte a slot, whose size is set by the
checked number of windows and never passes MOST_SLOTS. It is a literal of the plan, so the scan tests each
token window of a text in place and makes rows only for the few that pass. Those rows carry the window's own words and
are joined with the windows themselves, which decides: by broadcast while the written table of windows is below
BROADCAST_BYTES, else by a shuffled join. A row of its own stands for the document, so that one pass gives all.

Nulls and odd rows: a null or empty text has no words, is never hit and is kept; an item without words has no window.
Each row of the documents gives one result row, also where doc_id repeats or is null; items with the same text are
all counted, items with the same item_id once. An empty benchmark hits nothing, an empty table gives an empty one.

Scale: the table's false marks grow with the benchmark: with a million windows about a fifth of the token windows become
rows of the join, with ten million nearly all; results stay exact and no step is bound to one task.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table, write_read, written_bytes

WINDOW = 13
BROADCAST_BYTES = 64 << 20
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 22
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _picks(length: int) -> list[int]:
    return sorted({0, length // 3, 2 * length // 3, length - 1})


def _mark(word_list: Column, at: Column, length: int) -> Column:
    """A hash of a few words of the window that starts at position at."""
    return F.xxhash64(F.lit(length), *[F.get(word_list, at + k) for k in _picks(length)])


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(window, length, mark, items): the distinct windows, each with the items that have it."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    items = items.withColumn("length", F.least(F.size("w"), F.lit(width))).where("length > 0")
    starts = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))).alias("at")
    each = items.select("item", "w", "length", starts)
    mark = F.lit(None).cast("long")
    for n in range(1, width + 1):
        mark = F.when(F.col("length") == n, _mark(F.col("w"), F.col("at"), n)).otherwise(mark)
    each = each.select("item", "length", F.array_join(F.slice("w", F.col("at") + 1, F.col("length")), " ").alias("window"), mark.alias("mark"))
    return each.groupBy("window", "length").agg(F.first("mark").alias("mark"), F.array_sort(F.collect_set("item")).alias("items"))


def _slots(known: DataFrame, n: int) -> Column:
    """A binary of n bytes, 1 where a window's mark falls, as one literal of the plan. n is bounded, and so is what comes to the driver."""
    taken = known.select(F.pmod("mark", F.lit(n)).cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()
    filled = np.zeros(n, np.uint8)
    filled[taken] = 1
    return F.lit(bytearray(filled.tobytes()))


def _candidates(word_list: Column, starts: Column, length: int, slots: Column, n: int) -> Column:
    """The windows of one length whose marks fall on taken slots."""
    maybe = F.filter(starts, lambda at: F.substring(slots, F.pmod(_mark(word_list, at, length), F.lit(n)).cast("int") + 1, 1) == F.lit(bytearray(b"\x01")))
    return F.transform(maybe, lambda at: F.struct(at.alias("at"), F.lit(length).alias("length"), F.array_join(F.slice(word_list, at + 1, length), " ").alias("window")))


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """One row for each row of docs: its columns but the text, n_words, n_hit, and items, the sorted ids of the items that occur. Columns of docs that have one of these names give way."""
    known = write_read(windows(benchmark, width=width), "windows")
    n_windows, lengths = known.agg(F.count("*"), F.array_sort(F.collect_set("length"))).first()
    n = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (16 * n_windows).bit_length()))
    rest = [c for c in docs.columns if c not in (text_col, "n_words", "n_hit", "items")]
    row = "row_" + uuid.uuid4().hex
    split = docs.select(F.struct(*rest, F.monotonically_increasing_id().alias(row)).alias("_d"), words(F.col(text_col)).alias("_w"))
    w = F.col("_w")
    # the row that stands for the document has a window that no item can have, and another one for each row, so a shuffled join spreads them
    shape = "array<struct<at:int,length:int,window:string>>"
    found = [F.array(F.struct(F.lit(-1).alias("at"), F.size(w).alias("length"), F.concat(F.lit("\x00"), F.col(f"_d.{row}").cast("string")).alias("window"))).cast(shape)]
    slots = _slots(known, n) if n_windows else None
    for length in lengths or []:
        starts = F.when(F.size(w) >= length, F.sequence(F.lit(0), F.size(w) - length)).otherwise(F.array().cast("array<int>"))
        found.append(_candidates(w, starts, length, slots, n).cast(shape))
    each = split.select("_d", F.size(w).alias("_n"), F.explode(F.concat(*found)).alias("_f")).select("_d", "_f.*")
    sure = F.broadcast(known.select("window", "items")) if written_bytes(known) < BROADCAST_BYTES else known.select("window", "items").hint("merge")
    each = each.join(sure, "window", "left").where("at < 0 or items is not null")
    spans = F.array_sort(F.collect_set(F.when(F.col("at") >= 0, F.struct("at", "length"))))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["at"] + s["length"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["at"] + s["length"] - F.greatest(a["end"], s["at"]))).alias("n")),
    )["n"]
    per = each.groupBy("_d").agg(
        F.max(F.when(F.col("at") < 0, F.col("length"))).cast("long").alias("n_words"),
        spans.alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return per.select("_d.*", "n_words", covered.alias("n_hit"), "items").drop(row)


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows. Rows are told apart by id and text: a clean row stays beside a contaminated one of the same id. What goes is written out first, so the join's strategy rests on a true size."""
    known = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k"), F.col(text_col).alias("text"))
    bad = write_read(hits(known, benchmark).where(contaminated()).select("id", "k").distinct(), "contaminated")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["id"]) & (F.xxhash64(docs[text_col]) == bad["k"]), "left_anti")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE = """
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT r, i, v.n, item FROM p JOIN v USING (n, g)),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
