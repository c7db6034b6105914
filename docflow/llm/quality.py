"""Quality rules as a short-circuit cascade of DataFrame expressions.

Counts: words are runs of characters other than ASCII white space. word_chars are the code points in words, n_symbols
the characters #*$%&|<>, n_dup_lines the lines with a word that equal an earlier line, n_repeat_words the words inside
3-word windows that the text holds twice or more (the first included).

Cascade: every rule is a Boolean expression over a text and its words that rejects. On a bounded sample (about SAMPLE_ROWS
rows, twice as many at most, of the whole table, by a hash of id and text) each rule is timed with the counts that it needs, over
texts that are repeated until the rule and not the job's start is what takes the time, and its share of rejected rows is
counted. Rules run in the order of rejections per cost, costs rounded to powers of two so that the noise of a clock
doesn't turn the order. A row that one rule has rejected skips the counts of the rules that follow: in keep_good()
each count is made inside its rule's branch. quality() returns the base counts of every row, so there the cascade spares
only the counts beyond them. The order changes the cost only: kept is the same in any order.

The 3-word windows of a text are sorted inside the row (hash first, then the words themselves, so a hash collision
can't count), and equal neighbours are the repeated ones: no row leaves its partition, so nothing is shuffled and no
source or text can make a task heavy beyond its own length.

Nulls and odd rows: a null or empty text has no words; all counts are 0 and it fails the base rule. Repeated rows give
repeated results, null ids are ids like others, and an empty table gives an empty one. Further columns of the input, of
whatever name, are left aside by quality() and kept by keep_good().
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, table

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
SAMPLE_ROWS = 200
#: Of each row of the sample so many characters are timed and judged, so what the driver gets is bounded.
SAMPLE_CHARS = 20_000
#: How often the sample is gone through for a rule's time, and how many times the least time is taken of.
REPEATS, TRIES = 8, 3
MIN_WORDS = 50


def _count(text: Column, pattern: str) -> Column:
    """How many characters of the text match."""
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value made once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _windows(words: Column) -> Column:
    """The 3-word windows, sorted: hash, words and place."""
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), w.alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("p")),
    )
    return F.sort_array(windows)


def _same(x: Column, y: Column) -> Column:
    return F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))


def _covered(s: Column) -> Column:
    """How many words lie in windows that occur twice or more. s: the sorted windows."""
    twice = F.sort_array(F.transform(F.filter(s, lambda x, i: _same(x, F.get(s, i + 1)) | _same(x, F.get(s, i - 1))), lambda x: x["p"]))
    return F.aggregate(
        twice,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n")),
    )["n"]


def _repeat_words(words: Column) -> Column:
    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    # most texts repeat no window; only the others are sorted
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _let(_windows(words), _covered)).otherwise(F.lit(0).cast("long")))


def _dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def counts(text: Column, words: Column) -> dict[str, Column]:
    """Each count, or what a rule asks of it, as an expression of its own over a text and its words."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": _count(text, SYMBOLS),
        "n_dup_lines": _let(lines, _dup_lines),
        "n_repeat_words": _repeat_words(words),
        "mostly_dup_lines": _let(lines, lambda x: 2 * _dup_lines(x) > F.size(x)),
        "n_capitals": _count(text, "[A-Z]"),
        "n_marks": _count(text, "[!?]"),
    }


def base_failed(c: dict[str, Column]) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def rules(c: dict[str, Column]) -> dict[str, Column]:
    """The rules over counts; the base rule is the first two."""
    n = c["n_words"]
    return {
        "few_words": n < MIN_WORDS,
        "repeat_words": 100 * c["n_repeat_words"] > 50 * n,
        "symbols": 10 * c["n_symbols"] > n,
        "dup_lines": c["mostly_dup_lines"],
        "word_length": ~c["word_chars"].between(2 * n, 20 * n),
        "capitals": 2 * c["n_capitals"] > c["word_chars"],
        "marks": 4 * c["n_marks"] > n,
    }


def _split(docs: DataFrame, text_col: str, **kept: Column) -> DataFrame:
    """kept by name, t (the text or an empty one) and w (its words). What is built on them can't be pushed below, since it can't pass an explode, so the words are made once."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    both = F.struct(t.alias("t"), F.array_remove(F.split(t, SPACE + "+"), "").alias("w"))
    return docs.select(*[c.alias(k) for k, c in kept.items()], F.explode(F.array(both)).alias("_b")).select(*kept, "_b.t", "_b.w")


def worth(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, repeats: int | None = None, tries: int | None = None) -> dict[str, tuple[float, float]]:
    """For each rule its share of rejected rows and its cost (microseconds a row, rounded to a power of two) on a bounded sample."""
    repeats, tries = repeats or REPEATS, tries or TRIES
    texts = hash_sample(docs, [F.col(id_col), F.col(text_col)], sample_rows, F.substring(text_col, 1, SAMPLE_CHARS))
    spark = docs.sparkSession
    sample = _split(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "text").persist()
    try:
        n = max(1, sample.count())
        often = sample.select("t", "w", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("again"))

        def least(rule: Column) -> tuple[int, float]:
            took = []
            for _ in range(tries):
                began = time.perf_counter()
                hit = often.agg(F.count_if(rule)).first()[0]
                took.append(time.perf_counter() - began)
            return hit // repeats, min(took)

        _, start = least(F.col("again") < 0)  # what a job takes in any case
        out = {}
        for name, rule in rules(counts(F.col("t"), F.col("w"))).items():
            hit, took = least(rule)
            micros = max(1.0, (took - start) * 1e6 / (n * repeats))
            out[name] = (hit / n, 2.0 ** round(math.log2(micros)))
    finally:
        sample.unpersist()
    return out


def cascade(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejections per cost on a bounded sample, best first; of equals the cheaper, then by name."""
    found = worth(docs, text_col, id_col, sample_rows)
    return sorted(found, key=lambda x: (-found[x][0] / found[x][1], found[x][1], x))


def kept(order: list[str], c: dict[str, Column]) -> Column:
    """True if no rule rejects; a rejected row skips the rules that follow, and the counts that only they need."""
    all_rules = rules(c)
    verdict = F.lit(True)
    for name in reversed(order):
        verdict = F.when(F.coalesce(all_rules[name], F.lit(False)), F.lit(False)).otherwise(verdict)
    return verdict


def quality(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts and verdict for each row."""
    order = cascade(docs, text_col, id_col, sample_rows)
    each = _split(docs, text_col, doc_id=F.col(id_col))
    own = counts(F.col("t"), F.col("w"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    # the counts are returned and used by the rules; behind an explode they are made once
    each = each.select("doc_id", "t", F.explode(F.array(F.struct(*[own[k].alias(k) for k in base]))).alias("q"))
    c = own | {k: F.col(f"q.{k}") for k in base}
    return each.select("doc_id", *[f"q.{k}" for k in base], base_failed(c).alias("base_failed"), kept(order, c).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, with their columns."""
    order = cascade(docs, text_col, id_col, sample_rows)
    each = _split(docs, text_col, _row=F.struct("*"))
    return each.where(kept(order, counts(F.col("t"), F.col("w")))).select("_row.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
x AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM x),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM h) GROUP BY r),
m AS (SELECT doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
       OR 2 * len(regexp_extract_all(t, '[A-Z]')) > word_chars
       OR 4 * len(regexp_extract_all(t, '[!?]')) > n_words) AS kept
FROM b
"""
