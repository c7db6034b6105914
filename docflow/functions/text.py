"""Column functions on strings: JSON repair, page marks, table-of-contents lines, headings, token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JUDGE = "alignment double, recall double, fidelity double, hallucination double, reasoning string"


#: What \s stands for in regular expressions.
SPACES = " \t\n\x0b\f\r"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends. Not by a regular expression, which would try every blank inside."""
    return F.trim(text, F.lit(SPACES))


#: What SQL's trim takes off: the blanks of Unicode, no tabs or line ends.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Without blanks at both ends; tabs and line ends stay."""
    return F.trim(text, F.lit(BLANKS))


def markdown_escaped(text: Column) -> Column:
    """A text to be set into markdown: its lines that would be headings or fences there get a backslash."""
    return F.regexp_replace(text, r"(?md)^([ \t\x0b\f\r]*\\*)(#|```)", r"$1\\$2")


def markdown_unescaped(text: Column) -> Column:
    """The text that markdown_escaped was given."""
    return F.regexp_replace(text, r"(?md)^([ \t\x0b\f\r]*\\*)\\(#|```)", "$1$2")


def json_repair(text: Column) -> Column:
    """Without code fences, from the first bracket to the last one; null if there is none."""
    bare = F.regexp_replace(text, r"(?i)```(?:json)?\s*", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)([\[{].*[\]}])", 1), F.lit(""))


def json_lenient(text: Column) -> Column:
    """The JSON of a text as compact JSON; Python's None, True and False are read where a value stands; else {}."""
    fixed = json_repair(text)
    for word, right in (("None", "null"), ("True", "true"), ("False", "false")):
        fixed = F.regexp_replace(fixed, rf"([:\[,]\s*){word}(?=\s*[,\]}}])", f"$1{right}")
    return F.coalesce(F.to_json(F.try_parse_json(json_repair(text))), F.to_json(F.try_parse_json(fixed)), F.lit("{}"))


def judge_scores(text: Column) -> Column:
    """Scores of a judge's answer; an unreadable answer scores 0 with hallucination 1."""
    bad = F.struct(
        *[F.lit(x).alias(n) for n, x in (("alignment", 0.0), ("recall", 0.0), ("fidelity", 0.0), ("hallucination", 1.0))],
        F.concat(F.lit("Error parsing: "), F.substring(F.coalesce(text, F.lit("")), 1, 100)).alias("reasoning"),
    )
    read = F.from_json(json_repair(text), JUDGE)
    return F.when(read.isNotNull() & read["alignment"].isNotNull(), read).otherwise(bad)


def page_tag(page: Column, text: Column) -> Column:
    """A page's text between two marks of its number."""
    mark = F.concat(F.lit("<physical_index_"), page.cast("string"), F.lit(">"))
    return F.concat(mark, F.lit("\n"), text, F.lit("\n"), mark, F.lit("\n\n"))


def page_of_tag(text: Column) -> Column:
    return F.regexp_extract(text, r"physical_index_(\d+)", 1).try_cast("int")


def page_number(text: Column) -> Column:
    return stripped(text).try_cast("int")


def dots_to_colon(text: Column) -> Column:
    """Leaders of five or more dots, also dots with blanks, become a colon."""
    return F.regexp_replace(F.regexp_replace(text, r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


_TOC_LINE = r"(?d)^\s*(?:(\d+(?:\.\d+)*)\.?\s+)?(.*?\S)\s*(?:[:.\s]\s*(\d+))?\s*$"


def toc_line(line: Column) -> Column:
    """structure, title and page of one line of a table of contents."""
    flat = dots_to_colon(line)
    return F.struct(
        F.nullif(F.regexp_extract(flat, _TOC_LINE, 1), F.lit("")).alias("structure"),
        trimmed(F.regexp_replace(F.regexp_extract(flat, _TOC_LINE, 2), r"[\s:.]+$", "")).alias("title"),
        F.regexp_extract(flat, _TOC_LINE, 3).try_cast("int").alias("page"),
    )


def lines_of(text: Column) -> Column:
    """Lines with something on them."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: stripped(x) != "")


def toc_score(text: Column) -> Column:
    """Share of the lines that end in a number or have a leader of dots."""
    rows = lines_of(text)
    hits = F.filter(rows, lambda x: F.regexp_like(x, F.lit(r"\.{5,}|(?:\. ){5,}|\s\d+\s*$")))
    return F.when(F.size(rows) > 0, F.size(hits) / F.size(rows)).otherwise(F.lit(0.0))


#: A leader of dots that runs to the line's end or to its page, a number that a page can have, and the end of a line that holds them.
_LEADER = r"(?:\.{5,}+|(?:\. ){5,}+\.?)\s*+[\dA-Zivxlc-]*+$"
_PAGE_AT_END = r"\s\d{1,4}$"
_TAIL = 120


def is_contents(text: Column, least_score: float = 0.5) -> Column:
    """Whether a page reads as contents: at least that share of its lines lead to a page, by dots or by a number that a page can have.

    Prose ends in numbers as well, those of cards among them. So one such line without dots is no contents.
    """
    rows = F.transform(lines_of(text), lambda x: F.right(stripped(x), F.lit(_TAIL)))
    led = F.filter(rows, lambda x: F.regexp_like(x, F.lit(_LEADER)))
    told = F.filter(rows, lambda x: F.regexp_like(x, F.lit(f"{_LEADER}|{_PAGE_AT_END}")))
    return (F.size(told) > 0) & (F.size(told) >= F.size(rows) * least_score) & ((F.size(told) > 1) | (F.size(led) > 0))


def has_page_numbers(text: Column) -> Column:
    return F.exists(lines_of(text), lambda x: toc_line(x)["page"].isNotNull())


def squeezed(text: Column) -> Column:
    """Lower case without white space, for comparisons of titles. Sigma is lowered apart, as lower makes another one of it at a word's end."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), "Σ" + SPACES, "σ"))


def contains_title(text: Column, title: Column) -> Column:
    return F.when(text.isNull() | (squeezed(title) == ""), F.lit(False)).otherwise(F.contains(squeezed(text), squeezed(title)))


def starts_with_title(text: Column, title: Column) -> Column:
    return F.when(text.isNull() | (squeezed(title) == ""), F.lit(False)).otherwise(F.startswith(squeezed(text), squeezed(title)))


def heading_level(line: Column) -> Column:
    """1 to 6 for a markdown heading, else 0."""
    return F.length(F.regexp_extract(stripped(line), r"^(#{1,6})\s+\S", 1))


def heading_title(line: Column) -> Column:
    return stripped(F.regexp_extract(stripped(line), r"^#{1,6}\s+(.+)$", 1))


def is_fence(line: Column) -> Column:
    return F.startswith(stripped(line), F.lit("```"))


def table_markdown(rows: Column) -> Column:
    """A pipe table of rows of cells; each cell is a struct of content and kids (structs of content), whose contents count where it has none. Pipes in cells are escaped."""

    def cell(c: Column) -> Column:
        kids = F.array_join(F.transform(c["kids"], lambda k: F.coalesce(k["content"], F.lit(""))), " ")
        return stripped(F.replace(F.coalesce(F.nullif(c["content"], F.lit("")), kids, F.lit("")), F.lit("|"), F.lit("\\|")))

    body = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.coalesce(r["cells"], F.array().cast(CELLS)), cell), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), F.size(F.coalesce(F.get(rows, 0)["cells"], F.array().cast(CELLS)))), "|"), F.lit("|"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, F.greatest(F.size(body), F.lit(1)))), "\n")).otherwise(F.lit(""))


#: The shape of a table's cells and rows.
CELLS = "array<struct<content:string,kids:array<struct<content:string>>>>"
ROWS = f"array<struct<cells:{CELLS}>>"


def table_rows(df: DataFrame, column: str = "rows") -> Column:
    """The rows of a table as ROWS, from whatever a reader has made of them: fields that are missing are null, others are left out."""
    from pyspark.sql import types as T

    def shaped(c: Column, kind: T.DataType, want: T.DataType) -> Column:
        if isinstance(want, T.ArrayType):
            return F.transform(c, lambda x: shaped(x, kind.elementType, want.elementType)) if isinstance(kind, T.ArrayType) else F.lit(None).cast(want)
        if isinstance(want, T.StructType):
            if not isinstance(kind, T.StructType):
                return F.lit(None).cast(want)
            own = {f.name: f.dataType for f in kind.fields}
            made = [(shaped(c[f.name], own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
            return F.when(c.isNotNull(), F.struct(*made))
        return c.cast(want)

    want = T.DataType.fromDDL(ROWS)
    return shaped(F.col(column), df.schema[column].dataType, want) if column in df.columns else F.lit(None).cast(want)


def embedding_text(title: Column, description: Column) -> Column:
    return F.trim(F.concat_ws(" ", title, F.substring(F.coalesce(description, F.lit("")), 1, 200)))


def token_count(text: Column, count=None) -> Column:
    """Words between white space, or what a function of a batch of texts counts (a list of texts to a list of numbers); null counts 0."""
    if count is None:
        return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))

    def batch(texts):
        return texts.__class__(count(texts.fillna("").tolist()), index=texts.index, dtype="int64")

    import pandas as pd

    batch.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast("long")).otherwise(F.pandas_udf(batch, "long")(text))


def sentences(text: Column) -> Column:
    """Parts between full stops, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\."), stripped), lambda x: x != "")


def text_rows(text: Column) -> Column:
    """Lines of a form's field, without blank ones."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: stripped(x) != "")


def first_tag(text: Column) -> Column:
    return F.get(F.regexp_extract_all(text, F.lit(r"<physical_index_(\d+)>"), 1), 0).try_cast("int")


def last_tag(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"<physical_index_(\d+)>"), 1)
    return F.try_element_at(found, F.lit(-1)).try_cast("int")


def scrub(payload: Column, key: str = "section_title") -> Column:
    """A JSON payload without one key, at every depth and inside arrays; null if it can't be read."""
    import json

    def bare(x):
        if isinstance(x, dict):
            return {k: bare(v) for k, v in x.items() if k != key}
        return [bare(v) for v in x] if isinstance(x, list) else x

    def one(text: str | None) -> str | None:
        try:
            x = bare(json.loads(text))
            said = json.dumps(x, separators=(",", ":"), ensure_ascii=False)
            return said if said.isascii() or not any("\ud800" <= c <= "\udfff" for c in said) else json.dumps(x, separators=(",", ":"))
        except (TypeError, ValueError, RecursionError):
            return None

    return F.udf(one, "string", useArrow=True)(payload)
