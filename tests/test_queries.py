"""Queries against their SQL on small tables whose ids are those of large ones."""

import pytest

from docflow.plans import registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["issue_type_fallback", "publish_hierarchy"])
def test_projects_of_all_kinds(spark, tmp_path, name):
    """Run names of every length: those of ids from 10,000 on have a third kind of project."""
    import duckdb

    rows = [(i, f"text {i}", "en", s, 6) for i in (1, 1001, 10_001, 10_002, 99_000) for s in ("src1", "src10", "src100")]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    told = db.execute(registry.ORACLES[name])
    columns, want = [c[0] for c in told.description], told.fetchall()
    got = [tuple(x) for x in registry.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {x[-1] for x in got} >= {"Story", "Epic", "Bug"}


def against_sql(spark, tmp_path, name, rows):
    """Rows of a query and of its SQL over documents."""
    import duckdb

    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    told = db.execute(registry.ORACLES[name])
    columns, want = [c[0] for c in told.description], told.fetchall()
    got = [tuple(x) for x in registry.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()]
    return sorted(map(repr, got)), sorted(map(repr, want))


ENDS = [None, "", " ", "\n", "a\n\n", "a\t", "a ", "a\xa0", "a\r", "　a ", "\n\na b"]
MARKS = ["# Head\na", "a\n  ## Head ##\nb", "a\n```\nb", "```\n# x\n```", "a\n\\# b\n\\\\```\nc", "\t\\## b\n#\n####### c", "a\r# b\n\x0b### c"]


@pytest.mark.parametrize("name", ["heading_extract", "markdown_tree", "fence_parity"])
def test_markdown_of_odd_texts(spark, tmp_path, name):
    """Texts that are empty or end in white space, and texts that would be headings or fences if they were markdown."""
    texts = ENDS + ["Plain text."] + MARKS
    rows = [(i, texts[i // 2 % len(texts)], "en", f"src{i % 2}", 1) for i in range(6 * len(texts))]
    got, want = against_sql(spark, tmp_path, name, rows)
    assert got == want


def test_prose_is_no_contents(spark, tmp_path):
    """Pages of one line that ends in a number, in front of books and repeated in them; headings with odd letters."""
    card, year, plain = "Paid with 4088495698897153", "As it was in 1998", "Plain words."
    books = {
        "src2": [card] + [plain] * 6,
        "src4": [year] + [plain] * 6,
        "src1": [card],
        "src3": [year],
        "src5": [card, plain, plain, plain, card],
        "src7": [year, plain, plain, plain, year],
        "src8": [f"12.5.3.4 {card}"] + [plain] * 6,
        "src9": ["4 ΣΑΣ\nPlain words.", "5 a\rb\n6 c\x85d\n7 x　"],
    }
    rows = [(k, text, "en", source, 1) for source, texts in books.items() for k, text in enumerate(texts)]
    got, want = against_sql(spark, tmp_path, "toc_pipeline", rows)
    assert got == want and len(got) == len(books)
