"""Contents on the pages of long books, against plain loops."""

import random

from pyspark.sql import functions as F

from docflow.functions import text as T
from docflow.operators import toc as O

ITEMS = "doc_id string, pos int, structure string, title string, physical_index int, found boolean, n_pages int"


def _squeezed(text):
    return "".join(text.lower().split())


def _book(r, doc, n_pages, n_items):
    words = ["alpha", "beta", "gamma", "delta", "Review", "of", "the", "Plan", "plan 2"]
    pages = [(doc, p, None if p % 97 == 0 else " ".join(r.choice(words) for _ in range(r.randrange(25)))) for p in range(1, n_pages + 1)]
    items = []
    for k in range(1, n_items + 1):
        title = r.choice(["", "  ", "Plan", "planofthe", "Chapter %d" % k, "of  THE plan", " ".join(r.choice(words) for _ in range(r.randrange(1, 7)))])
        if title.startswith("Chapter") and r.random() < 0.8:
            p = r.randrange(1, n_pages + 1)
            pages[p - 1] = (doc, p, f"{pages[p - 1][2] or ''} CHAP ter{k} and more")
        items.append((doc, k, str(k), title, r.choice([None, r.randrange(1, n_pages + 1)]), r.random() < 0.4, n_pages))
    return pages, items


def test_places_on_long_books(spark):
    """A book of 5,000 pages in many parts, and small ones: the first page for every title, and the first between right neighbours."""
    r = random.Random(8)
    books = [_book(r, "long", 5000, 250), _book(r, "short", 3, 9), _book(r, "other", 40, 30), ([("bare", 1, "plan")], []), ([], _book(r, "gone", 2, 3)[1])]
    pages, items = [p for b, _ in books for p in b], [i for _, b in books for i in b]
    text = {(d, p): _squeezed(t or "") for d, p, t in pages}
    of = {}
    for d, p in sorted(text):
        of.setdefault(d, []).append(p)

    def first(doc, title, low=0, high=10**9):
        t = _squeezed(title)
        return next((p for p in of.get(doc, []) if low <= p <= high and t and t in text[doc, p]), None)

    page_rows, item_rows = spark.createDataFrame(pages, "doc_id string, page_no int, text string"), spark.createDataFrame(items, ITEMS)
    want = {(d, k): first(d, title) for d, k, _, title, *_ in items}
    got = {(x.doc_id, x.pos): x.physical_index for x in O.locate(item_rows, page_rows).collect()}
    assert got == want and sum(v is not None for v in want.values()) > 100
    assert {(x.doc_id, x.pos): x.page_no for x in O.first_places(item_rows, page_rows, part_pages=7).collect()} == {k: v for k, v in want.items() if v is not None}

    repaired = {(x.doc_id, x.pos): (x.physical_index, x.found) for x in O.bracketed_repair(item_rows, page_rows).collect()}
    for d, k, _, title, page, ok, n_pages in items:
        mine = [x for x in items if x[0] == d]
        low = next((x[4] for x in reversed(mine[: k - 1]) if x[5] and x[4] is not None), 0)
        high = next((x[4] for x in mine[k:] if x[5] and x[4] is not None), n_pages)
        new = None if ok else first(d, title, low, high)
        assert repaired[d, k] == (page if new is None else new, ok or new is not None)


def test_places_with_other_ids(spark):
    pages = spark.createDataFrame([(1, 1, "a plan"), (1, None, "plan"), (1, 2, "plan b")], "doc_id long, page_no int, text string")
    items = spark.createDataFrame([(1, 1, "Plan"), (1, 2, "plan B"), (2, 1, "plan")], "doc_id long, pos int, title string")
    assert sorted(map(tuple, O.first_places(items, pages).collect())) == [(1, 1, 1), (1, 2, 2)]


def test_pages_without_contents_are_not_searched(spark):
    """Titles are looked for in documents that have contents alone; the pages of the others wait for their headings."""
    toc = "1 Alpha ........ 2\n2 Beta ........ 3"
    rows = [("a", 1, toc, 4), ("a", 2, "1 Alpha\ntext", 2), ("a", 3, "2 Beta\ntext", 2), ("b", 1, "1 Gamma\ntext", 2), ("b", 2, "plain text", 2)]
    modes, body, _ = O.toc_modes(spark.createDataFrame(rows, "doc_id string, page_no int, text string, n_tokens long"))
    assert [sorted((x.doc_id, x.page_no) for x in b.collect()) for b in body] == [[("a", 2), ("a", 3)]] * 2 + [[("a", 2), ("a", 3), ("b", 1), ("b", 2)]]
    assert sorted((x.doc_id, x.title, x.physical_index) for x in modes[1].collect()) == [("a", "Alpha", 2), ("a", "Beta", 3)]
    assert ("b", "Gamma", 1) in {(x.doc_id, x.title, x.physical_index) for x in modes[2].collect()}


def test_is_contents(spark):
    """Lines lead to a page by dots or by a number; one line that ends in a number is prose."""
    yes = ["1 Alpha ........ 2", "1 Alpha . . . . . . 12\n2 Beta . . . . . . 15", "Alpha 2\nBeta 4", "Contents\n\nAlpha ..... iv\nBeta ..... A-3\nwrapped", "Alpha ......"]
    no = [None, "", "Alpha", "Paid with 4088495698897153", "1 Alpha\nAs it was in 1998", "Paid 4088495698897153\nPaid 4088495698897154", "Well ..... who knows\nYes.", "Alpha 2\nBeta 4\nx\ny\nz", "." * 100_000 + " who knows"]
    rows = spark.createDataFrame([(t,) for t in yes + no], "text string")
    assert [x[0] for x in rows.select(T.is_contents(F.col("text"))).collect()] == [True] * len(yes) + [False] * len(no)
