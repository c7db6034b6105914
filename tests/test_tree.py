"""Trees, sections and contents against worked cases and procedural restatements on random input."""

import random

from pyspark.sql import functions as F

from docflow.operators import sections as S
from docflow.operators import toc as O
from docflow.operators import tree as N
from docflow.sources import io

MD = "# A\nx y\n```\n# not\n```\n## B\nz\n### C\nq\n## D\n# E"


def test_markdown_tree(spark):
    rows = S.markdown_tree(spark.createDataFrame([("d", MD), ("e", None), ("f", "no heading")], "doc_id string, content string")).orderBy("node_id").collect()
    assert [(r.title, r.level, r.parent_id) for r in rows] == [("A", 1, None), ("B", 2, "0000"), ("C", 3, "0001"), ("D", 2, "0000"), ("E", 1, None)]
    assert rows[0].text == "# A\nx y\n```\n# not\n```"


def _levels(spark, all_levels, tokens=None):
    rows = [(f"d{k}", i + 1, f"{i:04d}", lv, (tokens[k][i] if tokens else 1), f"t{i}") for k, ls in enumerate(all_levels) for i, lv in enumerate(ls)]
    return spark.createDataFrame(rows, "doc_id string, pos int, node_id string, level int, n_tokens long, text string")


def test_parents_and_branches(spark):
    random.seed(5)
    cases = [[random.randint(1, r) for _ in range(n)] for r, n in [(6, random.randint(1, 12)) for _ in range(60)] + [(50, 300), (9, 200), (10**6, 80)]] + [[1, 7, 8], list(range(1, 61)), [3, 3, 2]]
    got = {(r.doc_id, r.pos): (r.parent_id, r.subtree_end) for r in N.subtree_ends(N.parents(_levels(spark, cases))).collect()}
    for k, ls in enumerate(cases):
        for i, lv in enumerate(ls):
            up = next((j for j in range(i - 1, -1, -1) if ls[j] < lv), None)
            end = next((j for j in range(i + 1, len(ls)) if ls[j] <= lv), len(ls))
            assert got[f"d{k}", i + 1] == (None if up is None else f"{up:04d}", end)


def test_branch_tokens_of_any_level(spark):
    random.seed(6)
    cases = [[random.randint(1, 50) for _ in range(120)] for _ in range(5)]
    tokens = [[random.randint(0, 9) for _ in c] for c in cases]
    nodes = _levels(spark, cases, tokens)
    for r in N.subtree_tokens(nodes).collect():
        k = int(r.doc_id[1:])
        assert r.branch_tokens == sum(tokens[k][r.pos - 1 : r.subtree_end])
    odd = spark.createDataFrame([("d", 1, "a", None, None), ("d", 2, "b", 2, 5), (None, 1, "c", 1, 1)], "doc_id string, pos int, node_id string, level int, n_tokens long")
    assert sorted((r.node_id, r.branch_tokens) for r in N.subtree_tokens(odd).where("doc_id is not null").collect()) == [("a", 5), ("b", 5)]
    assert N.subtree_tokens(odd).count() == 3 and N.parents(odd.where("false")).count() == 0


def test_trees_of_forty_levels(spark, tmp_path):
    """Forty levels in, forty out, as nodes and as elements of files; an empty level in a deeper schema ends it."""
    import json

    def deep(n, children):
        return {"title": f"t{n}", "type": "paragraph", "content": f"c{n}", "extra words": n, **({children: [deep(n + 1, children), *([{"title": "side", "type": "caption", "content": "s"}] if n == 20 else [])]} if n < 40 else {})}

    for children in ("nodes", "kids"):
        (tmp_path / children).mkdir()
        (tmp_path / children / "one.json").write_text(json.dumps({"doc_id": "one", children: [deep(1, children)]}))
    rows = N.nested_nodes(spark.read.json(str(tmp_path / "nodes"))).orderBy("pos").collect()
    assert [(r.title, r.level, r.parent_pos) for r in rows] == [(f"t{n}", n, n - 1 if n > 1 else None) for n in range(1, 41)] + [("side", 21, 20)]
    found = S.flat_elements(io.read_elements(spark, str(tmp_path / "kids"))).orderBy("pos").collect()
    assert [(r.doc_id, r.content, r.extra_words) for r in found] == [("one", f"c{n}", n) for n in range(1, 41)] + [("one", "s", None)]
    short = spark.read.schema(spark.read.json(str(tmp_path / "nodes")).schema).json(spark.createDataFrame([('{"doc_id": "x", "nodes": [{"title": "only"}]}',)], "value string").rdd.map(lambda r: r.value))
    assert [r.title for r in N.nested_nodes(short).collect()] == ["only"]


def test_packing_of_long_documents(spark):
    """The groups of a plain loop, over a document of 200,000 pages and small ones, without a collected row."""
    import math

    r = random.Random(9)
    docs = {"long": [r.randrange(900) for _ in range(200_000)], "one": [50_000], "zero": [0, 0, 0], "even": [100] * 20, "big first": [5000, 10, 10]} | {f"d{k}": [r.choice([0, 5, 300, 1500, None]) for _ in range(r.randrange(1, 40))] for k in range(30)}
    want = set()
    for d, raw in docs.items():
        tokens, most = [t or 0 for t in raw], 1000
        total = sum(tokens)
        budget = total if total <= most else math.ceil((total / math.ceil(total / most) + most) / 2)
        groups, now = [], []
        for p, t in enumerate(tokens, 1):
            if now and sum(x for _, x in now) + t > budget:
                groups.append(now)
                now = now[-1:]
            now.append((p, t))
        want |= {(d, g, p) for g, pages in enumerate([*groups, now]) for p, _ in pages}
    rows = [(d, p, t) for d, ts in docs.items() for p, t in enumerate(ts, 1)]
    r.shuffle(rows)
    import pyarrow as pa

    table = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "page_no", "n_tokens"])
    pages = spark.createDataFrame(table)
    packed = N.pack_pages(pages, 1000)
    assert "collect_list" not in packed._jdf.queryExecution().optimizedPlan().toString()
    got = packed.toPandas()
    assert len(got) == len(want) and set(got.itertuples(index=False, name=None)) == want


def test_tables_in_sections(spark):
    """Tables stand in a section's text as pipe tables, whatever shape a reader gave their rows; one without rows counts by its content."""
    import json

    cell = lambda *kids, **own: {**own, "kids": [{"content": k, "font": 9} for k in kids], "column number": 1}
    table = {"rows": [{"cells": [cell(content=" a|b "), cell("x", "y", content="")], "row number": 1}, {"cells": [cell("z"), cell()]}]}
    rows = [("heading", "H", 1), ("paragraph", "p", None), ("table", None, None, table), ("heading", "deep", 4), ("table", "flat", None, {"rows": []}), ("table", "bare", None), ("caption", " ", None), ("heading", "I", 2), ("table", None, None)]
    lines = [json.dumps({"doc_id": "d", "pos": i, "type": x[0], "content": x[1], "level": x[2], "page": i, "id": i, **(x[3] if len(x) > 3 else {})}) for i, x in enumerate(rows)]
    e = spark.read.json(spark.sparkContext.parallelize(lines))
    got = S.section_runs(e).collect()
    assert [(x.heading, x.text, x.page_end, x.element_ids) for x in got] == [("H", "p\n\n| a\\|b | x y |\n|---|---|\n| z |  |\n\nflat\n\nbare", 6, [0, 1, 2, 3, 4, 5, 6])]
    assert [x.text for x in S.section_runs(e.drop("rows")).collect()] == ["p\n\nflat\n\nbare"]


def test_log_files_have_a_size(spark, tmp_path):
    rows = [(i, "INFO" if i % 10 else "DEBUG", "m" * (i % 50), i % 2) for i in range(3000)] + [(9999, "INFO", "m" * 5000, 1)]
    log = spark.createDataFrame(rows, "id long, level string, message string, run_id int").repartition(2)
    for _ in range(2):
        io.write_log(log, str(tmp_path / "log"), 2000)
    files = [f for f in (tmp_path / "log").rglob("part-*")]
    assert len(files) > 100 and sum(f.stat().st_size > 2000 for f in files) == 2
    got = spark.read.json(str(tmp_path / "log"))
    assert got.count() == 2 * sum(x[1] != "DEBUG" for x in rows) and got.where("id = 9999 and run_id = 1").count() == 2


def test_thinning(spark):
    nodes = _levels(spark, [[1, 2, 2, 1]], [[5, 3, 2, 50]])
    rows = N.tree_thinning(nodes, 20).orderBy("pos").collect()
    assert [(r.pos, r.text) for r in rows] == [(1, "t0\n\nt1\n\nt2"), (4, "t3")]


def test_ranges_parents_preface(spark):
    toc = spark.createDataFrame([("d", 1, "1", "a", 1, False), ("d", 2, "1.1", "b", 3, True), ("d", 3, "2", "c", 3, False), ("d", 4, "3.1", "e", 7, True), ("d", 5, "1.2", "f", 8, False)], "doc_id string, pos int, structure string, title string, physical_index int, appear_start boolean")
    first4 = toc.where("pos < 5").withColumn("n_pages", F.lit(10))
    assert [(r.page_start, r.page_end) for r in N.assign_ranges(first4).orderBy("pos").collect()] == [(1, 3 - 1), (3, 3), (3, 6), (7, 10)]
    assert [r.parent_pos for r in N.tree_parents(toc).orderBy("pos").collect()] == [None, 1, None, None, 1]
    late = toc.withColumn("physical_index", F.col("physical_index") + 2)
    assert N.preface_rows(late).orderBy("pos").first().title == "Preface"


def test_packing(spark):
    rows = [("a", i, 9000) for i in (1, 2, 3)] + [("b", 1, 30000), ("b", 2, 1000)] + [("c", 1, 5)]
    got = N.pack_pages(spark.createDataFrame(rows, "doc_id string, page_no int, n_tokens long"), 20000).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.doc_id, r.group_no), []).append(r.page_no)
    by_doc = lambda d: [sorted(v) for (x, _), v in sorted(groups.items()) if x == d]
    assert (by_doc("a"), by_doc("b"), by_doc("c")) == ([[1], [1, 2], [2, 3]], [[1], [1, 2]], [[1]])


def test_contents(spark):
    flags = [False, True, True, False, True]
    pages = spark.createDataFrame([("d", i + 1, f) for i, f in enumerate(flags)], "doc_id string, page_no int, is_toc boolean")
    r = O.first_toc_run(pages).first()
    assert (r.run_start, r.run_end) == (2, 3)
    items = spark.createDataFrame([("d", 1, 4, True, 10), ("d", 2, 11, True, 10)], "doc_id string, pos int, physical_index int, found boolean, n_pages int")
    assert O.truncate_pages(items).orderBy("pos").collect()[1].physical_index is None
    assert O.accuracy(items.where("pos = 1"), items.select("doc_id", "n_pages").distinct()).first().accuracy == 0.0


def test_document_tree(spark):
    text = ["Contents\n1 Start ..... 1\n2 Middle ..... 2\n3 End ..... 3", "1 Start\nfoo", "2 Middle\nbar", "x\n3 End\nbaz"]
    pages = spark.createDataFrame([("d", i + 1, t, 10) for i, t in enumerate(text)] + [("e", 1, "plain words only", 3)], "doc_id string, page_no int, text string, n_tokens long")
    rows = O.document_tree(pages).orderBy("doc_id", "pos").collect()
    assert [(r.title, r.page_start, r.page_end) for r in rows if r.doc_id == "d"] == [("Preface", 1, 1), ("Start", 2, 2), ("Middle", 3, 4), ("End", 4, 4)]
    assert [(r.title, r.page_start) for r in rows if r.doc_id == "e"] == [("Document", 1)]


def test_elements(spark):
    shape = "doc_id string, kids array<struct<type:string, `heading level`:int, content:string, kids:array<struct<type:string, content:string>>>>"
    raw = spark.createDataFrame([("d", [("heading", 1, "H", []), ("box", None, None, [("paragraph", "p")])])], shape)
    assert [(r.type, r.content) for r in S.flat_elements(raw).orderBy("pos").collect()] == [("heading", "H"), ("paragraph", "p")]


def test_document_tree_modes_and_splits(spark):
    toc = "Contents\n1 Alpha ..... 1\n2 Beta ..... 2\n3 Xray ..... 3\n4 Yankee ..... 4\n5 Zulu ..... 5"
    bad = [toc, "Alpha", "Beta", "7 Other heading\nwords", "w", "w", "8 Last heading\nwords", "w"]
    big = ["Contents\n1 Start ..... 1\n2 Large ..... 2\n3 End ..... 17", "1 Start", *["2 Large", *["words"] * 4, "2.1 Inner one\nwords", *["words"] * 4, "2.2 Inner two\nwords", *["words"] * 4], "3 End"]
    rows = [(d, i + 1, t, 2000) for d, ts in (("bad", bad), ("big", big)) for i, t in enumerate(ts)]
    out = O.document_tree(spark.createDataFrame(rows, "doc_id string, page_no int, text string, n_tokens long")).orderBy("doc_id", "pos").collect()
    titles = [r.title for r in out if r.doc_id == "bad"]
    assert "Xray" not in titles and "Other heading" in titles and "Last heading" in titles
    own = [(r.title, r.page_start, r.page_end) for r in out if r.doc_id == "big"]
    assert own[1:] == [("Start", 2, 2), ("Large", 3, 8), ("Inner one", 8, 12), ("Inner two", 13, 17), ("End", 18, 18)]
    ids = {r.title: r for r in out if r.doc_id == "big"}
    assert ids["Inner two"].parent_id == ids["Inner one"].parent_id == ids["Large"].node_id


def test_queries_over_whole_tables(spark, tmp_path):
    from docflow.plans import queries as Q

    text = "1 Opening heading\n" + "word " * 700
    docs = [(i, "src", f"{i} Heading {'abcdefghij'[i % 10]}x\n" + text, "en") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"the item {i} must be done") for i in range(200)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = Q.QUERIES["split_large_nodes"](spark, str(tmp_path)).collect()
    assert {r.physical_index for r in rows} == set(range(1, 62)) and any(r.title == "Opening heading" for r in rows)
    got = Q.QUERIES["run_eval"](spark, str(tmp_path)).collect()
    assert len({r.section for r in got}) == 10


def test_many_layout_files(spark, tmp_path):
    """Files are packed before they are parsed: what is read afterwards are few files. Indented, marked, broken, empty and listed ones among them."""
    import json

    (tmp_path / "x").mkdir()
    kid = lambda i: {"kids": [{"type": "heading", "content": f"H {i}\n", "kids": [{"type": "paragraph", "content": f"p{i}"}]}]}
    for i in range(200):
        (tmp_path / f"x/d{i}.json").write_text("﻿" * (i % 2) + json.dumps(kid(i), indent=i % 3 or None), encoding="utf-8")
    (tmp_path / "x/two.json").write_text(json.dumps([kid(500), kid(501)], indent=1))
    (tmp_path / "x/broken.json").write_text('{"kids": [{"type": "heading",\n')
    (tmp_path / "x/empty.json").write_text("")
    rows = io.read_elements(spark, str(tmp_path / "x"))
    assert len(rows.inputFiles()) < 20
    assert sorted((r.doc_id, r.kids[0].content) for r in rows.where("kids is not null").collect()) == sorted([(f"d{i}", f"H {i}\n") for i in range(200)] + [("two", "H 500\n"), ("two", "H 501\n")])
    assert [r.doc_id for r in rows.where("kids is null").collect()] == ["broken"]
    assert S.flat_elements(rows).where("doc_id = 'd7'").count() == 2


def test_thinning_moves_texts_once(spark):
    """Texts are shuffled to their node's row and, where texts are put together, to their node: the nodes are read twice and no more."""
    rows = [("d", 1, "0", 1, " root \n", 500), ("d", 2, "1", 2, " a ", 3), ("d", 3, "2", 3, None, 2), ("d", 4, "3", 3, " c", 2), ("d", 5, "4", 2, None, 1), ("d", 6, "5", 2, "  ", 1), ("d", 7, "6", 3, "", 1), ("d", 8, "7", 2, " e ", 600)]
    nodes = spark.createDataFrame(rows, "doc_id string, pos int, node_id string, level int, text string, n_tokens long")
    out = N.tree_thinning(nodes, 20)
    assert [(r.pos, r.text, r.branch_tokens) for r in out.orderBy("pos").collect()] == [(1, " root \n", 1110), (2, "a\n\nc", 7), (5, "", 1), (6, "", 2), (8, " e ", 600)]
    assert set(out.columns) == {*nodes.columns, "subtree_end", "branch_tokens"}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0  # branches are told once, before texts move
