"""Operators that SQL can't express, against procedural versions on random input; and cases of single rules."""

import datetime
import difflib
import json
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from docflow import schemas
from docflow.functions import retry as R
from docflow.functions import text as T
from docflow.operators import dedup as D
from docflow.operators import evals as E
from docflow.operators import lifecycle as L
from docflow.operators import publish as P
from docflow.operators import review as V
from docflow.operators import sections as S
from docflow.operators import tasks as K
from docflow.operators import toc as O
from docflow.operators import tree as N
from docflow.sources import io
from docflow.streaming import telemetry as ST

RAW = (
    "doc_id string, node_id string, ord int, id string, title string, short_description string, acceptance_criteria array<string>, considerations_constraints array<string>, deliverables array<string>, "
    "use_case string, mockup_prototype string, confidence double, flags array<string>, continues_to_next boolean"
)


def ratio(a, b):
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


def lifecycles(nodes, raws):
    """Tasks of one document in a plain loop: nodes [(id, title, from, to)], raws {node: [dict]}."""
    open_, done = [], []
    for node, title, start, end in nodes:
        ref = (node, title, start, end, "")
        seen, fresh = [], []
        for raw in raws.get(node, []):
            best, top = None, 0.0
            for t in open_:
                r = ratio(raw["title"], t["title"])
                if t["more"] and r > top and r >= 0.75:
                    best, top = t, r
            if best is None:
                best = dict(raw, refs=[ref], flags=[f for f in raw["flags"] if f in schemas.FLAGS], status="OPEN", opened=node, closed=None, lists={k: list(v or []) for k, v in raw["lists"].items()})
                fresh.append(best)
                seen.append(best)
                continue
            best["said"] += " " + raw["said"]
            for k, v in raw["lists"].items():
                if v:
                    best["lists"][k] = sorted(set(best["lists"][k]) | set(v))
            best["conf"] = max(best["conf"], raw["conf"])
            for f in raw["flags"]:
                if f in schemas.FLAGS and f not in best["flags"]:
                    best["flags"].append(f)
            best["more"], best["mock"] = raw["more"], best["mock"] or raw["mock"]
            best["refs"].append(ref)
            if all(best is not x for x in seen):
                seen.append(best)
        still = []
        for t in open_:
            if any(t is x for x in seen):
                continue
            if t["more"]:
                if "INCOMPLETE" not in t["flags"]:
                    t["flags"].append("INCOMPLETE")
                still.append(t)
            else:
                t["closed"] = node
                done.append(t)
        open_ = still + seen
    for t in open_:
        if "INCOMPLETE" not in t["flags"]:
            t["flags"].append("INCOMPLETE")
    return done + open_


def test_lifecycle_by_a_plain_loop(spark):
    r = random.Random(4)
    titles = ["Build the gate", "Build the gates", "Build a gate", "Write the guide", "Write guides", "Design it"]
    opt = lambda x: r.choice([None, [], [x], [x, "z"]])
    rows, about, want = [], [], []
    for d in range(25):
        nodes = [(f"n{i}", f"T{i}", i, i + 1) for i in range(r.randint(1, 7))]
        about += [(f"d{d}", n, p, t, a, b) for p, (n, t, a, b) in enumerate(nodes)]
        raws = {}
        for n, *_ in nodes:
            for i in range(r.choice([0, 1, 1, 2, 3])):
                raw = {"id": f"{d}-{n}-{i}", "title": r.choice(titles), "said": f"s{r.randint(0, 99)}", "lists": {k: opt(k[0]) for k in L.LISTS}, "use": r.choice([None, "u1", "u2"]), "mock": r.choice([None, "m1", "m2"]), "conf": r.randint(0, 10) / 10, "flags": r.sample(["ODD", *schemas.FLAGS], 2), "more": r.random() < 0.6}
                raws.setdefault(n, []).append(raw)
                rows.append((f"d{d}", n, i, raw["id"], raw["title"], raw["said"], *[raw["lists"][k] for k in L.LISTS], raw["use"], raw["mock"], raw["conf"], raw["flags"], raw["more"]))
        for t in lifecycles(nodes, raws):
            want.append((f"d{d}", t["id"], t["title"], t["said"], *[t["lists"][k] for k in L.LISTS], t["use"], t["mock"], t["conf"], t["flags"], "CLOSED", t["opened"], t["closed"], [x[0] for x in t["refs"]], [tuple(x) for x in t["refs"]]))
    got = L.task_lifecycle(spark.createDataFrame(rows, RAW), spark.createDataFrame(about, "doc_id string, node_id string, pos int, title string, page_start int, page_end int"))
    got = [tuple([tuple(y) for y in x] if i == len(g) - 1 else x for i, x in enumerate(g)) for g in got.select("doc_id", *L.OUT).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(len(w[-2]) > 2 for w in want)


def test_best_title_match_by_all_pairs(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 8)))
    old = [(d, f"t{i}", i, word()) for d in "pq" for i in range(25)]
    new = [(d, f"r{i}", word()) for d in "pq" for i in range(25)]
    got = L.best_title_match(spark.createDataFrame(new, "doc_id string, id string, title string"), spark.createDataFrame(old, "doc_id string, task_id string, pos int, title string"), 0.6)
    want = set()
    for d, i, t in new:
        rated = [(ratio(t, x), -p, n) for e, n, p, x in old if e == d and ratio(t, x) >= 0.6]
        if rated:
            want.add((d, i, max(rated)[2]))
    assert {(x.doc_id, x.raw_id, x.task_id) for x in got.collect()} == want and want


def test_packing_by_a_plain_loop(spark):
    r = random.Random(6)
    docs = {f"d{k}": [r.choice([1, 50, 300, 900, 4000]) for _ in range(r.randint(1, 12))] for k in range(40)}
    rows = [(d, i + 1, n) for d, ns in docs.items() for i, n in enumerate(ns)]
    got = {}
    for x in N.pack_pages(spark.createDataFrame(rows, "doc_id string, page_no int, n_tokens long"), 1000).collect():
        got.setdefault(x.doc_id, {}).setdefault(x.group_no, []).append(x.page_no)
    for d, ns in docs.items():
        total, groups, now, size = sum(ns), [], [], 0
        if total <= 1000:
            groups = [list(range(1, len(ns) + 1))]
        else:
            budget = math.ceil((total / math.ceil(total / 1000) + 1000) / 2)
            for i, n in enumerate(ns):
                if size + n > budget:
                    groups.append(now)
                    now, size = ([i], ns[i - 1]) if i else ([], 0)
                now, size = [*now, i + 1], size + n
            groups = [g for g in [*groups, now] if g]
        assert [sorted(got[d][k]) for k in sorted(got[d])] == groups, (d, ns)


def squeeze(t):
    return re.sub(r"\s+", "", t or "").lower()


def tree_of(pages, most_pages, most_tokens):
    """A book's nodes in a plain loop; pages [(text, tokens)], numbered chapters "k Title" as headings, contents "k Title ..... page" on the first page if it is one."""
    n = len(pages)
    lines = [[x for x in t.split("\n") if x.strip()] for t, _ in pages]
    is_toc = [bool(ls) and sum(bool(re.search(r"\.{5,}|\s\d+\s*$", x)) for x in ls) / len(ls) >= 0.5 for ls in lines]
    run = next(((i, next((j for j in range(i, n) if not is_toc[j]), n) - 1) for i in range(min(20, n)) if is_toc[i]), None)

    def heads(lo, hi):
        return [(m[1], m[2].strip(), p + 1) for p in range(lo, hi) if not (run and run[0] <= p <= run[1]) for x in dict.fromkeys(lines[p]) if len(x.split()) <= 12 and (m := re.fullmatch(r"\s*(\d+(?:\.\d+)*)\s+(\S.*?)\s*", x))]

    holds = lambda title, p: p is not None and 1 <= p <= n and squeeze(title) in squeeze(pages[p - 1][0])
    body = range(run[1] + 1, n) if run else range(n)
    modes = []
    if run:
        items = [(m[1], m[2].strip(), int(m[3])) for p in range(run[0], run[1] + 1) for x in lines[p] if (m := re.fullmatch(r"\s*(\d+(?:\.\d+)*)\s+(.*?)\s*\.{5,}\s*(\d+)\s*", x))]
        placed = [(s, t, g, next((p + 1 for p in body if holds(t, p + 1)), None)) for s, t, g in items]
        shifts = [p - g for *_, g, p in placed if p is not None]
        if shifts:
            shift = min(set(shifts), key=lambda x: (-shifts.count(x), x))
            modes.append([(s, t, g + shift) for s, t, g, _ in placed])
        else:
            modes.append([])
        modes.append([(s, t, p) for s, t, _, p in placed if p is not None])
    modes.append(heads(0, n))
    kept = None
    for k, mode in enumerate(modes):
        own = body if k < len(modes) - 1 else range(n)
        mode = [x for x in mode if x[2] <= n]
        good = [holds(t, p) and p - 1 in own for _, t, p in mode]
        score = sum(good) / len(mode) if mode and mode[-1][2] >= n / 2 else 0
        if score == 1 or k == len(modes) - 1 and score <= 0.6:
            kept = mode
        elif score > 0.6:
            for _ in range(3):
                new, ok = list(mode), list(good)
                for i, (s, t, p) in enumerate(mode):
                    if not good[i]:
                        lo = next((mode[j][2] for j in range(i - 1, -1, -1) if good[j]), 0)
                        hi = next((mode[j][2] for j in range(i + 1, len(mode)) if good[j]), n)
                        hit = next((q + 1 for q in own if lo <= q + 1 <= hi and holds(t, q + 1)), None)
                        if hit:
                            new[i], ok[i] = (s, t, hit), True
                mode, good = new, ok
            kept = mode
        if kept is not None:
            break
    items = kept or [("1", "Document", 1)]
    if items[0][2] > 1:
        items = [("0", "Preface", 1), *items]

    def ranged(items, end):
        tops = [squeeze(pages[p - 1][0]).startswith((squeeze(t), squeeze(s + t))) for s, t, p in items]
        return [(s, t, p, end if i + 1 == len(items) else max(items[i + 1][2] - 1, p) if tops[i + 1] else items[i + 1][2]) for i, (s, t, p) in enumerate(items)]

    out = [list(x) for x in ranged(items, n)]
    level, known = list(out), {(squeeze(x[1]), x[2]) for x in out}
    while level:
        below = []
        for node in level:
            if node[3] - node[2] > most_pages and sum(k for _, k in pages[node[2] - 1 : node[3]]) >= most_tokens:
                kids = [x for x in heads(node[2] - 1, node[3])]
                if kids and squeeze(kids[0][1]) == squeeze(node[1]):
                    kids = kids[1:]
                kids = [x for x in kids if (squeeze(x[1]), x[2]) not in known]
                rows = [list(x) for x in ranged(kids, node[3])]
                if rows:
                    at = next(i for i, x in enumerate(out) if x is node)
                    node[3] = min(x[2] for x in rows)
                    out[at + 1 : at + 1] = rows
                    below += rows
        known |= {(squeeze(x[1]), x[2]) for x in below}
        level = below
    return [tuple(x) for x in out]


def test_document_tree_by_a_plain_loop(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    books = {}
    for k in range(14):
        n, kind = r.randint(2, 30), k % 5
        marks = sorted(r.sample(range(n), r.randint(1, max(1, n // 2))))
        titles = {p: f"{word()} {word()}" for p in marks}
        pages = []
        for p in range(n):
            head = f"{marks.index(p) + 1} {titles[p]}" if p in titles and not (kind == 4 and r.random() < 0.3) else ""
            inner = f"{marks.index(p) + 1}.1 {word()} {word()}" if p in titles and r.random() < 0.2 else ""
            words = " ".join(word() for _ in range(20))
            pages.append("\n".join(x for x in (head if r.random() < 0.8 else f"{words}\n{head}", words, inner) if x))
        if kind != 3:
            shown = [f"{i + 1} {titles[p]} ........ {r.choice([1, p + 1]) if kind == 2 else p + 1 + (r.random() < 0.2) * (kind == 1)}" for i, p in enumerate(marks)]
            pages.insert(0, "\n".join(shown))
        books[f"b{k:02d}"] = [(t, 2500) for t in pages]
    rows = [(d, i + 1, t, n) for d, pages in books.items() for i, (t, n) in enumerate(pages)]
    got = {}
    for x in O.document_tree(spark.createDataFrame(rows, "doc_id string, page_no int, text string, n_tokens long")).orderBy("doc_id", "pos").collect():
        got.setdefault(x.doc_id, []).append((x.structure, x.title, x.page_start, x.page_end))
    for d, pages in books.items():
        assert got[d] == tree_of(pages, 10, 20000), (d, pages)


def test_repair_stops_and_brackets(spark):
    items = spark.createDataFrame([("d", 1, "Alpha", 1, True, 6), ("d", 2, "Beta", 6, False, 6), ("d", 3, "Gamma", 5, True, 6), ("d", 4, "Nowhere", 6, False, 6)], "doc_id string, pos int, title string, physical_index int, found boolean, n_pages int")
    pages = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(["alpha", "x", "be ta", "beta", "gamma", "beta"])], "doc_id string, page_no int, text string")
    got = {x.pos: (x.physical_index, x.found) for x in O.repair(items, pages).collect()}
    assert got == {1: (1, True), 2: (3, True), 3: (5, True), 4: (6, False)}


def test_lsh_recall(spark):
    """Random projections find nearly all pairs that are alike, and none that aren't."""
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 16))
    vs = np.concatenate([base, base + r.normal(0, 0.12, base.shape), r.normal(size=(120, 16))])
    vs /= np.linalg.norm(vs, axis=1, keepdims=True)
    df = spark.createDataFrame([("r", f"{i:03d}", [float(x) for x in v]) for i, v in enumerate(vs)], "run_id string, id string, v array<double>")
    want = {(x.id_a, x.id_b) for x in D.similar_pairs(df, 0.85).collect()}
    got = {(x.id_a, x.id_b) for x in D.similar_pairs_lsh(df, 0.85).collect()}
    assert len(want) >= 30 and got <= want and len(got) >= 0.9 * len(want)


TASK = "id string, run_id string, status string, confidence double, acceptance_criteria array<string>, considerations_constraints array<string>, deliverables array<string>, flags array<string>, use_case string, mockup_prototype string, merged_from array<string>"


def test_merging_keeps_references_and_history(spark):
    ref = lambda x: [{"node_id": x, "section_title": x, "page_start": 1, "page_end": 2, "snippet": ""}]
    rows = [(x, "r", "CLOSED", 0.1 * i, None, None, [x], [f"F{x}"], None, None, ["old"] if x == "A" else None) for i, x in enumerate("ABC", 1)]
    t = spark.createDataFrame(rows, TASK).withColumn("source_refs", F.array(F.struct(F.col("id").alias("node_id"), F.col("id").alias("section_title"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"), F.lit("").alias("snippet"))))
    ds = spark.createDataFrame([("A", "B", "merge"), ("A", "C", "merge")], "id_a string, id_b string, decision string")
    a = D.apply_decisions(t, ds).first()
    assert (a.id, a.merged_from, a.flags, a.deliverables, [x.node_id for x in a.source_refs]) == ("A", ["old", "B", "C"], ["FA"], ["A", "B", "C"], ["A", "B", "C"])
    assert ref("A")[0].keys() == a.source_refs[0].asDict().keys()
    more = spark.createDataFrame([("R1", "r", "CLOSED"), ("R2", "r", "CLOSED")], "id string, run_id string, status string")
    both = D.union_recovered(t, more, spark.createDataFrame([("A", "R1", "merge")], "id_a string, id_b string, decision string")).collect()
    assert sorted(x.id for x in both) == ["A", "B", "C", "R2"] and next(x for x in both if x.id == "A").merged_from == ["old", "R1"]


def test_extracted_fields(spark):
    text = "Create the export. It is blue.\n[ ] runs\nUse case: as a clerk\nConstraints: small\nConstraint: fast\nDeliverables: a file\nMock-up: sketch"
    s = spark.createDataFrame([("d", "n", 1, text), ("d", "m", 2, "Build it")], "doc_id string, node_id string, pos int, text string")
    one, two = K.extract_rules(s).orderBy("pos").collect()
    assert (one.title, one.use_case, one.considerations_constraints, one.deliverables, one.mockup_prototype, one.acceptance_criteria) == ("Create the export", "as a clerk", ["small", "fast"], ["a file"], "sketch", ["[ ] runs"])
    assert two.title == "Build it" and two.use_case is None and two.deliverables is None


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_white_space_and_bounds(spark):
    blank = spark.createDataFrame([("d", "n", "\n \t" * 40), ("d", "m", " " + "x" * 50)], "doc_id string, node_id string, text string")
    assert [x.node_id for x in K.long_enough(blank).collect()] == ["m"] and [(x.node_id, x.n_chars) for x in K.too_short(blank).collect()] == [("n", 0)]
    said = [{"title": "t", "short_description": "d", "confidence": c} for c in (0.0, 1.0, 1.5, -0.1, None)]
    good, bad = K.read_answers(spark.createDataFrame([("d", "n", json.dumps(said))], "doc_id string, node_id string, content string"))
    assert sorted(x.confidence for x in good.collect()) == [0.0, 1.0] and bad.count() == 3
    assert one(spark, T.heading_level(F.lit("\t## A"))) == 2 and one(spark, F.size(T.lines_of(F.lit("a\n\t\n b")))) == 2


def test_retry_after_as_a_date(spark):
    now = 1_700_000_000
    when = datetime.datetime.fromtimestamp(now + 42, datetime.timezone.utc).strftime("%a, %d %b %Y %H:%M:%S GMT")
    for said, seconds in ((when, 42.0), ("Mon, 06 Nov 2000 08:49:37 GMT", 0.0), (" 17 ", 17.0)):
        hint = one(spark, R.wait_hint(F.create_map(F.lit("retry-after"), F.lit(said)), F.lit(""), F.lit(float(now))))
        assert (hint.source, hint.seconds) == ("retry-after-header", seconds)
    assert one(spark, R.wait_hint(F.create_map(F.lit("retry-after"), F.lit("soon")), F.lit(""), F.lit(float(now)))) is None


def test_payloads_name_their_parents(spark):
    t = spark.createDataFrame([("1", "r", 5, "a", []), ("2", "r", 6, "b", [])], "id string, run_id string, pos long, title string, flags array<string>").withColumns({c: F.lit(None).cast("string") for c in ("short_description", "use_case", "mockup_prototype")})
    t = t.withColumns({c: F.lit(None).cast("array<string>") for c in ("acceptance_criteria", "considerations_constraints", "deliverables")}).withColumn("source_refs", F.expr("array(named_struct('node_id', id, 'section_title', concat('S', id), 'page_start', 1, 'page_end', 2, 'snippet', ''))"))
    types = lambda *names: spark.createDataFrame([("r", list(names))], "run_id string, available array<string>")
    rows = P.payloads(t, types("Bug", "Alpha"), "story_subtask")
    got = {(x.step, x.pos): json.loads(x.payload)["fields"] for x in P.as_json(rows, "PROJ", spark.createDataFrame([("r", 1, "PROJ-7")], "run_id string, container_no int, key string")).collect()}
    assert got[2, 5]["parent"] == {"key": "PROJ-7"} and got[2, 6]["parent"] == {"key": "#2"} and "parent" not in got[1, 1]
    kinds = lambda h, *names: {x.step: x.issue_type for x in P.payloads(t, types(*names), h).collect()}
    assert kinds("flat", "Bug", "Alpha") == {2: "Bug"} and kinds("epic_task", "Bug", "Story") == {1: "Story", 2: "Story"} and kinds("story_subtask", "Task", "Bug") == {1: "Task", 2: "Task"}


def test_updates_can_clear(spark):
    t = spark.createDataFrame([("1", "a", "b"), ("2", "c", "d")], "id string, title string, use_case string")
    kept, _ = V.upsert(t, spark.createDataFrame([("1", None, None, ["use_case"]), ("2", "x", None, None)], "id string, title string, use_case string, cleared array<string>"))
    assert sorted(tuple(x) for x in kept.collect()) == [("1", "a", None), ("2", "x", "d")]


def test_nested_trees_and_files(spark, tmp_path):
    shape = "doc_id string, nodes array<struct<title:string, nodes:array<struct<title:string, nodes:array<struct<title:string>>>>>>"
    trees = spark.createDataFrame([("d", [("a", [("b", [("c",)]), ("e", [])]), ("f", None)]), ("e", [])], shape)
    assert [(x.title, x.pos, x.parent_pos, x.level) for x in N.nested_nodes(trees).orderBy("pos").collect()] == [("a", 1, None, 1), ("b", 2, 1, 2), ("c", 3, 2, 3), ("e", 4, 1, 2), ("f", 5, None, 1)]
    rows = spark.createDataFrame([(f"d{i}", p, f"{p}") for i in range(5) for p in range(4)], "doc_id string, pos int, node_id string")
    io.write_tree(rows, str(tmp_path / "t"), 4)
    assert io.read_tree(spark, str(tmp_path / "t")).count() == 20 and {x.doc_id for x in io.read_tree(spark, str(tmp_path / "t"), "d3", 4).collect()} == {"d3"}
    (tmp_path / "x").mkdir()
    (tmp_path / "x/one.json").write_text(json.dumps({"kids": [{"type": "heading", "heading level": 1, "content": "H", "kids": [{"type": "paragraph", "content": "p"}]}]}, indent=1))
    assert [(x.doc_id, x.type, x.content) for x in S.flat_elements(io.read_elements(spark, str(tmp_path / "x"))).orderBy("pos").collect()] == [("one", "heading", "H"), ("one", "paragraph", "p")]


def test_pluggable_tokenizer(spark):
    rows = spark.createDataFrame([(1, "a bb"), (2, ""), (3, None)], "i int, text string")
    assert {x.i: x.n for x in rows.select("i", T.token_count(F.col("text"), lambda texts: [len(t) for t in texts]).alias("n")).collect()} == {1: 4, 2: 0, 3: 0}


def test_alignment(spark):
    g = spark.createDataFrame([("s", "the red gate"), ("t", "x")], "section string, title string")
    a = spark.createDataFrame([("s", "The gate!")], "section string, title string")
    assert {x.section: round(x.alignment, 6) for x in E.alignment(g, a).collect()} == {"s": round(2 / 3, 6), "t": 0.0}


def _drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_streams_of_usage_steps_and_status(spark, tmp_path):
    rows = [("2024-01-01 01:00:00", "i", "m", 3, 1, "r", "step.completed", '{"step":"s","seconds":1.5,"items":2}'), ("2024-01-01 01:10:00", "i", "m", 4, 1, "r", "other", "{}"), ("2024-01-01 09:00:00", "i", "m", 9, 9, "r", "step.completed", '{"step":"s","seconds":1.0,"items":1}')]
    shape = "ts string, instance string, model string, input_tokens long, output_tokens long, run_id string, event string, payload string"
    events = spark.createDataFrame(rows, shape).withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    _drain(ST.token_usage_stream(stream()), "usage", "append")
    assert [(x.model, x.input_tokens, x.output_tokens) for x in spark.table("usage").collect()] == [("m", 7, 2)]
    _drain(ST.step_summary_stream(stream()), "steps", "append")
    assert [(x.run_id, x.step, x.n, x.seconds, x["items"]) for x in spark.table("steps").collect()] == [("r", "s", 1, 1.5, 2)]
    _drain(ST.run_status_stream(stream()), "status", "update")
    assert [(x.run_id, x.event) for x in spark.table("status").collect()] == [("r", "step.completed")]
    q = ST.append_stream(stream(), str(tmp_path / "out"), str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_golden_match_one_to_one(spark):
    """The sum of scores of the best of all assignments, on small sections; no ticket is taken twice."""
    import itertools

    r = random.Random(4)
    rows, best = [], {}
    for k in range(40):
        m, n = r.randrange(1, 6), r.randrange(1, 6)
        score = {(g, a): r.choice([0.5, 0.6, 0.75, 1.0, round(r.random(), 3)]) for g in range(m) for a in range(n) if r.random() < 0.7}
        rows += [(f"s{k}", g, 100 + a, x) for (g, a), x in score.items()]
        options = ([None, *range(n)] for _ in range(m))
        best[f"s{k}"] = max(sum(score[g, a] for g, a in enumerate(p) if a is not None) for p in itertools.product(*options) if len({a for a in p if a is not None}) == sum(a is not None for a in p) and all(a is None or (g, a) in score for g, a in enumerate(p)))
    got = E.one_to_one(spark.createDataFrame(rows, "section string, golden_id int, actual_id int, score double")).collect()
    for s, want in best.items():
        mine = [x for x in got if x.section == s]
        assert len({x.golden_id for x in mine}) == len({x.actual_id for x in mine}) == len(mine) and abs(sum(x.score for x in mine) - want) < 1e-9
    g = spark.createDataFrame([("s", 1, "build the gate"), ("s", 2, "build the gate now")], "section string, golden_id int, title string")
    a = spark.createDataFrame([("s", 7, "build the gate"), ("s", 8, "build a gate now")], "section string, actual_id int, title string")
    assert sorted((x.golden_id, x.actual_id) for x in E.golden_match(g, a, 0.3, unique=True).collect()) == [(1, 7), (2, 8)]


def test_golden_match_by_all_pairs(spark):
    r = random.Random(9)
    said = lambda: " ".join(["the"] + [f"w{min(r.randrange(30), r.randrange(30))}" for _ in range(r.randint(0, 6))])
    g, a = ([(s, i, said()) for s in "xy" for i in range(30)] for _ in range(2))
    words = lambda t: set(re.findall(r"\w+", t.lower()))
    for least in (0.3, 0.5, 1.0):
        want = set()
        for s, i, t in g:
            rated = [(len(words(t) & words(u)) / len(words(t) | words(u)), -j) for e, j, u in a if e == s]
            top = max(x for x in rated)
            if top[0] >= least:
                want.add((s, i, -top[1], round(top[0], 9)))
        got = E.golden_match(spark.createDataFrame(g, "section string, golden_id int, title string"), spark.createDataFrame(a, "section string, actual_id int, title string"), least)
        assert {(x.section, x.golden_id, x.actual_id, round(x.score, 9)) for x in got.collect()} == want and want
