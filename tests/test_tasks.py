"""Tasks: reading answers, lifecycle, coverage, duplicates, review, issues, streams."""

import json

import pytest
from pyspark.sql import functions as F

from docflow.operators import coverage as C
from docflow.operators import dedup as D
from docflow.operators import lifecycle as L
from docflow.operators import publish as P
from docflow.operators import review as V
from docflow.operators import tasks as K
from docflow.sources import io
from docflow.streaming import telemetry as ST

RAW = "doc_id string, node_id string, ord int, id string, title string, short_description string, acceptance_criteria array<string>, confidence double, flags array<string>, continues_to_next boolean"


def _raw(node, i, title, more):
    return ("d", node, i, f"{node}-{i}", title, f"about {title}", None, 0.5, [], more)


def test_title_ratio():
    assert (L.title_ratio("tide", "diet"), L.title_ratio("diet", "tide")) == (0.25, 0.5)


def _nodes(spark, n):
    return spark.createDataFrame([("d", f"n{i}", i) for i in range(1, n + 1)], "doc_id string, node_id string, pos int")


def test_lifecycle(spark):
    raws = spark.createDataFrame([_raw("n1", 0, "Alpha", False), _raw("n1", 1, "Build the gate", True), _raw("n2", 0, "Build the gates", False)], RAW)
    got = {r.title: r for r in L.task_lifecycle(raws, _nodes(spark, 3)).collect()}
    assert (got["Alpha"].closed_at, got["Build the gate"].closed_at, got["Build the gate"].node_ids) == ("n2", "n3", ["n1", "n2"])
    assert "INCOMPLETE" not in got["Build the gate"].flags
    alone = L.task_lifecycle(spark.createDataFrame([_raw("n1", 0, "Gamma", True)], RAW), _nodes(spark, 2)).first()
    assert alone.status == "CLOSED" and alone.closed_at is None and alone.flags == ["INCOMPLETE"]


def test_read_answers(spark):
    rows = [("d", "a", '```json\n[{"title":"a","short_description":"b","confidence":0.4}, {"short_description":"x"}]\n```'), ("d", "b", "nope"), ("d", "c", '{"a":1}'), ("d", "e", None)]
    good, bad = K.read_answers(spark.createDataFrame(rows, "doc_id string, node_id string, content string"))
    assert [r.title for r in good.collect()] == ["a"]
    assert sorted((r.node_id, r.action) for r in bad.collect()) == [("a", "TASK_PARSE_ERROR"), ("b", "EXTRACTION_ERROR"), ("c", "EXTRACTION_ERROR"), ("e", "EXTRACTION_ERROR")]
    assert K.low_confidence(good).first().flags == ["LOW_CONFIDENCE"]


def test_model_step_failure_is_a_row(spark):
    def broken(_):
        raise ValueError("no model")

    got = K.model_step(spark.createDataFrame([("d", "n", "p")], "doc_id string, node_id string, prompt string"), broken).first()
    assert got.content is None and got.error == "no model"


def test_extract_rules(spark):
    s = spark.createDataFrame([("d", "n", 1, "Create the export. It is blue. The job must run daily.\n[ ] runs")], "doc_id string, node_id string, pos int, text string")
    assert [r.title for r in K.extract_rules(s).orderBy("ord").collect()] == ["Create the export", "The job must run daily"]


def test_fields_are_read_once_a_section(spark):
    """No field is looked for above the step that makes rows of sentences, where it would be for each of them."""
    s = spark.createDataFrame([("d", "n", 1, "Create the export.")], "doc_id string, node_id string, pos int, text string")
    plan = K.extract_rules(s)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Generate inline")
    assert below and "use cases" not in above and all(x in below for x in ("use cases", "deliverables", "constraints", "prototypes"))


def test_coverage(spark):
    nodes = _nodes(spark, 3)
    links = spark.createDataFrame([("d", "n1")], "doc_id string, node_id string")
    assert float(C.coverage_report(nodes, links).first().pct) == 33.3
    assert float(C.coverage_report(nodes, links, compat=True).first().pct) == 66.7


TASK = "id string, run_id string, status string, confidence double, acceptance_criteria array<string>, considerations_constraints array<string>, deliverables array<string>, flags array<string>, use_case string, mockup_prototype string"


def _tasks(spark):
    return spark.createDataFrame([(x, "r", "CLOSED", 0.1 * i, [x], None, None, [], None, f"m{x}") for i, x in enumerate("ABC", 1)], TASK)


def test_decisions(spark):
    ds = spark.createDataFrame([("A", "B", "merge"), ("B", "C", "merge"), ("A", "Z", "merge")], "id_a string, id_b string, decision string")
    got = D.apply_decisions(_tasks(spark), ds).collect()
    assert [(r.id, r.acceptance_criteria, r.merged_from) for r in got] == [("A", ["A", "B"], ["B"])]
    second = spark.createDataFrame([("A", "B", "keep_second")], "id_a string, id_b string, decision string")
    assert sorted(r.id for r in D.apply_decisions(_tasks(spark), second).collect()) == ["B", "C"]
    assert {r.id: r.status for r in D.merge_status(_tasks(spark), second).collect()}["A"] == "MERGED"


def test_similar_pairs_blocks(spark):
    import numpy as np

    r = np.random.default_rng(1)
    vs = r.normal(size=(120, 8))
    vs /= np.linalg.norm(vs, axis=1, keepdims=True)
    rows = [("r" if i < 100 else "q", f"{i:03d}", [float(x) for x in v]) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "run_id string, id string, v array<double>")
    want = {(rows[i][1], rows[j][1]) for i in range(120) for j in range(i + 1, 120) if rows[i][0] == rows[j][0] and vs[i] @ vs[j] >= 0.6}
    for block in (7, 1000):
        assert {(x.id_a, x.id_b) for x in D.similar_pairs(df, 0.6, block).collect()} == want


def test_similar_classes(spark):
    """Links and classes of brute force, over copies, zero vectors, rows that repeat and nulls, in one block and in many."""
    import numpy as np

    r = np.random.default_rng(2)
    vs = r.normal(size=(150, 6))
    vs /= np.linalg.norm(vs, axis=1, keepdims=True)
    vs[20:40], vs[60:70], vs[100:103] = vs[20], vs[5], 0
    rows = [("r" if i < 110 else "q", f"{i:03d}", [float(x) for x in v]) for i, v in enumerate(vs)] + [("r", "003", [float(x) for x in vs[3]]), ("r", None, [1.0] * 6), ("r", "zzz", None)]
    df = spark.createDataFrame(rows, "run_id string, id string, v array<double>")
    want = []
    ok = [(a, i, np.array(v)) for a, i, v in rows if i is not None and v is not None]
    up = {(a, i): i for a, i, _ in ok}
    for _ in range(20):
        for a, i, v in ok:
            up[a, i] = min([up[a, i], *(up[b, j] for b, j, w in ok if b == a and v @ w >= 0.6)])
    for a, i, v in rows:
        n = 0 if i is None or v is None else sum(b == a and np.array(v) @ w >= 0.6 for b, _, w in ok) - int(np.array(v) @ np.array(v) >= 0.6)
        want.append((a, str(i), str(up.get((a, i), i)), int(n)))
    for block in (7, 1000):
        assert sorted((x.run_id, str(x.id), str(x.class_id), x.n_links) for x in D.similar_classes(df, 0.6, block).collect()) == sorted(want)


def test_many_equal_tasks_are_one_class(spark):
    df = spark.range(20_000).selectExpr("'r' AS run_id", "id", "array(0.6D, 0.8D) AS v")
    got = D.similar_classes(df).groupBy("class_id", "n_links").count().collect()
    assert [tuple(x) for x in got] == [(0, 19_999, 20_000)]


def test_components(spark):
    from docflow.operators.graph import components

    chain = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5, 5), (3000, 2999), (2999, 3000)]
    got = {x.node: x.root for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)} | {2999: 2999, 3000: 2999}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_review(spark):
    t = spark.createDataFrame([("1", "r", "PUSHED", []), ("2", "r", "CLOSED", ["X"]), ("3", "r", "APPROVED", [])], "id string, run_id string, status string, flags array<string>")
    assert sorted(r.id for r in V.shown(t, pending=False).collect()) == ["1", "3"]
    assert sorted(r.id for r in V.shown(t, pending=False, approved=False).collect()) == []
    kept, unknown = V.upsert(t, spark.createDataFrame([("2", "REJECTED"), ("9", "OPEN")], "id string, status string"))
    assert {r.id: r.status for r in kept.collect()}["2"] == "REJECTED" and [r.id for r in unknown.collect()] == ["9"]


def test_push_summary(spark):
    rows = [("r", 1, True, None), ("r", 2, True, None), ("r", 3, False, "x")]
    got = P.push_summary(spark.createDataFrame(rows, "run_id string, pos int, success boolean, error string")).first()
    assert (got.passed, got.failed, got.first_error) == (2, 1, "x")


def test_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text(json.dumps({"run_id": "1", "filename": "f", "llm_mode": "m", "created_at": "2024-01-01"}))
    (tmp_path / "s/b.json").write_text("{broken")
    (tmp_path / "s/c.json").write_text(json.dumps({"run_id": "2", "filename": "f", "llm_mode": "m", "created_at": "2024-02-01"}))
    assert [r.run_id for r in io.read_sessions(spark, str(tmp_path / "s")).collect()] == ["2", "1"]
    (tmp_path / "one.md").write_text("# T\nx")
    assert io.read_markdown(spark, str(tmp_path / "one.md")).first() == ("one", "# T\nx")
    out = str(tmp_path / "runs")
    io.write_run_output(_tasks(spark), spark.createDataFrame([("r", 50.0)], "run_id string, pct double"), out)
    assert spark.read.json(out).select(F.size("tasks")).first()[0] == 3
    log = spark.createDataFrame([("r", "DEBUG", "a"), ("r", "INFO", "b")], "run_id string, level string, message string")
    io.write_log(log, str(tmp_path / "log"))
    assert [r.message for r in spark.read.json(str(tmp_path / "log")).collect()] == ["b"]
    audit = spark.createDataFrame([(1, "r", "ag", "act")], "id long, run_id string, agent string, action string")
    for c, kind in (("timestamp", "timestamp"), ("node_id", "string"), ("task_id", "string"), ("detail", "string"), ("llm_tokens_used", "bigint"), ("llm_model", "string")):
        audit = audit.withColumn(c, F.lit(None).cast(kind))
    io.append_audit(audit, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 1


def _drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_streams(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e/1.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T0{h}:10:00Z", "event": "llm.call", "payload": "{}"}) for h in (1, 1, 2, 5)))
    _drain(ST.windowed_counts(ST.read_events(spark, str(tmp_path / "e"))), "counts")
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 2]  # the last window is still open


def test_lifecycle_stream_agrees(spark, tmp_path):
    rows = [("d", "n1", 1, 0, "a", "Alpha", "x", [], 0.5, [], False), ("d", "n1", 1, 1, "b", "Build the gate", "x", [], 0.5, [], True), ("d", "n2", 2, 0, "c", "Build the gates", "y", [], 0.9, [], False), ("d", "n3", 3, 0, None, None, None, None, None, None, None), ("d", ST.END, 4, 0, None, None, None, None, None, None, None)]
    shape = "doc_id string, node_id string, pos int, ord int, id string, title string, short_description string, acceptance_criteria array<string>, confidence double, flags array<string>, continues_to_next boolean"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p{i}"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    _drain(ST.lifecycle_stream(stream), "life")
    got = {r.title: (r.closed_at, r.node_ids, r.confidence) for r in spark.table("life").collect()}
    assert got == {"Alpha": ("n2", ["n1"], 0.5), "Build the gate": ("n3", ["n1", "n2"], 0.9)}


def test_lifecycle_stream_restarts_and_closes_idle_documents(spark, tmp_path):
    """Stopped in the middle of a document, the stream goes on from its checkpoint to the result of the batch; a document without an end is closed by its timer."""
    import time

    shape = "doc_id string, node_id string, pos int, ord int, id string, title string, short_description string, acceptance_criteria array<string>, confidence double, flags array<string>, continues_to_next boolean"
    full = [("d", f"n{p}", p, i, f"{p}-{i}", f"Build gate {i}" if p % 2 else f"Other {p}", "x", [], 0.5, [], p % 3 > 0) for p in range(1, 7) for i in range(2)]
    write = lambda rows, name: spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = lambda: ST.lifecycle_stream(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")))

    def go():
        q = stream().writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    write(full[:5], "a")
    go()
    write(full[5:], "b")
    write([("d", ST.END, 99, 0, *[None] * 7)], "c")
    go()
    nodes = spark.createDataFrame([("d", f"n{p}", p) for p in range(1, 7)], "doc_id string, node_id string, pos int")
    told = lambda df: sorted((r.task_id, str(r.closed_at), tuple(r.node_ids), tuple(r.flags)) for r in df.collect())
    assert told(spark.read.parquet(str(tmp_path / "out"))) == told(L.task_lifecycle(spark.createDataFrame(full, shape), nodes))

    (tmp_path / "idle").mkdir()
    spark.createDataFrame(full[:3], shape).coalesce(1).write.parquet(str(tmp_path / "idle/a"))
    rows = spark.readStream.schema(shape).option("recursiveFileLookup", True).parquet(str(tmp_path / "idle"))
    q = ST.lifecycle_stream(rows, 1).writeStream.outputMode("append").format("memory").queryName("idle").trigger(processingTime="500 milliseconds").start()
    until = time.time() + 90
    while time.time() < until and spark.table("idle").count() < 3:
        time.sleep(0.5)
    q.stop()
    assert sorted(r.task_id for r in spark.table("idle").collect()) == ["1-0", "1-1", "2-0"]


def test_replayed_events_count_once(spark, tmp_path):
    for name, rows in (("a", [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:01:00"), (1, "2024-01-01 00:00:00")]), ("b", [(2, "2024-01-01 00:01:00"), (3, "2024-01-01 00:02:00")])):
        spark.createDataFrame(rows, "id long, ts string").selectExpr("id", "cast(ts AS timestamp) AS ts").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    _drain(ST.once(stream), "once")
    assert sorted(r.id for r in spark.table("once").collect()) == [1, 2, 3]
    assert ST.once(spark.read.option("recursiveFileLookup", True).schema("id long, ts timestamp").parquet(str(tmp_path / "in"))).count() == 3


def test_registry():
    from docflow.plans import registry

    assert registry.FLAGSHIP in registry.QUERIES and set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", ["coverage_report", "tree_thinning", "dedup_apply"])
def test_queries_run(spark, name):
    from docflow.plans import registry

    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_lifecycle_without_continuations_needs_no_groups(spark):
    """The rows of the state machine, by windows alone: ids that come again, flags, missing fields, nodes without tasks or place."""
    shape = (
        "doc_id string, node_id string, ord int, id string, title string, short_description string, acceptance_criteria array<string>, considerations_constraints array<string>, deliverables array<string>, use_case string, "
        "mockup_prototype string, confidence double, flags array<string>, continues_to_next boolean"
    )
    rows = [
        ("d", "n1", 0, "a", "A", None, None, None, ["x", None], "u", None, 0.5, ["INCOMPLETE", "ODD"], False), ("d", "n1", 1, "b", "B", "s", ["c"], [], None, None, "m", 0.9, None, None),
        ("d", "n1", 2, "b", "B2", "s2", None, None, None, None, None, 0.8, [], False), ("d", "n2", 0, "a", "A again", "t", None, None, None, None, None, 0.1, [], False),
        ("d", "n4", 0, "b", "B late", "t", None, None, None, None, None, 0.2, ["LOW_CONFIDENCE"], False), ("d", "n5", 0, "z", "no place", "t", None, None, None, None, None, 0.2, [], False),
        ("e", "n1", 0, "a", "E", "t", None, None, None, None, None, 0.3, ["INCOMPLETE"], False), ("e", "n1", 1, None, "no id", "t", None, None, None, None, None, 0.3, [], True),
    ]
    places = [("d", "n1", 1), ("d", "n2", 2), ("d", "n3", 3), ("d", "n4", 4), ("d", "n5", None), ("e", "n1", 1)]
    raws, nodes = spark.createDataFrame(rows, shape), spark.createDataFrame([(*x, f"S {x[1]}", 1, None) for x in places], "doc_id string, node_id string, pos int, title string, page_start int, page_end int")
    got = L.task_lifecycle(raws, nodes)
    assert "InPandas" not in got._jdf.queryExecution().toString()
    names, want = [f.strip().split()[0] for f in shape.split(",")], []
    for doc in ("d", "e"):
        state, out = L.Lifecycle(), []
        for _, node, _ in sorted((x for x in places if x[0] == doc and x[2] is not None), key=lambda x: x[2]):
            known = {"section_title": f"S {node}", "page_start": 1, "page_end": None}
            out += state.step(node, [dict(zip(names, r, strict=True)) | known for r in rows if r[:2] == (doc, node) and r[3]])
        want += [{"doc_id": doc} | {c: t[c] for c in L.OUT} for t in out + state.end()]
    assert sorted((x.asDict(recursive=True) for x in got.collect()), key=repr) == sorted(want, key=repr) and len(want) == 4
    # a document with a continuation takes the other way, and the rest stay as they are
    more = raws.withColumn("continues_to_next", F.expr("doc_id = 'e'"))
    assert [x.asDict(recursive=True) for x in L.task_lifecycle(more.where("doc_id = 'e'"), nodes).collect()] == [x for x in want if x["doc_id"] == "e"]
    assert L.task_lifecycle(more, nodes).where("doc_id = 'd'").count() == 3


def test_sparse_vectors_meet_like_dense_ones(spark):
    """Pairs, numbers and classes alike; what is dealt to blocks holds no dense vector."""
    rows = [(f"r{i % 2}", f"t{i:03}", f"word{i % 7} word{i % 3} common", f"text {i % 5}" if i % 4 else None) for i in range(120)]
    t = spark.createDataFrame([*rows, ("r0", "empty", "", "")], "run_id string, id string, title string, short_description string")
    dense, sparse = D.text_vectors(t), D.text_vectors(t, sparse=True)
    pairs = [sorted(map(tuple, D.similar_pairs(x, 0.85, block=20).collect())) for x in (dense, sparse)]
    assert pairs[0] == pairs[1] and len(pairs[0]) == 77
    classes = [sorted(map(tuple, D.similar_classes(x, 0.85, block=20).collect())) for x in (dense, sparse)]
    assert classes[0] == classes[1]
    dealt = D._dealt(sparse, 20)
    assert "v" not in dealt.columns and dealt.agg(F.max(F.size("indices"))).first()[0] < 10
