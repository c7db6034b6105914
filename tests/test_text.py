"""Scalars against worked cases."""

import json

from pyspark.sql import functions as F

from docflow.functions import issues as I
from docflow.functions import retry as R
from docflow.functions import text as T


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(x).alias(k) for k, x in values.items()] or ["id"]).select(col.alias("x")).first()[0]


def test_json_repair(spark):
    assert one(spark, T.json_repair(F.lit('Here:\n```json\n[{"title":"a"}]\n```'))) == '[{"title":"a"}]'
    assert one(spark, T.json_repair(F.lit("nope"))) is None
    assert one(spark, T.json_lenient(F.lit('{"a": None, "b": "None"}'))) == '{"a":null,"b":"None"}'
    assert one(spark, T.json_lenient(F.lit(None).cast("string"))) == "{}"


def test_judge(spark):
    good = one(spark, T.judge_scores(F.lit('```json\n{"alignment": 1.0, "recall": 0.8, "fidelity": 0.9, "hallucination": 0.0, "reasoning": "Excellent match"}\n```')))
    assert good.asDict() == {"alignment": 1.0, "recall": 0.8, "fidelity": 0.9, "hallucination": 0.0, "reasoning": "Excellent match"}
    bad = one(spark, T.judge_scores(F.lit("Invalid non-JSON response")))
    assert (bad.alignment, bad.hallucination) == (0.0, 1.0) and bad.reasoning.startswith("Error parsing")


def test_pages_and_contents(spark):
    assert [one(spark, T.page_of_tag(F.lit(x))) for x in ("<physical_index_7>", "physical_index_12", "abc")] == [7, 12, None]
    assert one(spark, T.dots_to_colon(F.lit("Scope ........ 4"))) == "Scope :  4"
    line = one(spark, T.toc_line(F.lit("1.2 Scope of work ........ 14")))
    assert (line.structure, line.title, line.page) == ("1.2", "Scope of work", 14)
    assert one(spark, T.toc_line(F.lit("Annex"))).page is None
    assert one(spark, T.table_markdown(F.expr("array(named_struct('cells', array(named_struct('content', 'a|b', 'kids', cast(array() as array<struct<content:string>>)))))"))) == "| a\\|b |\n|---|"
    assert one(spark, T.embedding_text(F.lit("T"), F.lit(None).cast("string"))) == "T"
    assert one(spark, T.sentences(F.lit("A. B . ."))) == ["A", "B"]
    assert one(spark, T.token_count(F.lit(None).cast("string"))) == 0


def test_errors_and_waits(spark):
    none = F.lit(None).cast("int")
    said = {"HTTP 429": True, "got 503": True, "connection reset by peer": True, "error 401": False, "403": False, "invalid api key": False, "x 404 y": False, "other": False}
    assert {m: one(spark, R.retryable(none, F.lit(m))) for m in said} == said
    headers = F.create_map(F.lit("retry-after"), F.lit("17"), F.lit("x-ratelimit-reset"), F.lit("9999999999"))
    hint = one(spark, R.wait_hint(headers, F.lit(""), F.lit(1.7e9)))
    assert (hint.source, hint.seconds) == ("retry-after-header", 17.0)
    empty = F.expr("cast(map() as map<string,string>)")
    assert one(spark, R.wait_seconds(R.wait_hint(empty, F.lit("no"), F.lit(1.7e9)), F.lit(2), 300)) == 2.0
    assert one(spark, R.wait_hint(empty, F.lit("Try again in 2 minutes"), F.lit(1.7e9))).seconds == 120.0


def test_issues(spark):
    assert one(spark, I.labels(F.array(F.lit("LOW_CONFIDENCE"), F.lit("NO_MOCKUP")))) == ["sow-low-confidence"]
    assert one(spark, I.issue_type(F.lit("Epic"), ["Story"], F.array(F.lit("Story"), F.lit("Bug")))) == "Story"
    assert one(spark, I.issue_key(F.lit("made PROJ-12"), "PROJ")) == "PROJ-12"
    assert one(spark, I.issue_key(F.lit("none"), "PROJ")) == "UNKNOWN"


def test_scrub_at_every_depth(spark):
    s = "section_title"
    cases = [({s: 1, "a": [{s: 2, "b": {"c": {s: 3, "é": [[{s: 4}], 1.5, None, True]}}}]}, {"a": [{"b": {"c": {"é": [[{}], 1.5, None, True]}}}]}), ([{s: 1}], [{}]), ({"k": s}, {"k": s})]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(cases)] + [(9, "{odd"), (10, None)], "i int, j string")
    got = {r.i: r.j for r in rows.select("i", T.scrub(F.col("j")).alias("j")).collect()}
    assert [json.loads(got[i]) for i in range(3)] == [want for _, want in cases] and got[9] is None and got[10] is None
