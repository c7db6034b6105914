"""Declared schemas of the data model."""

from pyspark.sql import types as T

STATUSES = ("OPEN", "CLOSED", "MERGED", "REJECTED", "APPROVED", "PUSHED")
FLAGS = ("NO_ACCEPTANCE_CRITERIA", "AMBIGUOUS_SCOPE", "INCOMPLETE", "LOW_CONFIDENCE", "NO_MOCKUP", "POTENTIAL_DUPLICATE", "GAP_RECOVERED")
HIERARCHIES = ("flat", "epic_task", "story_subtask")

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType())}


def _fields(text: str) -> list[T.StructField]:
    """Fields of "name kind, name kind"; needs no running session."""
    return [T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(","))]


SOURCE_REF = T.StructType(_fields("node_id string, section_title string, page_start int, page_end int, snippet string"))
RAW_TASK = T.StructType(
    _fields(
        "title string, short_description string, acceptance_criteria strings, use_case string, considerations_constraints strings, "
        "deliverables strings, mockup_prototype string, confidence double, flags strings, continues_to_next boolean"
    )
)
TASK = T.StructType(
    [
        *_fields("id string"),
        *RAW_TASK.fields,
        *_fields("status string"),
        T.StructField("source_refs", T.ArrayType(SOURCE_REF)),
        *_fields("merged_from strings, created_at timestamp, updated_at timestamp"),
    ]
)
TELEMETRY = T.StructType(_fields("ts timestamp, event string, payload string"))
AUDIT = T.StructType(_fields("id bigint, run_id string, timestamp timestamp, agent string, node_id string, action string, task_id string, detail string, llm_tokens_used bigint, llm_model string"))
