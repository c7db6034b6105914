"""Column functions that build issue fields from tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label that stands for each flag.
LABELS = {
    "NO_ACCEPTANCE_CRITERIA": "sow-no-ac",
    "AMBIGUOUS_SCOPE": "sow-ambiguous",
    "INCOMPLETE": "sow-incomplete",
    "LOW_CONFIDENCE": "sow-low-confidence",
    "GAP_RECOVERED": "sow-gap-recovered",
    "POTENTIAL_DUPLICATE": "sow-potential-dup",
}
# What stands where a field is empty.
NO_CRITERIA = "⚠️ *Could not be determined — requires manual review*"


def _bullets(items: Column, empty: str) -> Column:
    return F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("* "), x)), "\n")).otherwise(F.lit(empty))


def _or(text: Column, empty: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(empty))


def description(t: dict[str, Column]) -> Column:
    """The long description: a headed part for each field, with fallbacks, and where the task came from."""
    # The headings and what stands for an empty field.
    parts = [
        ("Short Description", _or(t["short_description"], "_Not specified_")),
        ("Use Case", _or(t["use_case"], "_Not specified_")),
        ("Acceptance Criteria", _bullets(t["acceptance_criteria"], NO_CRITERIA)),
        ("Considerations & Constraints", _bullets(t["considerations_constraints"], "_None identified_")),
        ("Deliverables", _bullets(t["deliverables"], "_Not specified_")),
        ("Mockup / Prototype", _or(t["mockup_prototype"], "_N/A_")),
    ]
    text = F.concat(*[F.concat(F.lit(f"h3. {name}\n"), said, F.lit("\n\n" if i < len(parts) - 1 else "\n")) for i, (name, said) in enumerate(parts)])
    ref = F.get(t["source_refs"], 0)
    where = F.concat(
        F.lit("\nh3. SOW Reference\nSection: *"), ref["section_title"], F.lit("* | Pages: "), ref["page_start"].cast("string"), F.lit("–"), ref["page_end"].cast("string"), F.lit(" | Node: "), ref["node_id"]
    )
    return F.concat(text, F.coalesce(where, F.lit("")))


def short_description(said: Column, criteria: Column) -> Column:
    return F.concat(F.lit("Description:\n"), F.coalesce(said, F.lit("")), F.lit("\n\nAcceptance Criteria:\n"), F.array_join(F.coalesce(criteria, F.array().cast("array<string>")), "\n"))


def labels(flags: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.filter(F.transform(flags, lambda f: F.try_element_at(known, f)), lambda x: x.isNotNull())


def summary(title: Column) -> Column:
    return F.substring(title, 1, 255)


def container_summary(section: Column) -> Column:
    return F.concat(F.lit("[SOW] "), F.substring(section, 1, 240))


def issue_type(desired: Column, fallbacks: list[str], available: Column) -> Column:
    """The desired type if it is there, else the first fallback that is, else the first of all, else the desired one."""
    there = F.array_sort(available)
    first = F.get(F.filter(F.array(*[F.lit(x) for x in fallbacks]), lambda x: F.array_contains(available, x)), 0)
    return F.when(F.array_contains(available, desired), desired).otherwise(F.coalesce(first, F.get(there, 0), desired))


def issue_key(response: Column, project: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(response, rf"{project}-\d+", 0), F.lit("")), F.lit("UNKNOWN"))
