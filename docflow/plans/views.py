"""Derived views of the given tables, once as Spark and once as DuckDB SQL, so that queries and oracles start alike.

A document of the section views is a source's thousand consecutive doc_ids; a run of the task views likewise.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.sources import io


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark, d) -> DataFrame:
    return io.scan_pages(table(spark, d, "documents").select("doc_id", "text"))


def docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id AS n", "concat(source, '-', doc_id div 1000) AS doc_id", "coalesce(text, '') AS text", "regexp_count(coalesce(text, ''), '\\\\S+') AS n_tokens", "lang")


def nodes(spark, d) -> DataFrame:
    rows = docs(spark, d).selectExpr("*", "cast(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS int) AS pos")
    return rows.selectExpr(
        "doc_id", "n", "pos", "lpad(cast(pos - 1 AS string), 4, '0') AS node_id", "cast(1 + n % 4 AS int) AS level", "substring(text, 1, 40) AS title", "text", "cast(n_tokens AS bigint) AS n_tokens",
        "cast(1 + n % 50 AS int) AS page_start", "cast(1 + n % 50 + n % 3 AS int) AS page_end", "concat('summary ', n) AS summary", "lang",
    )


def sections(spark, d) -> DataFrame:
    """nodes as sections to extract tasks from: in every second one the later sentences begin with a verb, and lines name fields."""
    told = "concat(replace(text, '. ', '. Create '), '\\nUse case: as user ', n, '\\nDeliverable: d', n % 9, IF(n % 4 = 0, concat('\\nMockup: m', n), ''))"
    return nodes(spark, d).selectExpr("* EXCEPT (text)", f"IF(n % 2 = 0, {told}, text) AS text")


def books(spark, d) -> DataFrame:
    """The section documents as books of numbered chapters.

    Each node is a page; every third one begins a chapter, with its number and title on the first line. Books of sources
    with even numbers have a page of contents in front, with printed page numbers one below the physical ones; in one of
    three of those the contents name wrong pages, so that they are repaired or left for other modes.
    """
    base = nodes(spark, d).selectExpr("doc_id", "n", "pos", "text", "n_tokens", "cast(regexp_extract(doc_id, '([0-9]+)', 1) AS int) AS k", "concat(cast((pos - 1) div 3 + 1 AS string), ' Chapter of ', n, 'x ', lang) AS head")
    body = base.selectExpr("doc_id", "cast(pos + IF(k % 2 = 0, 1, 0) AS int) AS page_no", "IF((pos - 1) % 3 = 0, concat(head, '\\n', text), text) AS text", "cast(n_tokens AS bigint) AS n_tokens")
    lines = base.where("k % 2 = 0 AND (pos - 1) % 3 = 0").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.expr("concat(head, ' ........ ', IF(k % 3 = 0 AND (pos - 1) % 4 = 0, 1 + pos % 5, pos))").alias("line")))).alias("l"))
    contents = lines.select("doc_id", F.lit(1).alias("page_no"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"), F.lit(0).cast("long").alias("n_tokens"))
    return contents.unionByName(body)


def toc(spark, d) -> DataFrame:
    return nodes(spark, d).selectExpr(
        "doc_id", "pos", "CASE WHEN n % 7 = 0 THEN concat('99.', pos) WHEN (pos - 1) % 4 = 0 THEN cast((pos - 1) div 4 + 1 AS string) ELSE concat((pos - 1) div 4 + 1, '.', (pos - 1) % 4) END AS structure", "title",
        "CASE WHEN n % 11 > 0 THEN cast(2 + (pos * 3) div 2 AS int) END AS physical_index", "CASE WHEN n % 5 > 0 THEN cast(2 + (pos * 3) div 2 - 1 - cast(n % 17 = 0 AS int) AS int) END AS page", "n % 2 = 1 AS appear_start", "n % 3 > 0 AS found", "60 AS n_pages",
    )


def book_pages(spark, d) -> DataFrame:
    """The section documents as books: each of its documents is one page."""
    return nodes(spark, d).selectExpr("doc_id", "pos AS page_no", "text", "n_tokens", "n")


def tasks(spark, d) -> DataFrame:
    return table(spark, d, "documents").selectExpr(
        "concat('T', lpad(cast(doc_id AS string), 9, '0')) AS id", "concat(source, '-', doc_id div 1000) AS run_id", "doc_id AS pos", "substring(coalesce(text, ''), 1, 80) AS title", "coalesce(text, '') AS short_description",
        "CASE WHEN doc_id % 3 = 0 THEN array(concat('[ ] a', doc_id % 5), concat('b', doc_id % 7)) WHEN doc_id % 3 = 1 THEN array('[ ] x') END AS acceptance_criteria",
        "CASE WHEN doc_id % 4 = 0 THEN concat('As a user ', doc_id) END AS use_case", "CASE WHEN doc_id % 5 = 0 THEN array('c1', concat('c', doc_id % 3)) END AS considerations_constraints",
        "CASE WHEN doc_id % 6 = 0 THEN array(concat('d', doc_id % 9)) END AS deliverables", "CASE WHEN doc_id % 8 = 0 THEN concat('mock ', doc_id) END AS mockup_prototype", "cast(doc_id * 37 % 100 AS double) / 100 AS confidence",
        "CASE doc_id % 4 WHEN 0 THEN array('LOW_CONFIDENCE', 'NO_MOCKUP') WHEN 1 THEN array('AMBIGUOUS_SCOPE', 'ODD', 'INCOMPLETE') WHEN 2 THEN cast(array() AS array<string>) ELSE array('NO_ACCEPTANCE_CRITERIA') END AS flags",
        "doc_id % 5 = 0 AS continues_to_next", "element_at(array('OPEN', 'CLOSED', 'MERGED', 'REJECTED', 'APPROVED', 'PUSHED'), cast(doc_id % 6 + 1 AS int)) AS status",
        "CASE WHEN doc_id % 13 > 0 THEN array(named_struct('node_id', cast(doc_id AS string), 'section_title', concat('S', doc_id % 10), 'page_start', cast(doc_id % 50 AS int), 'page_end', cast(doc_id % 50 + 2 AS int), 'snippet', '')) END AS source_refs",
    )


def audit(spark, d) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_id AS id", "user_id AS run_id", "ts", "event_type AS agent", "concat('a', get_json_object(props, '$.k')) AS action", "cast(floor(value) AS bigint) AS llm_tokens_used", "concat('m', event_id % 3) AS model",
        "concat('i', event_id % 2) AS instance", "value", "CASE WHEN event_id % 4 = 0 THEN 'DEBUG' ELSE 'INFO' END AS level", "concat(event_type, ' ', props) AS message", "props",
    )


#: DuckDB SQL of the same views; a view may name those above it.
SQL = {
    "v_pages": """SELECT doc_id, p AS page_no, array_to_string(l[(p - 1) * 5 + 1 : p * 5], chr(10)) AS text, len(regexp_extract_all(array_to_string(l[(p - 1) * 5 + 1 : p * 5], chr(10)), '\\S+')) AS n_tokens
      FROM (SELECT doc_id, l, unnest(range(1, (len(l) + 4) // 5 + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))""",
    "v_docs": """SELECT doc_id AS n, source || '-' || (doc_id // 1000) AS doc_id, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS n_tokens, lang FROM documents""",
    "v_nodes": """SELECT doc_id, n, pos, lpad((pos - 1)::VARCHAR, 4, '0') AS node_id, 1 + n % 4 AS level, substr(text, 1, 40) AS title, text, n_tokens, 1 + n % 50 AS page_start, 1 + n % 50 + n % 3 AS page_end, 'summary ' || n AS summary, lang
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS pos FROM v_docs)""",
    "v_sections": """SELECT * EXCLUDE (text), CASE WHEN n % 2 = 0 THEN replace(text, '. ', '. Create ') || chr(10) || 'Use case: as user ' || n || chr(10) || 'Deliverable: d' || n % 9 || CASE WHEN n % 4 = 0 THEN chr(10) || 'Mockup: m' || n ELSE '' END ELSE text END AS text FROM v_nodes""",
    "v_chapters": """SELECT doc_id, n, pos, text, n_tokens, regexp_extract(doc_id, '([0-9]+)', 1)::INT AS k, count(*) OVER (PARTITION BY doc_id) AS m, ((pos - 1) // 3 + 1) || ' Chapter of ' || n || 'x ' || lang AS head, 'Chapter of ' || n || 'x ' || lang AS title FROM v_nodes""",
    "v_books": """SELECT doc_id, pos + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS page_no, CASE WHEN (pos - 1) % 3 = 0 THEN head || chr(10) || text ELSE text END AS text, n_tokens FROM v_chapters
      UNION ALL SELECT doc_id, 1, string_agg(head || ' ........ ' || CASE WHEN k % 3 = 0 AND (pos - 1) % 4 = 0 THEN 1 + pos % 5 ELSE pos END, chr(10) ORDER BY pos), 0 FROM v_chapters WHERE k % 2 = 0 AND (pos - 1) % 3 = 0 GROUP BY doc_id""",
    "v_headings": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, i)::INT AS pos, structure, title, page_no::INT AS physical_index FROM (SELECT doc_id, page_no, structure, title, min(i) AS i FROM (SELECT doc_id, page_no, i,
      nullif(regexp_extract(f, r, 1), '') AS structure, trim(regexp_replace(regexp_extract(f, r, 2), '[\\s:.]+$', '')) AS title FROM (SELECT *, regexp_replace(regexp_replace(line, '\\.{5,}', ': ', 'g'), '(?:\\. ){5,}\\.?', ': ', 'g') AS f,
      '^\\s*(?:(\\d+(?:\\.\\d+)*)\\.?\\s+)?(.*?\\S)\\s*(?:[:.\\s]\\s*(\\d+))?\\s*$' AS r FROM (SELECT doc_id, page_no, i, l[i] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, page_no, string_split(text, chr(10)) AS l FROM v_books)))
      WHERE regexp_matches(line, '^\\s*\\d+(\\.\\d+)*\\.?\\s+\\S') AND len(regexp_extract_all(line, '\\S+')) <= 12)) WHERE structure IS NOT NULL GROUP BY ALL)""",
    "v_parents": """SELECT *, CASE WHEN level > 1 THEN (SELECT max_by(b.node_id, b.pos) FROM v_nodes b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND b.level < a.level) END AS parent_id FROM v_nodes a""",
    "v_ends": """SELECT a.*, coalesce((SELECT min(b.pos) - 1 FROM v_nodes b WHERE b.doc_id = a.doc_id AND b.pos > a.pos AND b.level <= a.level), (SELECT max(b.pos) FROM v_nodes b WHERE b.doc_id = a.doc_id)) AS subtree_end FROM v_nodes a""",
    "v_branch": """SELECT a.*, (SELECT sum(b.n_tokens) FROM v_nodes b WHERE b.doc_id = a.doc_id AND b.pos BETWEEN a.pos AND a.subtree_end)::BIGINT AS branch_tokens FROM v_ends a""",
    "v_toc": """SELECT doc_id, pos, CASE WHEN n % 7 = 0 THEN '99.' || pos WHEN (pos - 1) % 4 = 0 THEN ((pos - 1) // 4 + 1)::VARCHAR ELSE ((pos - 1) // 4 + 1) || '.' || ((pos - 1) % 4) END AS structure, title,
      CASE WHEN n % 11 > 0 THEN 2 + (pos * 3) // 2 END AS physical_index, CASE WHEN n % 5 > 0 THEN 2 + (pos * 3) // 2 - 1 - (n % 17 = 0)::INT END AS page, n % 2 = 1 AS appear_start, n % 3 > 0 AS found, 60 AS n_pages FROM v_nodes""",
    "v_book": "SELECT doc_id, pos AS page_no, text, n_tokens, n FROM v_nodes",
    "v_tasks": """SELECT 'T' || lpad(doc_id::VARCHAR, 9, '0') AS id, source || '-' || (doc_id // 1000) AS run_id, doc_id AS pos, substr(coalesce(text, ''), 1, 80) AS title, coalesce(text, '') AS short_description,
      CASE WHEN doc_id % 3 = 0 THEN ['[ ] a' || doc_id % 5, 'b' || doc_id % 7] WHEN doc_id % 3 = 1 THEN ['[ ] x'] END AS acceptance_criteria, CASE WHEN doc_id % 4 = 0 THEN 'As a user ' || doc_id END AS use_case,
      CASE WHEN doc_id % 5 = 0 THEN ['c1', 'c' || doc_id % 3] END AS considerations_constraints, CASE WHEN doc_id % 6 = 0 THEN ['d' || doc_id % 9] END AS deliverables, CASE WHEN doc_id % 8 = 0 THEN 'mock ' || doc_id END AS mockup_prototype,
      (doc_id * 37 % 100)::DOUBLE / 100 AS confidence,
      CASE doc_id % 4 WHEN 0 THEN ['LOW_CONFIDENCE', 'NO_MOCKUP'] WHEN 1 THEN ['AMBIGUOUS_SCOPE', 'ODD', 'INCOMPLETE'] WHEN 2 THEN []::VARCHAR[] ELSE ['NO_ACCEPTANCE_CRITERIA'] END AS flags, doc_id % 5 = 0 AS continues_to_next,
      (['OPEN', 'CLOSED', 'MERGED', 'REJECTED', 'APPROVED', 'PUSHED'])[doc_id % 6 + 1] AS status, CASE WHEN doc_id % 13 > 0 THEN 'S' || doc_id % 10 END AS section FROM documents""",
    "v_audit": """SELECT event_id AS id, user_id AS run_id, ts, event_type AS agent, 'a' || json_extract_string(props, '$.k') AS action, floor(value)::BIGINT AS llm_tokens_used, 'm' || event_id % 3 AS model, 'i' || event_id % 2 AS instance, value,
      CASE WHEN event_id % 4 = 0 THEN 'DEBUG' ELSE 'INFO' END AS level, event_type || ' ' || props AS message, props FROM events""",
    "v_sentences": """SELECT doc_id, n, node_id, pos, text, i - 1 AS ord, s[i] AS s FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM
      (SELECT doc_id, n, node_id, pos, text, list_filter(list_transform(string_split(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)^\\s*(?:use cases?|considerations?|constraints?|deliverables?|mock-?ups?|prototypes?)\\s*:')), chr(10)), '.'),
        lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM v_sections))""",
    "v_raw": """SELECT doc_id, node_id, pos, ord, substr(s, 1, 80) AS title, s AS short_description FROM v_sentences WHERE regexp_matches(s, '(?i)^(?:Create|Implement|Design|Configure|Integrate|Build|Set up|Develop|Define|Write)(?:[^\\p{L}\\p{N}]|$)|(?:^|[^\\p{L}\\p{N}])(?:must|shall|should|will|needs? to|has to|have to)(?:[^\\p{L}\\p{N}]|$)') AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 50""",
    "v_decisions": """SELECT 'T' || lpad(a.doc_id::VARCHAR, 9, '0') AS id_a, 'T' || lpad((a.doc_id + 20)::VARCHAR, 9, '0') AS id_b,
      (['merge', 'keep_both', 'keep_first', 'keep_second', 'merge'])[a.doc_id % 5 + 1] AS decision FROM documents a WHERE a.doc_id % 7 = 0""",
    "v_dropped": """SELECT id_b AS id, id_a AS "into" FROM v_known WHERE decision IN ('merge', 'keep_first') UNION ALL SELECT id_a, id_b FROM v_known WHERE decision = 'keep_second'""",
    "v_known": """SELECT * FROM v_decisions WHERE id_a IN (SELECT id FROM v_tasks) AND id_b IN (SELECT id FROM v_tasks)""",
}
_ORDER = ["v_pages", "v_docs", "v_nodes", "v_sections", "v_chapters", "v_books", "v_headings", "v_parents", "v_ends", "v_branch", "v_toc", "v_book", "v_tasks", "v_audit", "v_sentences", "v_raw", "v_decisions", "v_known", "v_dropped"]


def oracle(sql: str) -> str:
    """A query with the views that it names put before it."""
    used, todo = set(), [sql]
    while todo:
        for name in re.findall(r"\bv_\w+", todo.pop()):
            if name in SQL and name not in used:
                used.add(name)
                todo.append(SQL[name])
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in _ORDER if n in used)
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if ctes and body.upper().startswith(start):
            return f"{start}{ctes}, {body[len(start):]}"
    return f"WITH {ctes} {body}" if ctes else body
