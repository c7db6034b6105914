"""Merkle manifest of a dataset: a binary hash tree per group, a tree over the groups, and a proof for every row.

H is the lowercase hex SHA-256 of its inputs, concatenated, digests as hex text. A leaf is H of a row's fields, each `-`
if null, else its UTF-8 byte count, a colon and its value. The leaves of a group ascend by id; while more than one node
remains, every two in a row (of the last run, one if they are odd) become their H; what remains is the group's subroot.
The subroots, null group first, then by UTF-8 bytes, give the root in the same way.

How it is dealt: ranks come from ranges (common.ranked), never from one task a group. The lowest digits of a rank, each
of BITS binary levels, are columns of their own; the rows of a block, those that share all higher digits, are grouped by
ever fewer of these digits, and each grouping nests the structs of its children and hashes BITS levels. That takes one
shuffle a round, and a block holds at most 2**LEVELS rows, whatever its group's size. The nodes of the blocks are the
rows of the next, 2**LEVELS times smaller round. Proofs come down the same way: a block's own way to the root enters its grouping as one further row, and a
final transform over the nested structs, exploded, gives every row its way. No proof is joined to anything.

Nulls and odd rows: null fields hash as `-`; a null id stands before all others in its group, a null group is a group of
its own. Rows that share an id are ordered by their leaves, so rows that repeat entirely get a place each, and the result
is the same as a bag. Empty strings hash as `0:`. Texts are hashed whole. Further columns, of whatever name, are left
aside. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, table, write_read

#: Binary levels that a digit of the rank stands for, digits of a block, and so the levels of a block.
BITS = 4
DIGITS = 2
LEVELS = BITS * DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:string,right:string>>"


def leaf(values: list[Column]) -> Column:
    """The hash of a row's fields."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _leaves(level: Column) -> Column:
    """Leaves below a full node of a level."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def _digits(nodes: DataFrame) -> DataFrame:
    """nodes (key, n, rank, ...) with the block and the digits of the rank inside it, the lowest first."""
    own = [F.shiftright("rank", BITS * j).bitwiseAND((1 << BITS) - 1).cast("byte").alias(f"d{j}") for j in range(DIGITS)]
    return nodes.select("*", F.shiftright("rank", LEVELS).alias("block"), *own)


def _grouped(rows: DataFrame, first_level: int, carry: bool) -> DataFrame:
    """One row (key, n, block, node, above) a block; above is what its further row carried.

    node: h, its hash; with carry also kids, the nodes one digit below, and hashes, those of the BITS levels from the kids' upwards.
    """

    def higher(all_: Column, j: Column) -> Column:
        last = F.element_at(all_, -1)
        pair = lambda i: F.sha2(F.concat(F.get(last, 2 * i), F.coalesce(F.get(last, 2 * i + 1), F.lit(""))), 256)
        joined = F.transform(F.sequence(F.lit(0), F.floor((F.size(last) - 1) / 2).cast("int")), pair)
        return F.concat(all_, F.array(F.when(F.col("n") > _leaves(j), joined).otherwise(last)))

    for k in range(DIGITS):
        rest, kept = [f"d{i}" for i in range(k + 1, DIGITS)], ["above"] if carry else []
        kids = F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct(F.col(f"d{k}").alias("d"), "node"))))
        rows = rows.groupBy("key", "n", "block", *rest).agg(kids.alias("kids"), *[F.max(c).alias(c) for c in kept])
        level = first_level + k * BITS
        hashes = F.aggregate(F.sequence(F.lit(level), F.lit(level + BITS - 1)), F.array(F.transform("kids", lambda x: x["node"]["h"])), higher)
        rows = rows.select("key", "n", "block", *rest, "kids", hashes.alias("hashes"), *kept)
        own = [F.element_at("hashes", -1)[0].alias("h"), *(["kids", "hashes"] if carry else [])]
        rows = rows.select("key", "n", "block", *rest, F.struct(*own).alias("node"), *kept)
    return rows


def _up(nodes: DataFrame, first_level: int) -> DataFrame:
    """The nodes (key, n, rank, h) LEVELS levels above."""
    rows = _digits(nodes).select("key", "n", "block", *[f"d{j}" for j in range(DIGITS)], F.struct("h").alias("node"))
    return _grouped(rows.repartition("key", "block"), first_level, carry=False).select("key", "n", F.col("block").alias("rank"), F.col("node.h").alias("h"))


def _down(nodes: DataFrame, first_level: int, above: DataFrame | None, own: list[str]) -> DataFrame:
    """own columns of the nodes, with h, way, subroot and root of each. above: (key, block, above) for every block, none at the very top.

    way: for each level upwards what stands left and right of the node there.
    """
    digits = [f"d{j}" for j in range(DIGITS)]
    kind = f"struct<way:{_STEPS},subroot:string,root:string>"
    rows = _digits(nodes).select("key", "n", "block", *digits, F.struct("h", F.struct(*own).alias("own")).alias("node"), F.lit(None).cast(kind).alias("above"))
    if above is not None:
        place = above.select("key", "n", "block", *[F.lit(0).cast("byte").alias(d) for d in digits], F.lit(None).cast(rows.schema["node"].dataType).alias("node"), F.col("above").cast(kind).alias("above"))
        rows = rows.unionByName(place)
    blocks = _grouped(rows.repartition("key", "block"), first_level, carry=True)

    def steps(hashes: Column, i: Column, level: int) -> Column:
        """What stands beside kid i of a node, on BITS levels upwards."""

        def beside(j: Column) -> Column:
            at = F.call_function("shiftright", i, j)
            other = F.coalesce(F.get(F.get(hashes, j), at.bitwiseXOR(F.lit(1))), F.lit(""))
            return F.struct(F.when(at % 2 == 1, other).otherwise("").alias("left"), F.when(at % 2 == 0, other).otherwise("").alias("right"))

        joining = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda j: F.col("n") > _leaves(j + level))
        return F.transform(joining, beside)

    def ways(node: Column, k: int, below: list[Column]) -> Column:
        """An array with a struct for each leaf below node, which has k digits below it."""
        if not k:
            way = F.concat(*below, F.coalesce(F.col("above.way"), F.array().cast(_STEPS)))
            return F.array(F.struct(node["own"].alias("own"), node["h"].alias("h"), way.alias("way")))
        return F.flatten(F.transform(node["kids"], lambda x, i: ways(x["node"], k - 1, [steps(node["hashes"], i, first_level + (k - 1) * BITS), *below])))

    out = blocks.select(F.explode(ways(F.col("node"), DIGITS, [])).alias("x"), F.col("above.subroot").alias("subroot"), F.coalesce("above.root", "node.h").alias("root"))
    return out.select(*[F.col(f"x.own.{c}").alias(c) for c in own], "x.h", "x.way", "subroot", "root")


def _rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The nodes of every round, written out, up to the one in which every key has a single block; and that above it."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    found, level = [nodes], 0
    while level == 0 or most > 1 << level:
        found.append(write_read(_up(found[-1], level), f"{name}_{level}"))
        level += LEVELS
    return found


def _ways(rounds: list[DataFrame], above: DataFrame | None, own: list[str], name: str) -> DataFrame:
    """_down through all rounds, from the top."""
    for k in range(len(rounds) - 2, 0, -1):
        out = _down(rounds[k], k * LEVELS, above, ["key", "n", "rank"])
        above = write_read(out.select("key", "n", F.col("rank").alias("block"), F.struct("way", "subroot", "root").alias("above")), f"{name}_ways_{k}")
    return _down(rounds[0], 0, above, own)


def proofs(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", id_col: str = "doc_id", changed: Callable[[str, Column], Column] | None = None) -> DataFrame:
    """One row for each row of docs: (doc_id, leaf, changed_leaf, way, subroot, root).

    changed gives for a field and its column the value that the row shall have been changed to; changed_leaf is its leaf
    where it differs, else null. way holds for each level, from the leaf's to the root's, what stands left and right.
    """
    own = leaf([F.col(c) for c in fields])
    other = leaf([changed(c, F.col(c)) for c in fields]) if changed else F.lit(None).cast("string")
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = docs.select(key.alias("key"), F.col(id_col).alias("doc_id"), own.alias("h"), other.alias("changed_leaf"))
    leaves = leaves.withColumn("changed_leaf", F.when(F.col("changed_leaf") != F.col("h"), F.col("changed_leaf")))
    leaves = write_read(ranked(write_read(leaves, "leaves"), "key", [F.col("doc_id").asc_nulls_first(), "h"], "leaves"), "leaves_ranked")
    groups = _rounds(leaves, "groups")
    subroots = groups[-1].select(F.lit("").alias("key"), F.col("key").alias("group"), F.col("n").alias("rows"), "h")
    tops = _rounds(write_read(ranked(subroots, "key", ["group"], "subroots"), "subroots_ranked"), "tops")
    above = _ways(tops, None, ["group", "rows"], "tops")
    above = write_read(above.select(F.col("group").alias("key"), F.col("rows").alias("n"), F.lit(0).cast("long").alias("block"), F.struct("way", F.col("h").alias("subroot"), "root").alias("above")), "subroot_ways")
    return _ways(groups, above, ["doc_id", "changed_leaf"], "groups").select("doc_id", F.col("h").alias("leaf"), "changed_leaf", "way", "subroot", "root")


def folded(start: Column, way: Column) -> Column:
    """The root that a leaf and its way give."""
    return F.aggregate(way, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(way: Column) -> Column:
    """H of all siblings on a way, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(way, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def add_one(field: str, value: Column) -> Column:
    """The tampering of the query: where 7 divides the CRC-32 of the doc_id, n_chars is one more."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, value + 1).otherwise(value) if field == "n_chars" else value


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    found = proofs(table(spark, sf_dir, "documents"), changed=add_one)
    found = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("way")).alias("proof_sha256"), folded(F.coalesce("changed_leaf", "leaf"), F.col("way")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, x: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"

ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT *, sha256({" || ".join(_FIELD.format(c) for c in FIELDS)}) AS h,
    CASE WHEN {_CRC} % 7 = 0 THEN sha256({" || ".join(_FIELD.format("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS)}) END AS other
  FROM documents),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, r AS i, h, n FROM ranks
  UNION ALL
  SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2, n),
tops AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, lang FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2, NULL FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
steps AS (
  SELECT lang, level, i, h, false AS top FROM nodes
  UNION ALL
  SELECT NULL, level, i, h, true FROM tops),
walk AS (
  SELECT doc_id, h AS leaf, lang, r AS i, 0 AS level, n, false AS top, h AS own, coalesce(other, h) AS acc, '' AS proof, NULL::VARCHAR AS subroot FROM ranks
  UNION ALL
  SELECT w.doc_id, w.leaf, w.lang,
    CASE WHEN w.n = 1 THEN t.i ELSE w.i // 2 END,
    CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END,
    CASE WHEN w.n = 1 THEN t.n ELSE (w.n + 1) // 2 END,
    w.top OR w.n = 1, w.own,
    CASE WHEN w.n = 1 THEN w.acc WHEN w.i % 2 = 0 THEN sha256(w.acc || coalesce(s.h, '')) ELSE sha256(s.h || w.acc) END,
    CASE WHEN w.n = 1 THEN w.proof ELSE w.proof || coalesce(s.h, '') END,
    CASE WHEN w.n = 1 THEN t.h ELSE w.subroot END
  FROM walk w
  LEFT JOIN steps s ON w.n > 1 AND s.level = w.level AND s.i = xor(w.i, 1) AND s.top = w.top AND (w.top OR s.lang IS NOT DISTINCT FROM w.lang)
  LEFT JOIN tops t ON w.n = 1 AND NOT w.top AND t.level = 0 AND t.lang IS NOT DISTINCT FROM w.lang
  WHERE w.n > 1 OR NOT w.top)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM walk, (SELECT h AS root FROM tops WHERE n = 1) WHERE top AND n = 1
"""
