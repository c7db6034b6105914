"""SimHash near-duplicate detection.

Fingerprints: 64 bits from the XXH64 values (seed 42) of word 3-shingles; a bit is 1 if over half of the shingles'
values have it. Links: 3 or fewer differing bits. Components: everything reachable by links.

How the work is dealt: equal fingerprints are one node, so a group of exact copies costs one row. Two fingerprints
that differ in at most 3 bits agree in at least two of five blocks, so each distinct fingerprint goes to ten keys
(block pair and the bits of both) and every link meets in some key: nothing is lost. A key with more than
TILE_ROWS fingerprints is split into parts, and each pair of parts is a task's unit of its own. Inside a unit the
fingerprints are sorted by population count and compared tile against tile with exclusive-or and bit counts; a tile
pair whose population counts lie more than the radius apart can't hold a link and is skipped. A unit returns only a
spanning forest of its links, at most one row for each of its rows.

Nulls and odd rows: a null or empty text has no words and the fingerprint zero, which is linked like any other. Rows
that repeat stay repeated. A null doc_id gets a fingerprint, but no component (null) and takes no part in links. Links
are between ids: rows that repeat an id with other texts link their components (keep_one() tells rows apart instead).
Further columns, of whatever name, are left aside, and kept by keep_one(). An empty table gives an empty one. Whole texts
are hashed, however long, in bounded pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, write_read

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TILE_ROWS = 4096
TILE = 512
SMALL = 48
CHUNK = 1 << 16


def fingerprint(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one UTF-8 text. bytes.lower() and bytes.split() know only ASCII, as wanted."""
    from xxhash import xxh64_intdigest as digest

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), CHUNK):
        part = [digest(joined[a:b], SEED) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Makes i[k] and j[k] share a label, for all k; labels[x] is always the smallest index known to be joined to x."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def _tiled(fp: np.ndarray, labels: np.ndarray, at: int) -> None:
    """Joins the labels of one large unit, rows at..at+len(fp)."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    own, ones = fp[order], np.bitwise_count(fp)[order].astype(np.int16)
    place = order + at
    for a in range(0, len(own), TILE):
        left = own[a : a + TILE]
        for b in range(a, len(own), TILE):
            if ones[b] - ones[min(a + TILE, len(own)) - 1] > RADIUS:
                break
            i, j = np.nonzero(np.bitwise_count(left[:, None] ^ own[None, b : b + TILE]) <= RADIUS)
            _join_labels(labels, place[i + a], place[j + b])


def _forest(group: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole units; rows of a unit lie together. Returns pairs of representatives."""
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(group)])))
    labels = np.arange(len(group))
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        _tiled(fp[s : s + n], labels, int(s))
    small = np.repeat(sizes <= SMALL, sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(group))  # rows to the end of the unit
    for d in range(1, SMALL):
        i = np.flatnonzero(small & (left > d))
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= RADIUS]
        _join_labels(labels, i, i + d)
    child = np.flatnonzero(labels != np.arange(len(group)))
    return rep[child], rep[labels[child]]


def _unit_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, fp, rep), the rows of a unit together, to links (a, b) with a > b."""
    kept: list[np.ndarray] = []

    def out(rows: list[np.ndarray]) -> pa.RecordBatch:
        x, y = _forest(rows[0], rows[1].view(np.uint64), rows[2])
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        kept = [np.concatenate(p) for p in zip(kept, new, strict=True)] if kept else new
        if not len(kept[0]):
            continue
        cut = int(np.flatnonzero(kept[0] != kept[0][-1])[-1]) + 1 if (kept[0] != kept[0][-1]).any() else 0
        if cut:
            yield out([c[:cut] for c in kept])
            kept = [c[cut:] for c in kept]
    if kept and len(kept[0]):
        yield out(kept)


def links(nodes: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Spanning links (a, b), a > b, between the representatives of distinct fingerprints. nodes: (fp, rep)."""
    bits = [F.shiftrightunsigned("fp", at).bitwiseAND((1 << n) - 1) for at, n in BLOCKS]
    pairs = [(i, j) for i in range(len(BLOCKS)) for j in range(i + 1, len(BLOCKS))]
    keys = [F.lit(k << 26).bitwiseOR(F.shiftleft(bits[i], 13)).bitwiseOR(bits[j]) for k, (i, j) in enumerate(pairs)]
    dealt = nodes.select("fp", "rep", F.explode(F.array(*keys)).alias("key"))
    # written out, so that the join lies between plain exchanges and adaptive execution can split a crowded key
    crowds = write_read(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "crowds")
    parts = F.ceil(F.col("n") / tile_rows).cast("int")
    part = F.pmod(F.xxhash64("fp"), "parts")
    met = (
        dealt.join(crowds.hint("merge"), "key")
        .withColumn("parts", parts)
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))).alias("unit"), "fp", "rep")
    )
    return met.repartition("unit").sortWithinPartitions("unit").mapInArrow(_unit_links, "a long, b long").where("a <> b")


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, root): for every node a with a link to something smaller, the smallest node that it reaches. edges: (a, b) longs.

    Large-star and small-star rounds on joins and minima; each round is written to the shared folder. Minima are summed
    map-side and written out too, so the joins with them lie between plain exchanges, and adaptive execution splits the
    links of a hub.
    """

    edges = write_read(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return edges.withColumnRenamed("b", "root")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = write_read(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"), (F.col("m") < F.col("a")).alias("moved"))
        large = write_read(large, "large")
        low = write_read(large.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"), F.max("moved").alias("moved")), "low")
        roots = low.select("a", F.col("m").alias("b"))
        if not low.agg(F.max(F.col("moved") | (F.col("m") < F.col("most")))).first()[0]:  # every node has one link, to its root
            return roots.withColumnRenamed("b", "root")
        small = large.join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = write_read(small.unionByName(roots).distinct(), "edges")
    raise RuntimeError("connected components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row (doc_id, fp, component_id) for each row of docs; component_id is the smallest doc_id reachable by links."""
    fps = write_read(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = write_read(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    stars = connected(links(nodes, tile_rows))
    homes = nodes.join(stars.hint("merge"), nodes.rep == stars.a, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(homes.hint("merge"), "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of near-duplicates, that with the smallest id (nulls last), then the smallest hash of its text.

    Components are those of fingerprints, and rows are told apart by id and text: rows that share an id with another text
    are documents of their own, and of rows that repeat both one stays. Only ids and hashes meet in joins; what goes is
    written out first, so the strategy of the last join rests on a true size.
    """
    known = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k")).alias("who"), F.col(text_col).alias("text"))
    fps = write_read(fingerprints(known, "who", "text").withColumnRenamed("doc_id", "who"), "fingerprints")
    nodes = write_read(fps.select("fp", F.col("fp").alias("rep")).distinct(), "nodes")
    stars = connected(links(nodes))
    homes = nodes.join(stars.hint("merge"), nodes.rep == stars.a, "left").select("fp", F.coalesce("root", "rep").alias("home"))
    first = fps.join(homes.hint("merge"), "fp").groupBy("home").agg(F.min("who").alias("who"))
    each = write_read(fps.groupBy("who").agg(F.count("*").alias("n")).join(first.select("who", F.lit(True).alias("stays")).hint("merge"), "who", "left"), "rows")
    gone = write_read(each.where("stays is null").select("who.id", "who.k"), "gone")
    twice = write_read(each.where("stays and n > 1").select("who.id", "who.k"), "twice")
    same = lambda other: docs[id_col].eqNullSafe(other["id"]) & (F.xxhash64(docs[text_col]) == other["k"])
    left = docs.join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return left
    once = docs.join(twice, same(twice), "left_semi").dropDuplicates([id_col, text_col])
    return left.join(twice, left[id_col].eqNullSafe(twice["id"]) & (F.xxhash64(left[text_col]) == twice["k"]), "left_anti").unionByName(once)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
