"""MinHash near-duplicate detection by a signature-coordinate inverted join, confirmed on full sets.

A document's set: the distinct 3-word shingles of its text, A-Z lower-cased, words being runs of anything but ASCII white
space; with fewer words, all of them as one; without words, empty. Two documents are linked where 100 times the
intersection is at least 85 times the union. Components: everything reachable by links.

How it is dealt:
1. Documents with equal sets are one node. A node has a signature of COORDINATES minima. Coordinate and value are a token.
2. Linked sets agree in LEAST_MATCHES of 64 coordinates but for a chance of 8e-9 at a similarity of exactly 0.85 (the
   binomial tail; far less above). So only nodes with that many shared tokens are looked at, and of those, ordered from
   rare to common, the last LEAST_MATCHES - 1 are left out: whatever agrees in enough tokens still meets in one that is left.
   This keeps lists of common tokens short: only what has little else is posted there.
3. A token's list is compared in bounded units (a long list in pairs of parts) by counting equal coordinates, tile
   against tile; tiles that are joined already are skipped. Units return a spanning forest of what passes the threshold.
4. What the forests connect is compared on full sets, again in bounded units: a component that is too large for one is
   split by set size (sizes more than 0.84 apart can't be linked) and then into pairs of parts. Tiles of documents give
   their intersections as products of incidence matrices over the shingles that at least two of them have. Units again
   return forests, whose components are the result. No pair that isn't in a forest leaves a task.

Nulls and odd rows: a null or empty text has an empty set and is linked with nothing. Rows that repeat stay repeated.
Links are between ids: rows that repeat an id with other texts join their components. A null doc_id takes no part; its
component_id and kept are null. Further columns, of whatever name, are left aside. An empty table gives an empty one.
Texts are read whole; hashing and signatures go in bounded pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, write_read
from .simhash import _join_labels, connected

SHINGLE_WORDS = 3
SEED = 42
#: Linked where 100 * intersection >= PERCENT * union.
PERCENT = 85
COORDINATES = 64
LEAST_MATCHES = 36
#: Rows of a unit's part; rows up to which a unit needs no tiles; rows of a tile.
PART_ROWS = 4096
SMALL = 48
TILE = 128
#: Documents and bytes of sets in a part, when full sets are compared; columns of a matrix.
SET_ROWS = 2048
SET_BYTES = 16 << 20
SLAB = 4096
CHUNK = 4096
_RANDOM = np.random.Generator(np.random.PCG64(SEED))
_FACTORS = _RANDOM.integers(0, 2**64, COORDINATES, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**64, COORDINATES, dtype=np.uint64)


def shingles(text: bytes | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted XXH64 values of a text's set. bytes.lower() and bytes.split() know only ASCII, as wanted."""
    from xxhash import xxh64_intdigest as digest

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1))


def signature(hashes: np.ndarray) -> np.ndarray:
    """For each coordinate the upper half of the least value that any shingle has there."""
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[None, at : at + CHUNK] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, key, tag, sig): key is a 128-bit hash of the set, tag the half of it; for empty sets they and sig are null."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in _slices(batches):
            sizes, keys, tags, sigs = [], [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py())
                sizes.append(len(own))
                keys.append(xxh3_128_digest(own.tobytes()) if len(own) else None)
                tags.append(int.from_bytes(keys[-1][:8], "little", signed=True) if len(own) else None)
                sigs.append(signature(own) if len(own) else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(tags, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "key", "tag", "sig"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, key binary, tag long, sig array<int>")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray | pa.Array]]:
    """Whole units of rows sorted by their first column, as many as a batch ends with."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column(0).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(unit != unit[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if not cut and held and held[-1].column(0)[-1].as_py() != unit[-1]:
            yield pa.concat_batches(held)
            held = []
        elif cut:
            yield pa.concat_batches([*held, batch.slice(0, cut)]) if held else batch.slice(0, cut)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _starts(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    return starts, np.diff(np.concatenate((starts, [len(unit)])))


def _forest(labels: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
    """The pairs of different ids that the labels join, larger id first."""
    child = np.flatnonzero(labels != np.arange(len(labels)))
    a, b = rep[child], rep[labels[child]]
    a, b = np.maximum(a, b)[a != b], np.minimum(a, b)[a != b]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _collisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, rep, sig) to a forest (a, b) of what has LEAST_MATCHES equal coordinates."""
    for lot in _units(batches):
        unit, rep = (lot.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        sig = lot.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)
        starts, sizes = _starts(unit)
        labels = np.arange(len(unit))
        small = np.repeat(sizes <= SMALL, sizes)
        left = np.repeat(starts + sizes, sizes) - labels  # rows to the end of the unit
        for d in range(1, SMALL):
            i = np.flatnonzero(small & (left > d))
            if not len(i):
                break
            i = i[labels[i] != labels[i + d]]
            i = i[(sig[i] == sig[i + d]).sum(axis=1) >= LEAST_MATCHES]
            _join_labels(labels, i, i + d)
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            for a in range(s, s + n, TILE):
                for b in range(a, s + n, TILE):
                    x, y = slice(a, min(a + TILE, s + n)), slice(b, min(b + TILE, s + n))
                    if (labels[x] == labels[a]).all() and (labels[y] == labels[a]).all():
                        continue
                    i, j = np.nonzero((sig[x][:, None] == sig[y][None]).sum(axis=2) >= LEAST_MATCHES)
                    _join_labels(labels, i + a, j + b)
        yield _forest(labels, rep)


def _parted(rows: DataFrame, unit: list[str], salt: list[str]) -> DataFrame:
    """rows (unit columns, parts, ...), each in the units (a long) that it belongs to: one, or one for each part that its own part meets."""
    part = F.pmod(F.xxhash64(*salt), F.col("parts")).cast("int")
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("unit", F.xxhash64(*unit, F.least("part", "other"), F.greatest("part", "other")))
    return rows.drop("part", "other", "parts")


def candidates(nodes: DataFrame) -> DataFrame:
    """A forest (a, b) over the ids of nodes (rep, tag, sig) that connects all that share LEAST_MATCHES coordinates."""
    token = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("col").cast("long").bitwiseAND(0xFFFFFFFF))
    posted = nodes.select("rep", "tag", F.posexplode("sig")).select("rep", "tag", token.alias("token"))
    shared = write_read(posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "shared_tokens")
    met = posted.join(shared.hint("merge"), "token").groupBy("rep", "tag").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    met = met.where(F.size("tokens") >= LEAST_MATCHES).withColumn("tokens", F.slice("tokens", F.lit(1), F.size("tokens") - (LEAST_MATCHES - 1)))
    met = write_read(met, "posted")
    lists = met.join(nodes.select("rep", "tag", "sig").hint("merge"), ["rep", "tag"]).select("rep", "tag", "sig", F.explode("tokens").alias("t"))
    lists = lists.select("rep", "tag", "sig", F.col("t.token").alias("token"), F.ceil(F.col("t.n") / PART_ROWS).cast("int").alias("parts"))
    units = _parted(lists, ["token"], ["rep", "tag"]).select("unit", "rep", "sig")
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_collisions, "a long, b long")


def _sets(docs: DataFrame) -> DataFrame:
    """(comp, rep, text) to (comp, rep, n, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            own = [shingles(x.as_py()) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["comp", "rep", "n", "hashes"])

    return docs.mapInArrow(run, "comp long, rep long, n long, hashes binary").where("n > 0")


def _intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The size of each intersection of a set of x with one of y."""
    sizes = [len(s) for s in (*x, *y)]
    values, column, times = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    use = times[column] > 1
    place = np.cumsum(times > 1) - 1
    row, column = row[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(x), len(y)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, SLAB):
        a, b = np.searchsorted(column, (at, at + SLAB))
        slab = np.zeros((len(sizes), SLAB), np.float32)
        slab[row[a:b], column[a:b] - at] = 1
        out += (slab[: len(x)] @ slab[len(x) :].T).astype(np.int64)
    return out


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, rep, hashes) to a forest (a, b) of exact links."""
    for lot in _units(batches):
        unit, rep = (lot.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        labels = np.arange(len(unit))
        for s, n in zip(*(x.tolist() for x in _starts(unit)), strict=True):
            if n == 1:
                continue
            _, first, same = np.unique(rep[s : s + n], return_index=True, return_inverse=True)
            _join_labels(labels, np.arange(s, s + n), s + first[same])
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in lot.column(2).slice(s, n)]
            sizes = np.array([len(x) for x in sets])
            for a in range(0, n, TILE):
                for b in range(a, n, TILE):
                    x, y = slice(a, a + TILE), slice(b, b + TILE)
                    if (labels[s:][x][: n - a] == labels[s + a]).all() and (labels[s:][y][: n - b] == labels[s + a]).all():
                        continue
                    both = _intersections(sets[x], sets[y])
                    i, j = np.nonzero(100 * both >= PERCENT * (sizes[x][:, None] + sizes[y][None] - both))
                    _join_labels(labels, i + a + s, j + b + s)
        yield _forest(labels, rep)


def links(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """A forest (a, b) of exact links between the documents (doc_id, text) of each group. groups: (rep, comp), written."""
    own = docs.join(groups.hint("merge"), docs["doc_id"] == groups["rep"]).select("comp", "rep", F.col("text").cast("binary").alias("text"))
    level = F.floor(F.log(F.col("n").cast("double")) / -float(np.log(PERCENT / 100 - 0.01)))
    sets = write_read(_sets(own), "sets")
    sizes = sets.groupBy("comp", level.alias("level")).agg(F.count("*").alias("rows"), F.sum(8 * F.col("n")).alias("bytes")).groupBy("comp").agg(F.collect_list(F.struct("level", "rows", "bytes")).alias("levels"))

    def parts(levels: Column) -> Column:
        total = lambda c: F.aggregate(levels, F.lit(0).cast("long"), lambda n, x: n + x[c])
        return F.greatest(F.ceil(total("rows") / SET_ROWS), F.ceil(total("bytes") / SET_BYTES), F.lit(1)).cast("int")

    # a group has as many levels as there are sizes 0.84 apart: few, however large it is
    sizes = write_read(sizes.withColumn("parts", parts(F.col("levels"))), "set_sizes")
    dealt = sets.select("comp", "rep", "hashes", level.alias("own")).join(sizes.hint("merge"), "comp")
    at_once = dealt.where("parts = 1").select(F.xxhash64("comp").alias("unit"), "rep", "hashes")
    # a large group's unit of a level holds that level and the next one
    large = dealt.where("parts > 1").withColumn("level", F.explode(F.array("own", F.col("own") - 1)))
    large = large.withColumn("parts", parts(F.filter("levels", lambda x: x["level"].between(F.col("level"), F.col("level") + 1))))
    large = _parted(large.select("comp", "level", "parts", "rep", "hashes"), ["comp", "level"], ["rep", "hashes"]).select("unit", "rep", "hashes")
    return at_once.unionByName(large).repartition("unit").sortWithinPartitions("unit").mapInArrow(_confirmed, "a long, b long")


def _reached(edges: DataFrame) -> DataFrame:
    """(rep, comp) for every id that has an edge."""
    stars = connected(edges)
    return stars.select(F.col("a").alias("rep"), F.col("root").alias("comp")).unionByName(stars.select(F.col("root").alias("rep"), F.col("root").alias("comp"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_shingles, component_id) for each row of docs. Ids are longs."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sigs = write_read(signatures(own, "doc_id", "text"), "signatures")
    known = sigs.where("doc_id is not null and key is not null")
    nodes = write_read(known.groupBy("key", "tag").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "nodes")
    groups = write_read(_reached(candidates(nodes)), "candidates")
    found = links(own, groups)
    rows = write_read(sigs.select("doc_id", "n_shingles", "key").join(nodes.select("key", "rep").hint("merge"), "key", "left").select("doc_id", "n_shingles", "rep"), "rows")
    odd = write_read(rows.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id"), "repeated_ids")
    same = rows.join(odd.hint("merge"), "doc_id").where("rep is not null").select(F.greatest("doc_id", "rep").alias("a"), F.least("doc_id", "rep").alias("b"))
    homes = write_read(_reached(found.unionByName(same)), "homes")
    out = rows.withColumn("at", F.coalesce("rep", "doc_id")).join(homes.withColumnRenamed("rep", "at").hint("merge"), "at", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "at")).alias("component_id"))


def op12_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


ORACLE = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
numbered AS (SELECT doc_id, len(s) AS n, s FROM sets),
posted AS (SELECT doc_id, n, unnest(s) AS x FROM numbered),
shares AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS m, any_value(b.n) AS n FROM posted a JOIN posted b ON a.x = b.x AND a.doc_id < b.doc_id
    AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shares WHERE 100 * c >= 85 * (m + n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON e.a = r.b)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(r.least_id, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(r.least_id, doc_id)) AS kept
FROM numbered LEFT JOIN (SELECT a, min(b) AS least_id FROM reached GROUP BY a) r ON r.a = doc_id
"""
