"""The Merkle manifest against a plain loop."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from docflow.llm import common, manifest

ROWS = "doc_id long, source string, lang string, n_chars long, text string, key string, n int, rank string, h double, block string, above string"


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(row, more=0):
    values = [row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4]]
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(nodes):
    """The root, and for each node what stands beside it on its way up."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            other = level[i ^ 1] if i ^ 1 < len(level) else ""
            ways[k].append((other, "") if i % 2 else ("", other))
            at[k] = i // 2
        level = [_h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], ways


def _expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[g] = _tree([_leaf(r) for r in groups[g]])
    root, tops = _tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for r, way in zip(groups[g], trees[g][1], strict=True):
            way = way + top
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc = _leaf(r, int(changed))
            for left, right in way:
                acc = _h(left, acc, right)
            out.append((r[0], _leaf(r), trees[g][0], root, _h(*(a + b for a, b in way)), acc, acc == root))
    return out


def _got(spark, rows):
    found = manifest.proofs(spark.createDataFrame([(*r, "x", 1, "y", 0.5, None, "z") for r in rows], ROWS), changed=manifest.add_one)
    found = found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("way")), manifest.folded(F.coalesce("changed_leaf", "leaf"), F.col("way")).alias("f")).withColumn("v", F.expr("f = root"))
    return [tuple(r) for r in found.collect()]


def test_manifest(spark):
    """More than two rounds of blocks in one group, single leaves, null ids, groups, values; ids and rows that repeat; empty and long texts."""
    r = random.Random(3)
    text = lambda: r.choice([None, "", "é" * r.randrange(5), "long " * 3000, "a:b-"])
    rows = [(i, r.choice(["s", None, ""]), "en" if i < 600 else r.choice(["de", None, "", "-", "é", "z"]), r.choice([None, 0, -3, i]), text()) for i in range(700)]
    rows += [(None, "s", "en", 1, "t"), (None, "s", None, None, None), (5, "s", "en", 2, "other"), *[(7, "s", "en", 7, "same")] * 3, (1, None, "single", 7, "one")]
    want = _expected(rows)
    assert sorted(map(str, _got(spark, rows))) == sorted(map(str, want))
    assert any(x[-1] for x in want) and not all(x[-1] for x in want)


def test_manifest_small(spark):
    for rows in ([(3, "s", "en", 1, "t")], [(3, "s", "en", 1, "t"), (4, "s", "de", 1, "t")], [(i, "s", "en", 1, "t") for i in range(257)]):
        assert sorted(map(str, _got(spark, rows))) == sorted(map(str, _expected(rows)))
    assert _got(spark, []) == []


def test_manifest_finds_changes(spark):
    """A change to any field of a row, or its doubling shows in the root; the order of the input does not."""
    rows = [(i, "s", "en", i, f"text {i}") for i in range(40)]
    root = _got(spark, rows)[0][3]
    assert _got(spark, rows[::-1])[0][3] == root
    for other in (rows + rows[:1], [*rows[:9], (9, "s", "de", 9, "text 9"), *rows[10:]]):
        assert _got(spark, other)[0][3] != root


def test_ranked(spark):
    r = random.Random(4)
    rows = [(r.choice("aaaab"), r.randrange(50), i) for i in range(2000)]
    got = common.ranked(spark.createDataFrame(rows, "key string, x int, i int").repartition(5), "key", ["x", "i"], "t").collect()
    want = {k: sorted((x, i) for q, x, i in rows if q == k) for k in "ab"}
    assert len(got) == 2000 and all(want[g.key][g["rank"]] == (g.x, g.i) and g.n == len(want[g.key]) for g in got)
