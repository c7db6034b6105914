"""MinHash near-duplicates against all pairs of full sets."""

import random
import re

import numpy as np
import pytest

from docflow.llm import minhash

ROWS = "doc_id long, text string, rep string, comp int, n double, key string, tag string"


def _set(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({" ".join(w)} if w else set())


def _expected(rows):
    """component by id, over all pairs; rows that share an id are joined."""
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, _set(t)) for i, t in rows if i is not None and _set(t)]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if 100 * both >= 85 * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted((str(i), len(_set(t)), str(None if i is None else root(i))) for i, t in rows)


def _rows():
    r = random.Random(5)
    word = lambda: f"w{r.randrange(4000)}"
    texts = []
    for size, copies, most in ((60, 50, 6), (150, 40, 12), (400, 25, 30), (12, 20, 2)):
        base = [word() for _ in range(size)]
        line = [word() for _ in range(size // 2)]
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randrange(most)):
                own[r.randrange(size)] = word()
            texts.append(" ".join(own))
            base = own if r.random() < 0.2 else base  # chains
            texts.append(" ".join(line + [word() for _ in range(size // 2)]))  # half the words in common: no link
    for n in (20, 40, 100, 200):  # sets at and beside the border: n shingles in common, the union 100 / 85 of it
        base = [word() for _ in range(n + 2)]
        texts.append(" ".join(base))
        for more in (n * 15 // 85, n * 15 // 85 + 1):
            texts.append(" ".join(base + [word() for _ in range(more)]))
    texts += ["", None, " \n", "one", "One", "one two", "one  Two\t", "one two three", "a b a b a b a b", "b a b a b", "É x", "é x", "long " * 5000, " ".join(f"l{i}" for i in range(30000))]
    texts.append(" ".join(f"l{i}" for i in range(29000)))
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, None), (3, texts[3]), (3, texts[100]), (100, texts[3]), (9999, texts[5]), (9999, texts[8])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates(spark, monkeypatch, small):
    rows = _rows()
    if small:  # every list and group is split
        for name, value in (("PART_ROWS", 20), ("SET_ROWS", 15), ("SET_BYTES", 20000)):
            monkeypatch.setattr(minhash, name, value)
    got = minhash.near_duplicates(spark.createDataFrame([(*x, "r", 1, 0.5, "k", None) for x in rows], ROWS)).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == _expected(rows)


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], ROWS)).count() == 0
    assert minhash.near_duplicates(spark.createDataFrame([(1, None, "", 1, 0.0, "", "")], ROWS)).collect() == [(1, 0, 1)]


def test_tiles():
    """The compiled parts in units of more rows than a tile and more columns than a slab."""
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 9000, 700).astype(np.uint64)) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:25]]
    assert minhash._intersections(sets[:25], sets[25:]).tolist() == want
    assert minhash._intersections([np.zeros(0, np.uint64)], [np.arange(3).astype(np.uint64)]).tolist() == [[0]]


def test_signatures_agree_as_sets_do():
    r = np.random.default_rng(7)
    agree = []
    for _ in range(60):
        both, a, b = (r.integers(0, 2**64, n, dtype=np.uint64) for n in (170, 15, 15))
        agree.append((minhash.signature(np.concatenate((both, a))) == minhash.signature(np.concatenate((both, b)))).sum())
    assert abs(np.mean(agree) / 64 - 0.85) < 0.03 and min(agree) >= minhash.LEAST_MATCHES
