"""Removal of repeated sentence spans against a brute-force version of its own."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docflow.llm import spans

ROWS = "doc_id long, text string, extra string"
MASK = (1 << 64) - 1


def word_key(word: str) -> int:
    """The upper 32 bits of a word's hash, by the definition with big integers."""
    own = word.encode()
    x = sum(int(spans._BYTES[c]) * pow(spans._BASE, i, 1 << 64) for i, c in enumerate(own)) + len(own) * 0xFF51AFD7ED558CCD & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return (x ^ x >> 31) >> 32


def sentences(text: str) -> list[str]:
    """Parts of a text that joined give it back, one sentence each."""
    tokens = re.findall(r"[^ \t\n\v\f\r]+[ \t\n\v\f\r]*", text)
    if not tokens:
        return []
    lead = text[: len(text) - len(text.lstrip(" \t\n\v\f\r"))]
    whole, now = [], []
    for t in tokens:
        now.append(t)
        if t.rstrip(" \t\n\v\f\r")[-1] in ".!?" or "\n" in t:
            whole.append(now)
            now = []
    whole += [now] if now else []
    parts = []
    for s in whole:
        cuts = set()
        if len(s) > spans.MOST_WORDS:
            keys = [word_key(t.rstrip(" \t\n\v\f\r")) for t in s]
            for i in range(len(s) - spans.MOST_WORDS + 1):
                near = range(i, i + spans.MOST_WORDS)
                cuts.add(min(near, key=lambda j: (keys[j], -j)) + 1)
        at = 0
        for cut in sorted(cuts | {len(s)}):
            parts.append("".join(s[at:cut]))
            at = cut
    parts[0] = lead + parts[0]
    return parts


def fold(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def own_spans(parts: list[str]) -> list[tuple[int, int, tuple]]:
    out = []
    words = [re.findall(r"[^ \t\n\v\f\r]+", fold(p)) for p in parts]
    for a in range(len(parts)):
        for b in range(a + spans.SENTENCES, len(parts) + 1):
            run = tuple(w for own in words[a:b] for w in own)
            if len(run) >= spans.LEAST_WORDS:
                out.append((a, b, run))
                break
    return out


def brute(docs: list[tuple]) -> dict[tuple, tuple[int, int, str]]:
    """(id, text) to (n_sentences, n_removed, text); here texts that share an id must not share a span."""
    seen, out = {}, {}
    for d, t in sorted({(d, t) for d, t, *_ in docs if d is not None and t is not None}, key=lambda x: x[0]):
        parts, gone = sentences(t), set()
        for a, b, run in own_spans(parts):
            if seen.setdefault(run, (d, t, a)) != (d, t, a):
                gone |= set(range(a, b))
        out[d, t] = (len(parts), len(gone), "".join(p for i, p in enumerate(parts) if i not in gone) if gone else t)
    return out


def texts(r: random.Random) -> list[str]:
    word = lambda: r.choice(["a", "B", "c", "dd", "E", "é", "漢"]) + str(r.randint(0, 60))
    line = lambda: " ".join(word() for _ in range(r.randint(1, 14))) + r.choice([". ", "! ", "\n", " \n\t", " ", ".\n\n", "\x0b"])
    passage = "".join(line() for _ in range(12))
    long = " ".join(word() for _ in range(60))
    return [r.choice(["", "  ", "\n x"]) + "".join(line() for _ in range(r.randint(0, 6))) + r.choice(["", passage, long, passage + passage]) + "".join(line() for _ in range(r.randint(0, 3))) for _ in range(12)]


def test_sentences_and_spans_of_a_lot():
    r = random.Random(2)
    for size in (spans.PIECE_BYTES, 64):
        for _ in range(40):
            own = texts(r) + ["", "ab", "word " * 40, "\n\n"]
            try:
                spans.PIECE_BYTES, keep = size, spans.PIECE_BYTES
                for row, to, data, offsets in spans.lots(pa.array([t.encode() for t in own], pa.binary())):
                    s = spans.Sentences(data, offsets)
                    assert np.diff(s.docs).tolist() == [len(sentences(t)) for t in own[row:to]]
                    start, stop = s.spans()
                    want = [(s.docs[i] + a, s.docs[i] + b) for i, t in enumerate(own[row:to]) for a, b, _ in own_spans(sentences(t))]
                    assert list(zip(start.tolist(), stop.tolist(), strict=True)) == want
            finally:
                spans.PIECE_BYTES = keep


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    docs = [(i, t, "x") for i, t in enumerate(texts(r) + texts(r))]
    docs += [(50, None, "x"), (51, "", "x"), (None, docs[0][1], "x"), (None, None, "x"), (53, "One. Two. ", "x"), (53, "One. Two. ", "x"), docs[5]]
    got = spans.without_repeats(spark.createDataFrame(docs, ROWS)).collect()
    assert sorted((str(g.doc_id) for g in got)) == sorted(str(d) for d, *_ in docs)
    want = brute(docs)
    for g in got:
        if g.doc_id is not None and g.text is not None:
            t = next(t for d, t, _ in docs if d == g.doc_id)
            assert (g.n_sentences, g.n_removed, g.text) == want[g.doc_id, t]
    assert {g.text for g in got if g.doc_id is None} == {None, docs[0][1]}
    assert next(g.text for g in got if g.doc_id == 50) is None


def test_same_id_other_text(spark):
    """A text that repeats nothing stays whole, also beside a repeat under the same id; ids may be strings."""
    a, b = " ".join(f"a{i}." for i in range(80)), " ".join(f"b{i}." for i in range(80))
    for ids, kind in (((1, 2), "long"), (("p", "q"), "string")):
        rows = [(ids[0], a), (ids[1], a), (ids[1], b)]
        got = spans.without_repeats(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()
        assert {(g.doc_id, g.text) for g in got} == {(ids[0], a), (ids[1], ""), (ids[1], b)}
    assert spans.without_repeats(spark.createDataFrame([], ROWS)).count() == 0


def test_clashing_columns_and_long_texts(spark):
    a = " ".join(f"w{i % 7000}" for i in range(200_000))
    rows = [(1, a, 1, 2, 3), (2, "x y z. " + " ".join(f"w{i}" for i in range(100)), 1, 2, 3)]
    got = {g.doc_id: g for g in spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, h long, k long, cuts long")).collect()}
    assert len(got[1].text) < len(a) // 20 and got[2].n_removed > 10  # the text repeats itself


def test_passages_in_long_sentences(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(51))
    docs = [(k, " ".join(f"x{rng.random()}" for _ in range(k)) + f" {passage} " + " ".join(f"y{rng.random()}" for _ in range(9)), "") for k in range(1, 25)]
    got = {r.doc_id: r for r in spans.without_repeats(spark.createDataFrame(docs, ROWS)).collect()}
    assert got[1].n_removed == 0
    for k in range(2, 25):
        assert sum(w.startswith("p") for w in got[k].text.split()) <= 30 and got[k].n_removed >= 3
    for words in (["a"] * 50, passage.split()[:50], [f"v{rng.randrange(9)}" for _ in range(50)]):  # also with few different words
        for k in range(1, 25):
            own = [{run for _, _, run in own_spans(sentences(" ".join(["q"] * n + words + ["r"] * n)))} for n in (k, 0)]
            assert any("q" not in run and "r" not in run for run in own[0] & own[1])
