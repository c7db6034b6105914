"""Token counts against the tokenizers library."""

import random

from docflow.llm import unigram

ROWS = "doc_id long, text string, extra string"


def test_counts_equal_tokenizers():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = unigram.pieces(unigram.default_vocabulary())
    own = unigram.Counter(vocabulary)
    other = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    other.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    r = random.Random(1)
    bits = ["a", "the", "ing", " ", "  ", "\n", "é", "漢", "😀", "tion", "1", "aaaa", "<s>", "▁", "x", "Ж", "\t", "qzx"]
    for _ in range(1500):
        s = "".join(r.choice(bits) for _ in range(r.randint(0, 40)))
        assert own.count(s) == len(other.encode(s, add_special_tokens=False).ids), repr(s)
    small = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("aa", -2.0), ("ab", -1.5), ("b", -3.0), ("▁a", -3.0)]
    own, other = unigram.Counter(small), Tokenizer(models.Unigram(small, unk_id=0, byte_fallback=False))
    other.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    for _ in range(800):
        s = "".join(r.choice("aabxy ") for _ in range(r.randint(0, 15)))
        assert own.count(s) == len(other.encode(s, add_special_tokens=False).ids), repr(s)


def test_count_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "a", "x"), (4, "the " * 40000, "x")]
    got = unigram.token_counts(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == 6 and {r.doc_id: r.n_tokens for r in got}[1] == 0
    assert unigram.token_counts(spark.createDataFrame([], ROWS)).count() == 0
