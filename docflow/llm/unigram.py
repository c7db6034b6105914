"""Token counts of a unigram vocabulary without building tokens.

Text is cut into words as unigram tokenizers do: blanks become a mark, the text gets one in front unless it begins with
one, and each mark begins a word. In each word an Aho-Corasick automaton gives every piece that ends at each character;
the best score and its number of pieces are carried along. Of equal scores the piece that begins first wins; a
character without a piece of its own costs the lowest score less 10, and counts as its UTF-8 bytes if the vocabulary
has all byte pieces, else as one token for a whole run.

Pieces and scores are read from a sentencepiece file. Words that come again are looked up in two bounded tables.

Nulls and odd rows: a null or empty text has 0 tokens. Repeated rows give repeated results. Texts are counted whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
UNKNOWN = 10.0
CACHE_WORDS = 150_000
CACHE_CHARS = 48


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> list[tuple[str, float]]:
    """All pieces of a sentencepiece file with their scores, the unknown piece first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN
        names = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.now: dict[str, int] = {}
        self.before: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one word, its mark included."""
        n = len(word)
        score, count, odd = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.find.iter(word):
            ending[end].append(found)
        for end in range(1, n + 1):
            best, start, single = None, 0, False
            for size, own in sorted(ending[end - 1], reverse=True):
                single |= size == 1
                if best is None or score[end - size] + own > best:
                    best, start = score[end - size] + own, end - size
            strange = not single and (best is None or score[end - 1] + self.unknown > best)
            if strange:
                best, start = score[end - 1] + self.unknown, end - 1
            score[end], odd[end] = best, strange
            more = 1 if not strange else len(word[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not odd[start])
            count[end] = count[start] + more
        return count[n]

    def _known(self, word: str) -> int:
        found = self.before.get(word)
        if found is None:
            found = self.word(MARK + word)
        if len(word) <= CACHE_CHARS:
            if len(self.now) >= CACHE_WORDS:
                self.before, self.now = self.now, {}
            self.now[word] = found
        return found

    def count(self, text: str) -> int:
        words = text.replace(MARK, " ").split(" ") if text else []
        if words and not words[0]:
            words = words[1:]  # the text begins with a mark of its own
        now, known = self.now.get, self._known
        return sum([now(w) or known(w) for w in words])


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One a Python worker."""
    return Counter(pieces(path))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) for each row."""
    path = path or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            n = [c.count(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
