"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text the last token of the prefix's encoding is unique. It is found from earlier
prefixes alone: a token that ends the prefix is the right one if it stands alone or if the pair of it and the last
token of the rest is a valid pair, that is, the merges of the two tokens' bytes give back these two tokens. So an
append only adds entries, and after an edit the entries are the old ones again as soon as as many in a row agree as
the longest token has bytes.

Texts are first cut by the vocabulary's pattern, each match is encoded by itself, and special tokens are not known.
Pieces that come again are looked up in two tables of at most CACHE_PIECES each: when the newer is full it becomes the
older one, so frequent pieces stay and memory is bounded.

Nulls and odd rows: a null text is the empty text: no tokens, and the digests of the empty string. Repeated rows give
repeated results. A text is encoded whole, however long.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

CACHE_PIECES = 150_000
CACHE_CHARS = 48
MOST_PAIRS = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Bpe:
    """One vocabulary of ranks."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {b: a for a, b in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.find = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self._pairs: dict[tuple[int, int], bool] = {}
        self._now: dict[str, tuple[str, int]] = {}
        self._before: dict[str, tuple[str, int]] = {}

    def merges(self, piece: bytes) -> list[int]:
        """The plain merge loop: the pair of lowest rank first, the leftmost of equals. For short pieces."""
        parts, none, rank = [piece[i : i + 1] for i in range(len(piece))], 1 << 60, self.ranks.get
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (low := min(pairs)) < none:
            at = pairs.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether right may follow left."""
        key = left << 32 | right
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) > MOST_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self.merges(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    @functools.cached_property
    def whole(self) -> set[int]:
        """Tokens that the merges of their own bytes give back; others never occur in an encoding."""
        return {t for b, t in self.ranks.items() if self.merges(b) == [t]}

    @functools.cached_property
    def endings(self):
        """An automaton that finds every token in a run of bytes (as Latin-1 text), with its length."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for b, t in self.ranks.items():
            if t in self.whole:
                found.add_word(b.decode("latin-1"), (len(b), t))
        found.make_automaton()
        return found

    def extend(self, data: bytes, last: list[int], offset: int = 0) -> None:
        """Adds the last tokens of the prefixes that follow; last[i] is that of the prefix of i + 1 bytes, and data starts at byte offset."""
        known, pairs, fits = len(last), self._pairs.get, self.fits
        last += [-1] * (offset + len(data) - known)
        for end, (size, token) in self.endings.iter(data.decode("latin-1")):
            end += offset
            if end >= known and last[end] < 0:
                if end < size:
                    last[end] = token
                    continue
                left = last[end - size]
                good = pairs(left << 32 | token)
                if fits(left, token) if good is None else good:
                    last[end] = token
        if -1 in last[known:]:
            raise ValueError("a byte is not in the vocabulary")

    def walk(self, last: list[int]) -> list[int]:
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (token := self.ranks.get(piece)) is not None and token in self.whole:
            return [token]
        last: list[int] = []
        self.extend(piece, last)
        return self.walk(last)

    def encode(self, text: str) -> list[int]:
        return [t for piece in self.find(text) for t in self.encode_piece(piece.encode())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def known(self, piece: str) -> tuple[str, int]:
        """The decimal ids of a piece, joined by spaces, and their number."""
        found = self._before.get(piece)
        if found is None:
            ids = self.encode_piece(piece.encode())
            found = (" ".join(map(str, ids)), len(ids))
        if len(piece) <= CACHE_CHARS:
            if len(self._now) >= CACHE_PIECES:
                self._before, self._now = self._now, {}
            self._now[piece] = found
        return found

    def ids_text(self, text: str) -> tuple[str, int]:
        """The decimal ids of a text, joined by spaces, and their number."""
        known = self.known
        now = self._now.get
        found = [now(p) or known(p) for p in self.find(text)]
        return " ".join([f[0] for f in found]), sum([f[1] for f in found])


class Prefix:
    """The encoding of one growing or edited piece of bytes (no pattern is applied)."""

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, bytearray(), []
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self._next(len(self.data))

    def _next(self, end: int) -> None:
        """Entries up to end, from no more bytes than a token can have before them."""
        low = max(0, len(self.last) - self.bpe.longest)
        self.bpe.extend(bytes(self.data[low:end]), self.last, low)

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Puts data in place of bytes start..stop and encodes anew only near the edit; returns how many entries were computed."""
        after, shift = self.last[stop:], len(data) - (stop - start)
        self.data[start:stop] = data
        del self.last[start:]
        made = same = 0
        while len(self.last) < len(self.data):
            at = len(self.last)
            self._next(at + 1)
            made += 1
            old = at - shift - stop  # place in after
            same = same + 1 if old >= 0 and after[old] == self.last[-1] else 0
            if same >= self.bpe.longest:
                self.last += after[old + 1 :]
        return made

    def tokens(self) -> list[int]:
        return self.bpe.walk(self.last)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    """One a Python worker."""
    return Bpe(path)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) for each row: the ids of its text and the bytes that they decode to."""
    path = path or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [list(map(int, bpe.ids_text(x)[0].split())) if x else [] for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row; ids and bytes stay in the task that made them."""
    path = path or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        by_name = {str(i): b for i, b in bpe.bytes_of.items()}
        for batch in batches:
            counts, ids_hex, decoded_hex = [], [], []
            for value in batch.column(1):
                ids, n = bpe.ids_text(value.as_py() or "")
                counts.append(n)
                ids_hex.append(sha256(ids.encode()).hexdigest())
                decoded_hex.append(sha256(b"".join(map(by_name.__getitem__, ids.split()))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(decoded_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
