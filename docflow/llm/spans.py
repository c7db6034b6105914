"""Removal of passages that repeat across documents, by sliding spans of sentences.

A word is a run of characters other than ASCII white space. A sentence ends behind a word that ends in ., ! or ?, and at
a line's end. In a sentence of more than MOST_WORDS words, its words set where it is cut as well: of each MOST_WORDS
words in a row inside it, behind the one with the smallest hash (the last of equals). So equal passages are cut alike
from their MOST_WORDS-th word to the MOST_WORDS-th from their end, whatever stands around them, also where a text has no
marks at all. A span begins at each sentence and takes in sentences until it has SENTENCES of them and LEAST_WORDS words;
it has LEAST_WORDS + MOST_WORDS - 1 words at most. Hence a repeated passage of 50 words has a whole span in any case.
Spans are compared by 128 bits of a hash of their words (ASCII letters in lower case). Of equal spans the first is the
one with the smallest id, then the smallest hash of its text, then the smallest place; every sentence inside any other
one is removed.

How the work is dealt: words, cuts and hashes are numpy arrays over the bytes of a batch. A first pass ships only 64
bits a span, summed map-side, and leaves the repeated ones (a written table, so the joins that follow are between plain
exchanges and adaptive execution can split a passage that is on a third of all rows). A second pass makes the spans
again and keeps those that met, with their documents; only their full hashes are compared. A document's removals are
gathered before they meet its text.

Nulls and odd rows: a null or empty text has no sentences and stays as it is. A row with a null id is left as it is and
makes no span. Rows that repeat an id and a text are one document and end up alike; rows that repeat an id with another
text are documents of their own. Ids may be of any type that has an order. Further columns are left aside. A long text
is worked on in bounded pieces of bytes; what is held of it whole is a few numbers a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, write_read, written_bytes

SENTENCES = 3
LEAST_WORDS = 21
MOST_WORDS = 10
BROADCAST_BYTES = 1 << 20
#: Bytes of text that are hashed at a time, and that make up one lot of documents.
PIECE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[[33, 46, 63]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
#: A random number for each byte, the same for both cases of an ASCII letter; odd bases of the two hashes and their inverses.
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)[_FOLD]
_BASE = 0x9E3779B97F4A7C15
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), mod 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sentences:
    """The sentences of one lot of texts. ends: for each sentence the word behind it; doc: its text; words: hash and first byte of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """data: the texts' bytes; offsets: where each starts, and the end."""
        first, hashes, ending = [], [], []
        at = 0
        while at < len(data):
            stop = min(len(data), at + PIECE_BYTES)
            if stop < len(data):  # never inside a word
                gaps = np.flatnonzero(_SPACE[data[at:stop]])
                while not len(gaps) and stop < len(data):
                    stop = min(len(data), stop + PIECE_BYTES)
                    gaps = np.flatnonzero(_SPACE[data[at:stop]])
                stop = at + int(gaps[-1]) + 1 if len(gaps) else stop
                while stop < len(data) and _SPACE[data[stop]]:  # nor before white space, which may hold a line's end
                    more = np.flatnonzero(~_SPACE[data[stop : stop + PIECE_BYTES]])
                    stop = stop + int(more[0]) if len(more) else min(len(data), stop + PIECE_BYTES)
            starts, h, ends = self._words(data[at:stop], offsets[(offsets >= at) & (offsets < stop)] - at)
            first.append(starts + at)
            hashes.append(h)
            ending.append(ends)
            at = stop
        self.first = np.concatenate(first) if first else np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        last = np.concatenate(ending) if ending else np.zeros(0, bool)
        n = len(self.first)
        of = np.searchsorted(offsets, self.first, "right") - 1
        if n:
            last |= np.concatenate((of[1:] != of[:-1], [True]))
        if n >= MOST_WORDS:
            sentence = np.concatenate(([0], np.cumsum(last)[:-1]))
            key = (self.hash & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - (np.arange(n, dtype=np.uint64) & np.uint64(0xFFFFFFFF)))
            width = 1
            while width < MOST_WORDS:
                step = min(width, MOST_WORDS - width)
                key, width = np.minimum(key[:-step], key[step:]), width + step
            inside = sentence[: len(key)] == sentence[MOST_WORDS - 1 :]
            longer = np.bincount(sentence)[sentence[: len(key)]] > MOST_WORDS
            last[(np.uint64(0xFFFFFFFF) - (key[inside & longer] & np.uint64(0xFFFFFFFF))).astype(np.int64)] = True
        self.ends = np.flatnonzero(last) + 1
        self.begins = np.concatenate(([0], self.ends[:-1])) if len(self.ends) else self.ends
        self.doc = of[self.begins] if n else np.zeros(0, np.int64)
        #: For each text, its first sentence, and the end.
        self.docs = np.searchsorted(self.doc, np.arange(len(offsets)))

    @staticmethod
    def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its first byte, its hash, and whether a sentence ends behind it."""
        space = _SPACE[data]
        fresh = np.concatenate(([True], space[:-1]))
        fresh[edges] = True
        starts = np.flatnonzero(fresh & ~space)
        if not len(starts):
            return starts, np.zeros(0, np.uint64), np.zeros(0, bool)
        sizes = np.diff(np.concatenate((starts, [len(data)])))
        lead = int(starts[0])
        place = np.arange(len(data) - lead) - np.repeat(starts - lead, sizes)
        own = ~space[lead:]
        powers = _powers(_BASE, int(sizes.max()))
        sums = np.add.reduceat(np.where(own, _BYTES[data[lead:]] * powers[place], np.uint64(0)), starts - lead)
        long = np.add.reduceat(own.astype(np.int64), starts - lead)
        ends = _MARK[data[starts + long - 1]] | np.logical_or.reduceat(data[lead:] == 10, starts - lead)
        return starts, _mix(sums + long.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)), ends

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """(first sentence, sentence behind the last) of each span."""
        start = np.arange(len(self.ends))
        stop = np.searchsorted(self.ends, self.begins + LEAST_WORDS) + 1  # the first sentences that reach the words
        stop = np.maximum(stop, start + SENTENCES)
        whole = stop <= self.docs[self.doc + 1] if len(start) else start > 0
        return start[whole], stop[whole]

    def digests(self, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit hashes of the words of each span."""
        out = []
        a, b = self.begins[start], self.ends[stop - 1]
        for base in _BASES:
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hash * _powers(base, len(self.hash)), dtype=np.uint64)))
            back = _powers(pow(base, -1, 1 << 64), len(self.hash))
            out.append(_mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64)))
        return out


def lots(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of lots of at most PIECE_BYTES, or of one text. texts: binary, nulls are empty."""
    texts = texts.fill_null(b"")
    size = 8 if pa.types.is_large_binary(texts.type) else 4
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if size == 8 else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("k"), text.alias("text"))


def span_rows(own: DataFrame, places: bool) -> DataFrame:
    """(h) of each span of rows (doc_id, k, text), or (h, g, doc_id, k, start) with its document and place."""
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, offsets in lots(batch.column(batch.num_columns - 1)):
                s = Sentences(data, offsets)
                start, stop = s.spans()
                if not len(start):
                    continue
                h, g = (pa.array(x.view(np.int64)) for x in s.digests(start, stop))
                if not places:
                    yield pa.RecordBatch.from_arrays([h], names=["h"])
                    continue
                of = pa.array(s.doc[start])
                at = pa.array((start - s.docs[s.doc[start]]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([h, g, *(batch.column(i).slice(row, to - row).take(of) for i in (0, 1)), at], names=["h", "g", "doc_id", "k", "start"])

    known = own.where("doc_id is not null and text is not null")
    if not places:
        return known.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "h long")
    return known.select("doc_id", "k", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"h long, g long, doc_id {kind}, k long, start int")


def removals(own: DataFrame) -> DataFrame:
    """(doc_id, k, cuts): where spans to remove start, for documents (doc_id, k, text) that have any."""
    twice = write_read(span_rows(own, False).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    met = write_read(span_rows(own, True).join(twice.hint("merge"), "h"), "met")
    place = F.struct("doc_id", "k", "start")
    first = write_read(met.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "g", "first"), "first")
    later = met.join(first.hint("merge"), ["h", "g"]).where(place != F.col("first"))
    return later.groupBy("doc_id", "k").agg(F.array_sort(F.collect_set("start")).alias("cuts"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, n_removed, text) for each row: the text without sentences inside repeated spans."""
    own = _own(docs, id_col, text_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    cuts = write_read(removals(own), "cuts").select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), "cuts")
    cuts = F.broadcast(cuts) if written_bytes(cuts) < BROADCAST_BYTES else cuts.hint("merge")
    met = own.join(cuts, (own["doc_id"] == cuts["_id"]) & (own["k"] == cuts["_k"]), "left").select("doc_id", F.col("text").cast("binary").alias("text"), "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, offsets in lots(batch.column(1)):
                s = Sentences(data, offsets)
                n, gone = np.diff(s.docs), np.zeros(to - row, np.int64)
                texts = batch.column(1).slice(row, to - row).to_pylist()
                cuts = batch.column(2).slice(row, to - row)
                start, stop = s.spans()
                for i in np.flatnonzero(np.asarray(cuts.is_valid())).tolist():
                    base = s.docs[i]
                    hit = np.zeros(n[i] + 1, np.int64)
                    chosen = np.searchsorted(start, np.asarray(cuts[i].values) + base)
                    np.add.at(hit, start[chosen] - base, 1)
                    np.add.at(hit, stop[chosen] - base, -1)
                    out = np.cumsum(hit[:-1]) > 0
                    gone[i] = out.sum()
                    # a sentence reaches to the first byte of the next one; white space before the first belongs to it
                    edges = np.append(s.first[s.begins[base : base + n[i]]] - offsets[i], len(texts[i]))
                    edges[0] = 0
                    texts[i] = b"".join(texts[i][edges[j] : edges[j + 1]] for j in np.flatnonzero(~out).tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), pa.array(n.astype(np.int64)), pa.array(gone), pa.array(texts, pa.binary())], names=["doc_id", "n_sentences", "n_removed", "text"])

    return met.mapInArrow(run, f"doc_id {kind}, n_sentences long, n_removed long, text binary").withColumn("text", F.col("text").cast("string"))


def op8_sentence_spans(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
