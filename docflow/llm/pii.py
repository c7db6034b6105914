"""Personal data: fixed patterns plus a character-level bidirectional LSTM-CRF.

Patterns give the base spans (email, ip, card with Luhn's check, phone). The tagger finds what they can't: addresses
spelled out or in other signs ("name at host dot com", full-width digits), IPv6, cards and phones in other groupings, and
secrets (keys, tokens, passwords). It is trained in numpy on labelled spans: made-up personal data of such forms, and of
the patterns' forms, set into texts of a bounded sample (about SAMPLE_ROWS rows by a hash of id and text, of each its first
SAMPLE_CHARS characters; EXAMPLES windows, the same share from each row), along with look-alikes that are no personal data (dates, versions,
prices, long numbers). The labels are known since the spans are made here; base spans in the sample are labelled too.

It reads every character of every text, in windows of LENGTH characters, STRIDE apart. Where windows overlap, a
character's tag comes from the window in which it lies nearest the middle, and spans are cut from the joined tags of the
whole text. A predicted span is widened to whole words and kept if an exact check of its kind holds (Luhn's for cards,
a valid address for ip, and so on) and it overlaps no base span. Base spans always stay.

Each text is worked on by itself and whole, so no key can make a task heavy; memory is a few bytes a character.

Nulls and odd rows: a null or empty text has no spans and stays as it is when redacted. Repeated rows give repeated
results. Without rows (an empty table) there is no tagger and only the base spans are given. Further columns, of whatever
name, are left aside by find() and kept by redact().
"""

from __future__ import annotations

import ipaddress
import random
import re
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, table
from .tagger import Tagger, char_ids

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
SAMPLE_ROWS = 300
EXAMPLES = 1500
SAMPLE_CHARS = 20_000
STEPS = 280
LENGTH, STRIDE = 384, 352
TRAIN_LENGTH = 96
#: Windows that go through the tagger together.
LOT = 2048
#: Rows of a batch that are worked on together, so that lots are full.
SLICE = 256

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits that one of these has tried from its start, so a look behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: what lies before it reaches back to the last match at most."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    spans = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [(1, *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if len(m[0]) >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
        if "+" in text:
            spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return spans


class Maker:
    """Made-up personal data and look-alikes."""

    SYLLABLES = ("an", "bel", "cor", "da", "el", "fin", "go", "ha", "in", "jo", "ka", "lu", "mar", "no", "ol", "per", "qui", "ros", "sa", "ti", "ul", "ver", "wa", "xen", "ya", "zo")
    ENDS = ("com", "org", "net", "de", "fr", "es", "io", "co.uk", "edu", "info")
    WIDE = {ord(str(d)): 0xFF10 + d for d in range(10)}

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(self.SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def email(self) -> tuple[str, str, str]:
        r = self.r
        name, host = self.word() + r.choice(["", ".", "_"]) + r.choice(["", self.word(), self.digits(2)]), self.word() + r.choice(["", "-" + self.word(), self.digits(1)])
        name, end = name.strip("._"), r.choice(self.ENDS)
        if r.random() < 0.3:
            return "", f"{name}@{host}.{end}", ""
        at = r.choice([" at ", " (at) ", " [at] ", "[at]", "(at)", " AT ", "＠", " @ ", " {at} "])
        dot = r.choice([" dot ", " (dot) ", " [dot] ", "[dot]", " DOT "]) if at not in ("＠", " @ ") else r.choice([".", " . "])
        if r.random() < 0.2 and at not in (" at ", " AT "):
            dot = "."
        return r.choice(["", "", "mail: ", "contact "]), name + at + host + dot + end.replace(".", dot), ""

    def ip(self) -> tuple[str, str, str]:
        r = self.r
        if r.random() < 0.35:
            return "", ".".join(str(r.randint(0, 255)) for _ in range(4)), r.choice(["", "", ":8080", ","])
        if r.random() < 0.5:
            groups = ["%x" % r.randint(0, 65535) for _ in range(8)]
            if r.random() < 0.6:
                at, n = r.randint(1, 4), r.randint(2, 4)
                return "", ":".join(groups[:at]) + "::" + ":".join(groups[at + n :]), r.choice(["", "", ","])
            return "", ":".join(groups), ""
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        return r.choice(["ip ", "", "host "]), r.choice([" . ", "[.]", "．", "(.)"]).join(parts), ""

    def card(self) -> tuple[str, str, str]:
        r = self.r
        body = r.choice("3456") + self.digits(14)
        number = body + next(x for x in "0123456789" if luhn(body + x))
        if r.random() < 0.35:
            return "", r.choice(["", " ", "-"]).join(number[i : i + 4] for i in range(0, 16, 4)), ""
        if r.random() < 0.2:
            return "", number.translate(self.WIDE), ""
        return r.choice(["", "card ", "card no. "]), r.choice([".", "/", "_", " - ", "\u00a0"]).join(number[i : i + 4] for i in range(0, 16, 4)), ""

    def phone(self) -> tuple[str, str, str]:
        r = self.r
        if r.random() < 0.3:
            return "", f"+{r.randint(1, 99)} ({self.digits(3)}) {self.digits(3)}-{self.digits(4)}", ""
        forms = [f"({self.digits(3)}) {self.digits(3)}-{self.digits(4)}", f"{self.digits(3)}-{self.digits(3)}-{self.digits(4)}", f"00{r.randint(20, 99)} {self.digits(3)} {self.digits(6)}", f"0{self.digits(3)}/{self.digits(6)}", f"0{self.digits(2)} {self.digits(2)} {self.digits(2)} {self.digits(2)} {self.digits(1)}0"]
        own = r.choice(forms)
        return r.choice(["", "tel ", "Tel.: ", "phone: ", "call "]), own.translate(self.WIDE) if r.random() < 0.1 else own, ""

    def secret(self) -> tuple[str, str, str]:
        r = self.r
        letters = r.choice(["0123456789abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
        own = r.choice(["", "", "", "sk-", "ghp_", "AKIA", "xoxb-"]) + "".join(r.choice(letters) for _ in range(r.choice([20, 24, 32, 36, 40, 40, 48, 64])))
        if not re.search("[0-9]", own) or not re.search("[A-Za-z]", own):
            return self.secret()
        quote = r.choice(['"', '"', "'", ""])
        name = r.choice(["token", "api_key", "apikey", "secret", "password", "passwd", "key", "access_token", "client_secret", "auth", "Bearer"])
        return (name + " " if name == "Bearer" else name + r.choice([" = ", "=", ": ", ":", " := "])) + quote, own, quote

    def other(self) -> str:
        """What looks alike and is none."""
        r = self.r
        number = self.digits(r.randint(9, 20))
        return r.choice([
            f"{r.randint(1900, 2100)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", f"{r.randint(0, 23):02}:{r.randint(0, 59):02}", f"v{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}",
            f"${r.randint(1, 999)}.{r.randint(0, 99):02}", f"{r.randint(1, 999)},{self.digits(3)}", str(r.randint(0, 10**6)), number, f"{r.randint(1, 99)}%", f"{self.word()} = {r.randint(0, 999)}", f"{self.word()}_{self.word()}_{self.word()}", self.word() * 4,
            f"{self.word()} at {self.word()} dot", f"look at {self.word()}", f"@{self.word()}", f"ISBN 978-{self.digits(1)}-{self.digits(4)}-{self.digits(4)}-{self.digits(1)}", f"http://{self.word()}.com/{self.word()}", f"token {self.word()}", f"{self.word()}: \"{self.word()}\"", f"#{self.digits(5)}", f"{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}",
        ])

    def set_into(self, text: str) -> tuple[str, list[tuple[int, int, int]]]:
        """A stretch of the text with one or two pieces set in between its words, and their spans."""
        r = self.r
        at = r.randrange(max(1, len(text)))
        words = text[at : at + TRAIN_LENGTH + 40].split(" ")[1:] or [text[:TRAIN_LENGTH]]
        out, spans, n, todo = [], [], 0, r.choice([0, 1, 1, 1, 2])
        places = {r.randrange(min(len(words), 8) + 1) for _ in range(todo)}
        for i in range(len(words) + 1):
            if i in places:
                if r.random() < 0.3:
                    piece, found = self.other(), None
                else:
                    kind = r.randrange(len(KINDS))
                    before, own, behind = getattr(self, KINDS[kind])()
                    piece = before + own + behind + r.choice(["", "", "", ".", ","])
                    found = (kind, n + len(before), n + len(before) + len(own))
                if found:
                    spans.append(found)
                out.append(piece)
                n += len(piece) + 1
            if i < len(words):
                out.append(words[i])
                n += len(words[i]) + 1
        return " ".join(out), spans


def examples(texts: list[str], most: int = EXAMPLES, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: ids, and tags 0 (none), 1 + 2 * kind (first) or 2 + 2 * kind (further)."""
    maker = Maker(seed)
    ids, tags = np.zeros((most, TRAIN_LENGTH), np.uint8), np.zeros((most, TRAIN_LENGTH), np.int64)
    for k in range(most if texts else 0):
        text, spans = maker.set_into(texts[k % len(texts)])
        n = min(TRAIN_LENGTH, len(text))
        ids[k, :n] = char_ids(text)[:n]
        known = [(a, b) for _, a, b in spans]
        for kind, a, b in spans + [s for s in base_spans(text) if all(s[1] >= b or s[2] <= a for a, b in known)]:
            tags[k, a : a + 1], tags[k, a + 1 : b] = 1 + 2 * kind, 2 + 2 * kind
    return (ids, tags) if texts else (ids[:0], tags[:0])


def train(docs: DataFrame, text_col: str = "text", id_col: str | None = None, sample_rows: int = SAMPLE_ROWS, steps: int = STEPS) -> dict[str, np.ndarray] | None:
    """The tagger's parameters, from a bounded sample of rows."""
    text = F.col(text_col)
    texts = hash_sample(docs, [text, *([F.col(id_col)] if id_col else [])], sample_rows, F.substring(text, 1, SAMPLE_CHARS))
    ids, tags = examples(sorted(t for t in texts if t) or [""] * bool(texts))
    if not len(ids):
        return None
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.fit(ids, tags, steps)
    return {k: v.astype(np.float32) for k, v in tagger.p.items()}


def tagger_of(params: dict[str, np.ndarray]) -> Tagger:
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.p = dict(params)
    return tagger


def _cut(tags: np.ndarray, at: int) -> list[tuple[int, int, int]]:
    """Spans of a run of tags, of which none is 0 but may be those behind it."""
    spans, kind, start = [], -1, 0
    for i, t in enumerate([*tags.tolist(), 0]):
        own = (t - 1) // 2 if t else -1
        if kind >= 0 and (own != kind or t % 2 == 1):
            spans.append((kind, start + at, i + at))
            kind = -1
        if t and kind < 0:
            kind, start = own, i
    return spans


def windows(n: int) -> np.ndarray:
    """Starts of the windows of a text of n characters; the last one ends with the text."""
    return np.array([0]) if n <= LENGTH else np.append(np.arange(0, n - LENGTH, STRIDE), n - LENGTH)


def predicted(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger finds in each text; the windows of all texts go through it together, in bounded lots."""
    found: list[list[tuple[int, int, int]]] = []
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    ids = np.concatenate([*map(char_ids, texts), np.zeros(LENGTH, np.uint8)])
    each = [windows(n) for n in sizes.tolist()]
    starts = np.concatenate([w + a for w, a in zip(each, first[:-1], strict=True)]) if texts else np.zeros(0, np.int64)
    ends = np.repeat(first[1:], [len(w) for w in each])
    # each character belongs to the window in whose middle it lies nearest
    middle = starts + LENGTH // 2
    same = ends[1:] == ends[:-1]
    bound = (middle[1:] + middle[:-1] + 1) // 2
    low = np.concatenate((starts[:1], np.where(same, bound, starts[1:])))
    high = np.concatenate((np.where(same, bound, ends[:-1]), ends[-1:]))
    tags = np.zeros(first[-1], np.int8)
    span = np.arange(LENGTH)
    for at in range(0, len(starts), LOT):
        own = slice(at, at + LOT)
        place = starts[own, None] + span
        lot = np.where(place < ends[own, None], ids[np.minimum(place, len(ids) - 1)], 0)
        got = tagger.decode(lot)
        for i in np.flatnonzero(got.any(axis=1)).tolist():
            a, b, s = low[at + i], high[at + i], starts[at + i]
            tags[a:b] = got[i, a - s : b - s]
    for k in range(len(texts)):
        own, spans = tags[first[k] : first[k + 1]], []
        hit = np.flatnonzero(own)
        if len(hit):
            breaks = np.flatnonzero(np.diff(hit) > 1)
            for a, b in zip(hit[np.append(0, breaks + 1)].tolist(), hit[np.append(breaks, len(hit) - 1)].tolist(), strict=True):
                spans += _cut(own[a : b + 1], a)
        found.append(spans)
    return found


_AT = r"(?:\s*[\[({<]\s*at\s*[\])}>]\s*|\s*[@＠]\s*|\s+at\s+)"
_DOT = r"(?:\s*[\[({<]\s*dot\s*[\])}>]\s*|\s*[.．]\s*|\s+dot\s+)"
_SPELLED = re.compile(rf"[\w.%+-]+{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.I)
_SECRET = re.compile(r"(?=[^\s]*[0-9])(?=[^\s]*[A-Za-z])[A-Za-z0-9_+/=.-]{16,}")
_EDGE = re.compile(r"[\w＠@.:%+/=\-(\[]")


def plain(text: str) -> str:
    """Any decimal digit as an ASCII one; full-width stops and blanks as plain ones."""
    return "".join(str(unicodedata.decimal(c)) if c.isdecimal() else {"．": ".", "\u00a0": " "}.get(c, c) for c in text)


def fits(kind: int, text: str) -> bool:
    """Whether a predicted span can be what the tagger says."""
    own = plain(text)
    digits = "".join(c for c in own if "0" <= c <= "9")
    if KINDS[kind] == "email":
        return bool(_SPELLED.fullmatch(text))
    if KINDS[kind] == "ip":
        try:
            ipaddress.ip_address(re.sub(r"\s|[\[\]()]", "", own))
        except ValueError:
            return False
        return True
    if KINDS[kind] == "card":
        return bool(re.fullmatch(r"[0-9](?:[ ./_-]{0,3}[0-9])+", own)) and 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    if KINDS[kind] == "phone":
        return bool(re.fullmatch(r"[+(]?[0-9](?:[ ()./-]{0,2}[0-9])+", own)) and 8 <= len(digits) <= 15 and len(own) > len(digits)
    return bool(_SECRET.fullmatch(text))


def widened(text: str, a: int, b: int) -> tuple[int, int]:
    """The span to whole words, without marks at its ends."""
    while a > 0 and a < len(text) and _EDGE.match(text[a - 1]) and _EDGE.match(text[a]):
        a -= 1
    while b < len(text) and b > a and (text[b].isalnum() or (text[b] in "-_.=/+:" and b + 1 < len(text) and text[b + 1].isalnum())) and text[b - 1] not in ".,;":
        b += 1
    while b > a and text[b - 1] in " .,;:!?\"')":
        b -= 1
    while a < b and text[a] in " .,;:!?\"'=":
        a += 1
    return a, b


def all_spans(tagger: Tagger | None, texts: list[str]) -> list[tuple[list, list]]:
    """For each text its base spans and all its spans."""
    base = [base_spans(t) for t in texts]
    if tagger is None:
        return [(b, b) for b in base]
    out = []
    for text, own, more in zip(texts, base, predicted(tagger, texts), strict=True):
        taken = np.zeros(len(text), bool) if more else None
        for _, a, b in own if more else ():
            taken[a:b] = True
        added = []
        for kind, a, b in more:
            for x, y in ((a, b), widened(text, a, b)):
                if y > x and not taken[x:y].any() and fits(kind, text[x:y]):
                    taken[x:y] = True
                    added.append((kind, x, y))
                    break
        out.append((own, sorted(own + added)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; overlapping spans are replaced together."""
    out, done, last = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[done:a], f"[{KINDS[kind]}]"]
        last = done = max(b, last)
    return "".join([*out, text[done:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: dict | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row; the counts are of base spans."""
    params = params or train(docs, text_col, id_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = tagger_of(params) if params else None
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                found = all_spans(tagger, [x or "" for x in batch.column(1).to_pylist()])
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(BASE_KINDS))]
                digest = pa.array([sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *counts, digest, pa.array([joined(s) for _, s in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]
                )

    shape = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, shape)


def redact(docs: DataFrame, text_col: str = "text", params: dict | None = None) -> DataFrame:
    """docs with all spans of the text replaced by their kinds; other columns as they are."""
    params = params or train(docs, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = tagger_of(params) if params else None
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                texts = batch.column(at).to_pylist()
                found = all_spans(tagger, [x or "" for x in texts])
                new = pa.array([None if t is None else redacted(t, s) for t, (_, s) in zip(texts, found, strict=True)], pa.string())
                columns = [new if i == at else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
