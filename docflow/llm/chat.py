"""Chat formatting at the level of tokens.

Template: every turn is OPEN role HEAD text CLOSE, as in "### user: hello </turn>\\n" without the blank before CLOSE. Role
and text are encoded as segments of their own by a public byte-level vocabulary, so no token spans a boundary; the
three marks are reserved ids behind the vocabulary, which no text can produce. A control string inside a role or text
(and the backslash itself, and a colon inside a role) gets a backslash before it, so that the rendered string can be
read back too.

Where a turn's tokens and characters lie in its conversation, and so the loss mask, follows from prefix sums over the
lengths of the segments. Encoding is done for each turn by itself. placed_turns() sums within blocks of turns and adds
the sums of the earlier blocks, so that a conversation may be of any length; where conversations are gathered anyhow
(read_back(), whose digests run over a conversation's bytes in order) it sums by conversation, and nothing is shuffled
twice. Conversations are put together by streaming over the sorted rows with digests and counters as the only state, so
a conversation with very many turns needs no more memory than a short one. What is read back is cut out by the mask's
places in the conversation.

Nulls and odd rows: a null text or role is the empty string. Turns are ordered by turn (nulls first), then by the ids of
the encoded turn, so ties have one order; repeated rows are repeated turns. Rows with a null conv_id form one
conversation. Unpaired order of roles is no error. Loss covers the texts of LOSS_ROLE and nothing else. Further columns,
of whatever name, are left aside. Whole texts are encoded, however long; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import default_vocabulary
from .common import table

OPEN, HEAD, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return _ROLE_CONTROL.sub(lambda m: "\\" + m[0], role)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Template:
    """Encodes and reads turns with one vocabulary."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.codec = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.open, self.head, self.close = first, first + 1, first + 2
        self.marks = {self.open: OPEN, self.head: HEAD, self.close: CLOSE}

    def encode(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Ids of one turn, and where its text starts and ends among them."""
        segments = [[self.open], self.codec.encode_ordinary(escape_role(role)), [self.head], self.codec.encode_ordinary(escape(text)), [self.close]]
        ends = list(accumulate(map(len, segments)))
        return list(chain.from_iterable(segments)), ends[2], ends[3]

    def text(self, ids: list[int]) -> str:
        """Ids without marks to text, as it was escaped."""
        return self.codec.decode_bytes(ids).decode()

    def render(self, ids: list[int]) -> str:
        """Ids with marks to the formatted string."""
        out, kept = [], []
        for i in ids:
            if i in self.marks:
                out += [self.text(kept), self.marks[i]]
                kept = []
            else:
                kept.append(i)
        return "".join([*out, self.text(kept)])

    def turns(self, ids: list[int]) -> list[tuple[str, str]]:
        """Reads (role, text) back from the ids of whole turns."""
        found, at = [], 0
        while at < len(ids):
            head, close = ids.index(self.head, at), ids.index(self.close, at)
            found.append((unescape(self.text(ids[at + 1 : head])), unescape(self.text(ids[head + 1 : close]))))
            at = close + 1
        return found


@functools.lru_cache(maxsize=2)
def template(path: str) -> Template:
    """One a Python worker."""
    return Template(path)


def encoded_turns(turns: DataFrame, path: str | None = None) -> DataFrame:
    """One row a turn: conv_id, turn, ids, the place of the text among them, its place in the formatted turn and the turn's length in characters, and whether it counts for the loss."""
    path = path or default_vocabulary()
    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                roles, texts = ([x or "" for x in batch.column(i).to_pylist()] for i in (2, 3))
                made = [t.encode(r, x) for r, x in zip(roles, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array([m[0] for m in made], pa.list_(pa.int32())),
                        pa.array([m[1] for m in made], pa.int32()),
                        pa.array([m[2] for m in made], pa.int32()),
                        pa.array([len(OPEN) + len(escape_role(r)) + len(HEAD) for r in roles], pa.int32()),
                        pa.array([len(OPEN) + len(escape_role(r)) + len(HEAD) + len(escape(x)) + len(CLOSE) for r, x in zip(roles, texts, strict=True)], pa.int32()),
                        pa.array([r == LOSS_ROLE for r in roles], pa.bool_()),
                    ],
                    names=["conv_id", "turn", "ids", "text_from", "text_to", "chars_before", "chars", "loss"],
                )

    rows = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids array<int>, text_from int, text_to int, chars_before int, chars int, loss boolean")


def placed_turns(turns: DataFrame, path: str | None = None, block: int | None = 1000) -> DataFrame:
    """conv_id, turn, ids, and where the turn lies in its conversation: token_from, char_from, and loss_from, loss_to, loss_char_from, the masked tokens and the first masked character there.

    Prefix sums in two steps, so that one long conversation is no single window: within blocks of turn numbers, and over the sums of the blocks. Without a block, in one step by conversation.
    """
    each = encoded_turns(turns, path).withColumn("n", F.size("ids").cast("long"))
    order = [F.col("turn").asc_nulls_first(), "ids"]
    if block is None:
        before = W.partitionBy("conv_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        met = each.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0).cast("long")).alias(k) for c, k in (("n", "token_from"), ("chars", "char_from"))])
    else:
        each = each.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / block))
        inner = W.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        outer = W.partitionBy("_c").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        sums = each.groupBy(F.col("conv_id").alias("_c"), F.col("block").alias("_b")).agg(F.sum("n").alias("_n"), F.sum("chars").alias("_m"))
        sums = sums.select("_c", "_b", *[F.coalesce(F.sum(c).over(outer), F.lit(0).cast("long")).alias(k) for c, k in (("_n", "_tokens"), ("_m", "_chars"))])
        own = each.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0).cast("long")).alias(k) for c, k in (("n", "_own"), ("chars", "_own_chars"))])
        met = own.join(sums.hint("merge"), own.conv_id.eqNullSafe(sums["_c"]) & own.block.eqNullSafe(sums["_b"]))
        met = met.withColumn("token_from", F.col("_own") + F.col("_tokens")).withColumn("char_from", F.col("_own_chars") + F.col("_chars"))
    masked = lambda c: F.when(F.col("loss"), c)
    start = F.col("token_from")
    return met.select(
        "conv_id", "turn", "ids", start, "char_from", masked(start + F.col("text_from")).alias("loss_from"), masked(start + F.col("text_to")).alias("loss_to"), masked(F.col("char_from") + F.col("chars_before")).alias("loss_char_from")
    )


def read_back(placed: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of every conversation, read from the ids and the masks' places of placed_turns alone. mask_sha256 is that of the masked stretches of the formatted conversation, start:end in code points, joined by commas."""
    path = path or default_vocabulary()
    kind = placed.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "mask_sha256", "n_tokens", "n_loss_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(path)
        conv, state = None, None  # state: counters and digests of the open conversation

        def closed() -> tuple:
            return conv, *(x if isinstance(x, int) else x.hexdigest() for x in state)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [id_kind, *(pa.string() if x.endswith("sha256") else pa.int64() for x in names[1:])]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        id_kind = pa.int64()
        for batch in batches:
            id_kind, done = batch.column(0).type, []
            for c, ids, start, a, b, at in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                if state is None or c != conv:
                    if state:
                        done.append(closed())
                    conv, state = c, [0, sha256(), 0, sha256(), 0, sha256(), 0, 0]
                ids = ids.values.to_numpy().tolist()
                for role, text in t.turns(ids):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    masked = t.text(ids[a - start : b - start])
                    said = unescape(masked)
                    state[2] += len(said)
                    state[3].update(said.encode())
                    state[5].update(f"{',' if state[7] else ''}{at}:{at + len(masked)}".encode())
                    state[7] += b - a + (b == a)  # an empty text is a masked stretch too
                state[4] += len(t.render(ids))
                state[6] += len(ids)
            if done:
                yield batch_of(done)
        if state:
            yield batch_of([closed()])

    rows = placed.select("conv_id", "ids", "token_from", "loss_from", "loss_to", "loss_char_from", "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "ids")
    return rows.drop("turn").mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{x} {'string' if x.endswith('sha256') else 'long'}" for x in names[1:]))


def with_probe(turns: DataFrame) -> DataFrame:
    """The conversations plus number -7, whose two texts hold control strings."""
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, i, role, said) for i, role in enumerate(("user", "assistant"))]
    own = turns.select("conv_id", "turn", "role", "text")
    return own.unionByName(turns.sparkSession.createDataFrame(rows, own.schema))


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """The digests; token counts are left out, since the query has an oracle and SQL has no tokenizer. The mask shows in mask_sha256."""
    return read_back(placed_turns(with_probe(table(spark, sf_dir, "conversations")), block=None)).drop("n_tokens", "n_loss_tokens")


ORACLE = """
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
m AS (SELECT *, length(replace(replace(replace(text, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>')) AS l FROM c),
e AS (SELECT *, l + length(role) + 14 AS n, sum(l + length(role) + 14) OVER (PARTITION BY conv_id ORDER BY turn) - l - 8 AS a FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars,
  sha256(coalesce(string_agg(a || ':' || (a + l), ',' ORDER BY turn) FILTER (role = 'assistant'), '')) AS mask_sha256
FROM e GROUP BY conv_id
"""
