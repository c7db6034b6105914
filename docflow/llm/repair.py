"""Structure repair of conversations by depth-first branch-and-bound.

A repaired conversation's role initials match (s?(ua)+)?. Each row is kept (cost 0), given the role user or assistant (2)
or deleted (3); empty user or assistant rows may be inserted anywhere (2). A row's first fault counts: blank (nothing but
white space), duplicate (role and text seen earlier in the conversation), truncated (its last character that is no white
space isn't one of .!?). Blank and duplicate rows must go; a truncated row that stays adds 1. The cheapest edits win, of
several those whose audit, the edits' initials D, I, K, R in order, is least in ASCII.

The search (solve) keeps an explicit stack of prefixes. A prefix is cut off where its cost and the least that the rest can
cost (suffix sums of each row's own minimum) exceed the incumbent, where it ties with it and its audit is behind, or where
the table of its node (rows done, state) has a better (cost, audit). Two equally cheap prefixes of a node hold one letter a
row and equally many insertions, so neither is the beginning of the other, and whatever follows keeps their order.

How it is dealt: positions come from ranges (common.ranked), duplicates from a grouped minimum, both without a task for a
conversation. Rows shrink to two letters (initial, fault) and are searched in blocks of BLOCK rows, for each state that a
block can be entered in the best way to each state that it can be left in. The ways of a conversation's blocks are put
together in order: by the argument above the best whole consists of best parts. A conversation passes one task only as
its blocks' ways, of which what they agree on is set aside at once, and, since a SHA-256 needs its bytes in order, as
one sorted stream of its rows behind its audit.

Nulls and odd rows: a null role or text is one space (so such a text is blank, such a role fits nowhere). A null turn
stands first and is left out of gaps; null conv_ids are one conversation. Rows of one turn are ordered by role and text,
so those that repeat lie together. An empty role has no initial and fits anywhere. Texts of any length are read whole.
Further columns, of whatever name, are left aside. Only conversations with rows have a result; an empty table has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, table, write_read

#: Rows that are searched at once.
BLOCK = 32
#: States by what was said last: nothing, system, user, assistant. The role that an inserted or changed row gets in each.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_KEEP = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_KEEP |= {("e", s): s for s in range(4)}
_ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The exit of a conversation's last block.
END = -1
_SPACE = " \t\n\x0b\x0c\r"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def _least(codes: str) -> tuple[list[int], list[int]]:
    """What rows i.. cost at least, in the start state and in any other."""
    free, bound = [0], [0]
    for at in range(len(codes) - 2, -1, -2):
        initial, fault = codes[at], codes[at + 1]
        late = int(fault == "t")
        misfit = 3 if fault in "bd" else min(2 + late, 3)
        fits = 3 if fault in "bd" else late
        free.append(free[-1] + (misfit if initial == "x" else fits))
        bound.append(bound[-1] + (misfit if initial in "xs" else fits))
    return free[::-1], bound[::-1]


def solve(codes: str, entry: int = START, last: bool = True) -> dict[int, tuple[int, str]]:
    """The best (cost, audit) by exit state. codes: for each row its initial (s, u, a, e for none, x for others) and fault (b, d, t, -).

    With last the exit is END, and what must still be inserted is; without, nothing is inserted behind the last row.
    """
    rows = len(codes) // 2
    least = _least(codes)
    incumbents: dict[int, tuple[int, str]] = {}
    tables: list[dict[int, tuple[int, str]]] = [{} for _ in range(rows + 1)]
    tables[0][entry] = (0, "")
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if tables[i][state] < (cost, audit):
            continue
        bound = cost + least[state != START][i]
        if last:
            if END in incumbents:
                top, best = incumbents[END]
                if bound > top or bound == top and audit > best[: len(audit)]:
                    continue
        elif state >= USER and USER in incumbents and ASSISTANT in incumbents and bound > max(incumbents[USER][0], incumbents[ASSISTANT][0]):
            continue
        moves = []
        if i == rows:
            where = END if last else state
            if not last or state in (START, ASSISTANT):
                if where not in incumbents or (cost, audit) < incumbents[where]:
                    incumbents[where] = (cost, audit)
                continue
        else:
            initial, fault = codes[2 * i], codes[2 * i + 1]
            moves.append((i + 1, state, cost + 3, audit + "D"))
        moves.append((i, _NEXT[state], cost + 2, audit + "I"))
        if i < rows and fault not in "bd":
            late = int(fault == "t")
            moves.append((i + 1, _NEXT[state], cost + 2 + late, audit + "R"))
            if (initial, state) in _KEEP:
                moves.append((i + 1, _KEEP[initial, state], cost + late, audit + "K"))
        for move in moves:  # the last one, a kept row if it can be, is taken up first
            known = tables[move[0]].get(move[1])
            if known is None or move[2:] < known:
                tables[move[0]][move[1]] = move[2:]
                stack.append(move)
    return incumbents


class Fold:
    """The best edits of one conversation, from the ways of its blocks in order."""

    def __init__(self) -> None:
        self.agreed: list[str] = []
        self.live: dict[int, tuple[int, str]] = {START: (0, "")}
        self.before: str | None = None
        self.counts = dict.fromkeys(_COUNTS, 0)

    def add(self, codes: str, ways: list[dict]) -> None:
        for k, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated")):
            self.counts[name] += codes[1::2].count(k)
        for initial in codes[::2]:
            self.counts["illegal"] += self.before is not None and self.before + initial not in ("su", "ua", "au")
            self.before = initial
        live: dict[int, tuple[int, str]] = {}
        for w in ways:
            if w["from"] in self.live:
                cost, tail = self.live[w["from"]]
                new = (cost + w["cost"], tail + w["audit"])
                if w["to"] not in live or new < live[w["to"]]:
                    live[w["to"]] = new
        same = commonprefix([t for _, t in live.values()])
        self.agreed.append(same)
        self.live = {k: (c, t[len(same) :]) for k, (c, t) in live.items()}

    def result(self) -> tuple[dict[str, int], str]:
        cost, tail = self.live[END]
        return self.counts | {"cost": cost}, "".join([*self.agreed, tail])


class Replay:
    """Applies an audit to a conversation's rows, one after the other, and hashes what comes out."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.any, self.digest = audit, 0, START, False, sha256()
        self.turns, self.first, self.turn = 0, None, None

    def _say(self, role: str, text: str) -> None:
        if self.any:
            self.digest.update(b"\n")
        self.any = True
        self.digest.update(f"{role}:{text}".encode())

    def _insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = _NEXT[self.state]
            self._say(_ROLES[self.state], "")
            self.at += 1

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.turn:
            self.first, self.turn, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = _NEXT[self.state]
            self._say(_ROLES[self.state], text)
        elif edit == "K":
            self.state = _KEEP[role[:1] or "e", self.state]
            self._say(role, text)

    def result(self) -> tuple[int, str]:
        """Gaps in the turns, and the digest."""
        self._insertions()
        return self.turn - self.first + 1 - self.turns if self.turns else 0, self.digest.hexdigest()


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, codes, last) to (key, block, codes, ways)."""
    for batch in batches:
        known: dict[tuple, list[dict]] = {}
        ways = []
        for block, codes, last in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            if (own := (codes, block == 0, last)) not in known:
                entries = (START,) if block == 0 else (START, SYSTEM, USER, ASSISTANT)
                known[own] = [{"from": e, "to": t, "cost": c, "audit": a} for e in entries for t, (c, a) in solve(codes, e, last).items()]
            ways.append(known[own])
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ways, kind)], names=["key", "block", "codes", "ways"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, codes, ways), sorted, to a row (key, counts, audit) for each key."""
    key, fold = None, None

    def out(done: list[tuple]) -> pa.RecordBatch:
        counts = [pa.array([c[k] for _, (c, _) in done], pa.int64()) for k in _COUNTS]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), *counts, pa.array([a for _, (_, a) in done], pa.string())], names=["key", *_COUNTS, "audit"])

    for batch in batches:
        done = []
        for k, codes, ways in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if fold is None or k != key:
                if fold is not None:
                    done.append((key, fold.result()))
                key, fold = k, Fold()
            fold.add(codes, ways)
        if done:
            yield out(done)
    if fold is not None:
        yield out([(key, fold.result())])


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rank, turn, role, text, audit), each key's audit before its rows, to (key, gaps, repaired_sha256)."""
    key, open_ = None, None

    def out(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["key", "gaps", "repaired_sha256"])

    for batch in batches:
        done = []
        columns = [batch.column(i) for i in (0, 2, 3, 4, 5)]
        for i in range(batch.num_rows):
            k, turn, role, text, audit = (c[i].as_py() for c in columns)
            if audit is not None:
                if open_ is not None:
                    done.append((key, *open_.result()))
                key, open_ = k, Replay(audit)
            else:
                open_.row(turn, role, text)
        if done:
            yield out(done)
    if open_ is not None:
        yield out([(key, *open_.result())])


def _key(conv):
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair(turns: DataFrame) -> DataFrame:
    """One row (key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conv_id of turns (conv_id, turn, role, text)."""
    said = lambda c: F.coalesce(c, F.lit(" "))
    own = turns.select(_key(F.col("conv_id")).alias("key"), "turn", said(F.col("role")).alias("role"), said(F.col("text")).alias("text"))
    ends = F.rtrim(F.col("text"), F.lit(_SPACE))
    initial = F.when(F.col("role") == "", "e").when(F.col("role").rlike("^[sua]"), F.substring("role", 1, 1)).otherwise("x")
    rows = ranked(own, "key", [F.col("turn").asc_nulls_first(), "role", "text"], "turns")
    rows = rows.select("*", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("said"), (ends == "").alias("blank"), F.right(ends, F.lit(1)).isin(".", "!", "?").alias("ended"))
    rows = write_read(rows.withColumn("initial", initial), "turns")
    firsts = write_read(rows.where("not blank").groupBy("key", "said").agg(F.min("rank").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"), "firsts")
    fault = F.when(F.col("blank"), "b").when(F.col("rank") > F.col("first"), "d").when(~F.col("ended"), "t").otherwise("-")
    codes = rows.select("key", "said", "rank", "n", "initial", "blank", "ended").join(firsts.hint("merge"), ["key", "said"], "left")
    codes = codes.select("key", "n", "rank", F.floor(F.col("rank") / BLOCK).alias("block"), F.concat("initial", fault).alias("code"))
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]), "")
    blocks = codes.groupBy("key", "block", "n").agg(in_order.alias("codes"))
    blocks = blocks.select("key", "block", "codes", ((F.col("block") + 1) * BLOCK >= F.col("n")).alias("last"))
    ways = blocks.mapInArrow(_search, "key string, block long, codes string, ways array<struct<`from`:int,`to`:int,cost:long,audit:string>>")
    edits = ways.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_fold, "key string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string")
    edits = write_read(edits, "edits")
    none = lambda kind: F.lit(None).cast(kind)
    heads = edits.select("key", F.lit(-1).cast("long").alias("rank"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), "audit")
    stream = rows.select("key", "rank", F.col("turn").cast("long").alias("turn"), "role", "text", none("string").alias("audit")).unionByName(heads)
    read = stream.repartition("key").sortWithinPartitions("key", "rank").mapInArrow(_replay, "key string, gaps long, repaired_sha256 string")
    return edits.join(read.hint("merge"), "key")


def damaged(turns: DataFrame) -> DataFrame:
    """The query's damage, by the CRC-32 of conv_id:turn modulo 20: 0 drops a row, 1 empties its text, 2 takes out its .!?, 3 repeats it, 4 makes it the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.unionByName(rows.where("kind = 3")).drop("kind")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    every = turns.select(_key(F.col("conv_id")).alias("key"), "conv_id").distinct()
    found = every.join(repair(damaged(turns)).hint("merge"), "key", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *_COUNTS)]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))


_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, x: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"

ORACLE = f"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (SELECT *, {_CRC} % 20 AS kind FROM source),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS c FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '-' END AS fault,
    lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM placed),
inserts(s, t, audit, said) AS (VALUES (0, 0, '', []), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 2, 'I', ['user:']),
  (1, 3, 'II', ['user:', 'assistant:']), (2, 3, 'I', ['assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (3, 2, 'I', ['user:']), (3, 3, 'II', ['user:', 'assistant:'])),
edits(letter, c, s, t) AS (
  SELECT 'D', NULL, s, s FROM range(4) t(s) UNION ALL SELECT 'K', '', s, s FROM range(4) t(s)
  UNION ALL VALUES ('K', 's', 0, 1), ('K', 'u', 0, 2), ('K', 'u', 1, 2), ('K', 'u', 3, 2), ('K', 'a', 2, 3), ('R', NULL, 0, 2), ('R', NULL, 1, 2), ('R', NULL, 3, 2), ('R', NULL, 2, 3)),
paths AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0::BIGINT AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM placed
  UNION ALL
  SELECT conv_id, i, s, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) AS best FROM (
      SELECT p.conv_id, f.i, e.t AS s,
        p.cost + 2 * length(m.audit) + CASE e.letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e.letter <> 'D' AND f.fault = 't' THEN 1 ELSE 0 END AS cost,
        p.audit || m.audit || e.letter AS audit,
        p.said || m.said || CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE e.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END AS said
      FROM paths p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN inserts m ON m.s = p.s
      JOIN edits e ON e.s = m.t AND (e.letter = 'D' OR f.fault NOT IN ('b', 'd') AND (e.letter = 'R' OR e.c = f.c)))) WHERE best = 1),
done AS (
  SELECT * FROM (
    SELECT p.conv_id, p.cost + 2 * length(m.audit) AS cost, p.audit || m.audit AS audit, p.said || m.said AS said, row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + 2 * length(m.audit), p.audit || m.audit) AS best
    FROM paths p JOIN (SELECT DISTINCT conv_id, n FROM placed) q ON q.conv_id IS NOT DISTINCT FROM p.conv_id AND q.n = p.i JOIN inserts m ON m.s = p.s AND m.t IN (0, 3)) WHERE best = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
