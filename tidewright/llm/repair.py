"""Conversation structure repair: cheapest edits by Dijkstra on the lattice of (turn index, grammar state).

A repaired conversation is a system turn or none, then user and assistant in turn, or nothing at all. From a node
(turns consumed, state) edges keep, rerole or delete the next turn, or insert one; nodes are popped by (cost, audit),
audit being the edits' initials so far, and the first accepting end node that is popped is the answer. Both parts of the
key only grow along an edge, and of two ways to one node with equal costs neither audit begins the other, as both have
consumed the same turns: so the order of two ways is that of all their continuations.

The lattice is built from one short row a turn (its role's initial and its fault), without texts. These rows are dealt
out in ranges of (conversation, turn), so a conversation of any length is spread over tasks. Where a conversation lies
in one task it is solved there; where it goes on in the next, or has more than SEGMENT turns, each stretch of it gives
the cheapest ways from every state to every state, and these few rows are joined in order by the same key. Only then do
texts move, once, to meet their conversation's edits and stream by.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversations import DIGEST_SQL, conversations, crc32_sql, turn_digest

BLANK, DUPLICATE, TRUNCATED = "b", "d", "t"
#: States: nothing yet, after a system turn, after a user's, after an assistant's. A conversation may end in ACCEPTING.
ACCEPTING = (0, 3)
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: State after a turn that is inserted or gets another role, and that turn's role.
WANTED = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
#: Turns of a conversation that are solved at once.
SEGMENT = 512
#: White space of the contract.
SPACE = " \t\n\x0b\x0c\r"

Way = tuple[int, int, int, str]  # from state, to state, cost, audit


def edges(state: int, turn: tuple[str, str] | None) -> Iterator[tuple[str, int, int]]:
    """Edit, cost and next state of each edge; turn: the initial of its role and its fault, None behind the last one."""
    wanted = WANTED[state][0]
    yield "I", INSERT, wanted
    if turn is None:
        return
    initial, fault = turn
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    extra = CUT_OFF if fault == TRUNCATED else 0
    yield "R", REROLE + extra, wanted
    if (state, initial) in AFTER:
        yield "K", extra, AFTER[state, initial]


def cheapest(turns: list[tuple[str, str]], start: int = 0, whole: bool = True) -> list[Way]:
    """The way with the least (cost, audit) to the first accepting end node; if not whole, one to each end state."""
    heap: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    settled: set[tuple[int, int]] = set()
    found: list[Way] = []
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in settled:
            continue
        settled.add((at, state))
        if at == len(turns) and (not whole or state in ACCEPTING):
            found.append((start, state, cost, audit))
            if whole:
                break
        for edit, more, to in edges(state, turns[at] if at < len(turns) else None):
            place = (at + (edit != "I"), to)
            if place not in settled:
                heapq.heappush(heap, (cost + more, audit + edit, *place))
    return found


def joined(held: dict[int, tuple[int, str]], ways: list[Way]) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) of each state after one more stretch."""
    out: dict[int, tuple[int, str]] = {}
    for start, to, cost, audit in ways:
        if start in held:
            new = (held[start][0] + cost, held[start][1] + audit)
            if to not in out or new < out[to]:
                out[to] = new
    return out


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with damage chosen by the checksum of conversation and turn.

    Of 20 cases one drops the row, one empties its text, one takes its sentence ends, one repeats it, one makes it the
    user's. Nulls count as a blank, in the checksum too; a null turn or conv_id stays null. Equal rows are damaged alike.
    """
    key = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    kept = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        key.alias("_case"),
    ).where("_case != 0")
    role = F.when(F.col("_case") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("_case") == 1, F.lit("")).when(F.col("_case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_case") == 3, 2).otherwise(1)))
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


_MOVES = pa.list_(pa.struct([("start", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_PART = [("conv_id", pa.int64()), ("seq", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("distinct", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("ways", _MOVES)]
PART = "conv_id long, seq long, low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long, head string, tail string, ways array<struct<start: int, to: int, cost: long, audit: string>>"


class Part:
    """A stretch of one conversation's turns, in order."""

    def __init__(self, conv_id: int | None, starts: bool):
        self.conv_id, self.starts = conv_id, starts  # starts: no turn of the conversation can lie before
        self.turns: list[tuple[str, str]] = []
        self.low = self.high = None
        self.distinct = self.illegal = 0

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if self.turns and self.turns[-1][0] + initial not in LEGAL:
            self.illegal += 1
        self.turns.append((initial, fault))
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def row(self, seq: int, ends: bool) -> dict:
        whole = self.starts and ends
        ways = cheapest(self.turns) if whole else [w for start in range(4) for w in cheapest(self.turns, start, False)]
        faults = [f for _, f in self.turns]
        return {
            "conv_id": self.conv_id, "seq": seq, "low": self.low, "high": self.high, "distinct": self.distinct, "blank": faults.count(BLANK),
            "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": self.illegal, "head": self.turns[0][0] if self.turns else None,
            "tail": self.turns[-1][0] if self.turns else None, "ways": [dict(zip(("start", "to", "cost", "audit"), w, strict=True)) for w in ways] if self.turns else [],
        }


def part_rows(segment: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (conv_id, turn, digest, first, n, initial, fault) -> a row of PART for each stretch.

    Of each (conv_id, turn, digest) there are a row with the number n of turns and, where the digest is the conversation's
    first such, another one before it with first true.
    """
    schema = pa.schema(_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        part, marked, rows = None, None, []
        for batch in batches:
            for conv_id, turn, digest, first, n, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "digest", "first", "n", "initial", "fault")), strict=True):
                if part is None or part.conv_id != conv_id:
                    if part is not None:
                        rows.append(part.row(seq := seq + 1, True))
                    part = Part(conv_id, part is not None)
                if first:
                    marked = (conv_id, turn, digest)
                    continue
                for copy in range(n):
                    if len(part.turns) >= segment:
                        rows.append(part.row(seq := seq + 1, False))
                        part = Part(conv_id, False)
                    repeated = copy > 0 or marked != (conv_id, turn, digest)
                    part.add(turn, initial, DUPLICATE if repeated and fault != BLANK else fault)
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if part is not None:
            rows.append(part.row(seq + 1, False))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def parts(turns: DataFrame, ids: DataFrame, segment: int) -> DataFrame:
    """The stretches (PART) of all conversations, an empty one at least for each of ids."""
    ended = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(ended == "", BLANK).when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise("")
    short = turns.select("conv_id", "turn", turn_digest().alias("digest"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    counted = short.groupBy("conv_id", "turn", "digest").agg(F.count("*").alias("n"), F.first("initial").alias("initial"), F.first("fault").alias("fault"))
    none = F.lit(None)
    seen = counted.groupBy("conv_id", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))).alias("at"))
    marks = seen.select("conv_id", "at.turn", "digest", F.lit(True).alias("first"), F.lit(0).cast("long").alias("n"), none.cast("string").alias("initial"), none.cast("string").alias("fault"))
    bare = ids.select("conv_id").distinct().select("conv_id", none.cast("long").alias("turn"), none.cast("binary").alias("digest"), F.lit(False).alias("first"), F.lit(0).cast("long").alias("n"), none.cast("string").alias("initial"), none.cast("string").alias("fault"))
    rows = counted.withColumn("first", F.lit(False)).select(marks.columns).unionByName(marks).unionByName(bare)
    order = (F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("digest"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, F.desc("first")).mapInArrow(part_rows(segment), PART)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, position long, edit string, role string, text string"


class Repair:
    """One conversation: its stretches first, then its turns as they stream by."""

    def __init__(self, conv_id: int | None, out: Callable[[str, str, str], None]):
        self.conv_id, self.out = conv_id, out
        self.held: dict[int, tuple[int, str]] = {0: (0, "")}
        self.low = self.high = self.tail = self.audit = None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.distinct = self.at = self.state = 0

    def stretch(self, part: dict) -> None:
        for name in self.counts:
            self.counts[name] += part[name]
        if part["head"] is not None:
            self.counts["illegal"] += self.tail is not None and self.tail + part["head"] not in LEGAL
            self.tail = part["tail"]
            self.held = joined(self.held, [(w["start"], w["to"], w["cost"], w["audit"]) for w in part["ways"]])
        if part["low"] is not None:
            self.distinct += part["distinct"] - (part["low"] == self.high)
            self.low, self.high = part["low"] if self.low is None else self.low, part["high"]

    def best(self) -> tuple[int, str]:
        return min(self.held[s] for s in ACCEPTING if s in self.held)

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state, role = WANTED[self.state]
            self.out("I", role, "")

    def turn(self, role: str, text: str) -> None:
        if self.audit is None:
            self.audit = self.best()[1]
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state, role = WANTED[self.state]
        elif edit == "K":
            self.state = AFTER[self.state, role[:1]]
        if edit != "D":
            self.out(edit, role, text)

    def end(self) -> tuple:
        cost, self.audit = self.best()
        self._inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv_id, gaps, *self.counts.values(), cost, self.audit)


def repair_rows(as_turns: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted stretches and turns -> rows of TURNS, or of REPORT."""
    names = [x.split()[0] for x in (TURNS if as_turns else REPORT).split(", ")]
    kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in (TURNS if as_turns else REPORT).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        repair, digest, position, size = None, hashlib.sha256(), 0, 0

        def out(edit: str, role: str, text: str) -> None:
            nonlocal position, size
            if as_turns:
                rows.append((repair.conv_id, position, edit, role, text))
                size += len(text)
            else:
                digest.update((("\n" if position else "") + role + ":" + text).encode("utf-8", "replace"))
            position += 1

        def ended() -> None:
            nonlocal digest, position
            report = repair.end()
            if not as_turns:
                rows.append((*report, digest.hexdigest()))
            digest, position = hashlib.sha256(), 0

        def flushed() -> pa.RecordBatch:
            nonlocal rows, size
            columns, rows, size = list(zip(*rows, strict=True)), [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text"))
            for conv_id, part, role, text in zip(*columns, strict=True):
                if repair is None or repair.conv_id != conv_id:
                    if repair is not None:
                        ended()
                    repair = Repair(conv_id, out)
                if part is not None:
                    repair.stretch(part)
                else:
                    repair.turn(role, text)
                if len(rows) >= 5000 or size >= 4 << 20:
                    yield flushed()
        if repair is not None:
            ended()
        if rows:
            yield flushed()

    return run


def repair_conversations(turns: DataFrame, ids: DataFrame | None = None, *, as_turns: bool = False, segment: int = SEGMENT) -> DataFrame:
    """A report per conversation (REPORT) or, if as_turns, the repaired turns (TURNS).

    turns needs conv_id, turn, role and text; other columns are ignored. ids: a table with conv_id whose conversations are
    reported even if they have no turn (zeros, an empty audit, the hash of nothing). Null roles and texts count as empty;
    rows with a null turn come first, rows that share a turn follow by turn_digest; rows without a conv_id are one
    conversation. Repeated rows are duplicates, of which all but the first are deleted. An empty table gives an empty
    result. Conversations of any length are spread until their texts stream, in order, through one task each, which
    holds their edits (an initial a turn) and one batch of texts: SHA-256 is sequential.
    """
    given = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wanted = (turns if ids is None else ids).select(F.col("conv_id").cast("long").alias("conv_id"))
    found = parts(given, wanted, segment)
    none = F.lit(None)
    heads = found.select("conv_id", F.struct(*(c for c in found.columns if c != "conv_id")).alias("part"), none.cast("long").alias("turn"), none.cast("binary").alias("digest"), none.cast("string").alias("role"), none.cast("string").alias("text"))
    texts = given.select("conv_id", none.cast(heads.schema["part"].dataType).alias("part"), "turn", turn_digest().alias("digest"), "role", "text")
    rows = heads.unionByName(texts).repartition("conv_id")
    ordered = rows.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.col("part").isNull(), "part.seq", F.asc_nulls_first("turn"), "digest")
    return ordered.select("conv_id", "part", "role", "text").mapInArrow(repair_rows(as_turns), TURNS if as_turns else REPORT)


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir)
    return repair_conversations(damage(rows), rows)


def _sql() -> str:
    """The lattice row by row: the least key (cost as ten digits, then audit) of each of the four states."""

    def more(key: str, cost: str, edit: str) -> str:
        return f"lpad(CAST(CAST({key}[1:10] AS BIGINT) + {cost} AS VARCHAR), 10, '0') || {key}[11:] || '{edit}'"

    def kept(key: str, initial: str) -> str:
        return f"CASE WHEN sound AND initial = '{initial}' THEN {more(key, 'extra', 'K')} END"

    def reroled(key: str) -> str:
        return f"CASE WHEN sound THEN {more(key, '1 + extra', 'R')} END"

    step0, step1 = more("s0", "2", "D"), f"least({more('s1', '2', 'D')}, {kept('s0', 's')})"
    step2 = f"least({more('s2', '2', 'D')}, " + ", ".join(f(k, *a) for k in ("s0", "s1", "s3") for f, a in ((reroled, ()), (kept, ("u",)))) + ")"
    step3 = f"least({more('s3', '2', 'D')}, {reroled('s2')}, {kept('s2', 'a')})"
    insert2 = f"least(v2, {more('v0', '5', 'I')}, {more('v1', '5', 'I')}, {more('v3', '5', 'I')})"
    return f"""
WITH RECURSIVE cases AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM cases
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest, copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, digest, copy) AS nth
  FROM (SELECT *, {DIGEST_SQL} AS digest FROM damaged)
), judged AS (
  SELECT *, substr(role, 1, 1) AS initial, fault NOT IN ('b', 'd') AS sound, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS extra,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || substr(role, 1, 1) AS pair
  FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault FROM placed)
), walk AS (
  SELECT conv_id, 0 AS pos, '0000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '0000000005I' AS s2, '0000000010II' AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, v0, v1, w2, least(v3, {more("w2", "5", "I")})
  FROM (SELECT *, {insert2} AS w2 FROM (
    SELECT w.conv_id, w.pos + 1 AS pos, {step0} AS v0, {step1} AS v1, {step2} AS v2, {step3} AS v3
    FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos + 1))
), counted AS (
  SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), solved AS (
  SELECT w.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
    coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
    CAST(least(s0, s3)[1:10] AS BIGINT) AS cost, least(s0, s3)[11:] AS audit
  FROM walk w LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE w.pos = coalesce(c.n, 0)
), edits AS (
  SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS pos,
    sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS nth
  FROM (SELECT conv_id, p, substr(audit, p, 1) AS edit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM solved))
), lines AS (
  SELECT e.conv_id, e.p, e.edit, e.nth, j.role, CASE WHEN e.edit = 'I' THEN '' ELSE j.text END AS text,
    max(CASE WHEN e.nth = 1 AND e.edit = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS system
  FROM edits e LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.pos = e.pos AND e.edit <> 'I'
  WHERE e.edit <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS text
  FROM lines GROUP BY conv_id
)
SELECT s.*, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM solved s LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM s.conv_id
"""


OP11_SQL = _sql()
