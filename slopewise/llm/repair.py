"""Repair of conversation structure as a lightest derivation, found by a best-first agenda.

An item (row, state) says that the rows before it are edited into a beginning of `(system? (user assistant)+)?`. Rules
derive items from items: keep a row, give it the role that is due, delete it, or insert the turn that is due. A derivation's
weight is (cost, audit), the audit being the initials of its edits. Each rule adds to both, and equal
costs are never reached by two audits of which one begins the other, so rules are monotone and superior: the agenda pops
weights in rising order, an item is final when it is popped, and the first goal popped is the cheapest repair with the least audit.

A conversation's rows stream through one task in order, since its digest is one sequential hash. Rows are taken in stretches: within
a stretch the agenda runs until every state at its end is final, states that can no longer win are dropped, and what the audits
left have in common is written out. Besides a stretch, a 16-byte digest of each row is kept, to know repeats.

Edge cases: null roles and texts count as one space. Rows are ordered by turn (null first), then role, then text; repeated rows
are rows of their own, so all but the first are duplicates. A null conv_id is a conversation. A conversation without present rows
has zeros, an empty audit and the digest of an empty string. Texts may be of any length. No rows give no rows.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
STRETCH = 256
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FRESH, SYSTEM, USER, WHOLE = range(4)  # nothing yet; after the system turn; an answer is due; after an answer
DUE = ("user", "user", "assistant", "user")
AFTER = (USER, USER, WHOLE, USER)  # the state once the turn that is due has come
KEEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": WHOLE}, {"u": USER})
GOALS = (FRESH, WHOLE)
PAIRS = {"su", "ua", "au"}
# How much more the cheapest end from state x can cost than that from state y: x may delete a system turn, or insert what is due.
DETOUR = {(WHOLE, FRESH): DELETE, (WHOLE, SYSTEM): 0, (WHOLE, USER): INSERT, (USER, WHOLE): INSERT, (USER, SYSTEM): INSERT,
          (USER, FRESH): INSERT + DELETE, (FRESH, WHOLE): 0, (FRESH, SYSTEM): 0, (FRESH, USER): INSERT}
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, position long, edit string, turn long, role string, text string"


def lightest(rows: list[tuple[str, str]], starts: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str]]:
    """Weight of each state after `rows` (initial of the role, fault), from the weights of the states before them.

    With `last` only the goal that the agenda pops first.
    """
    agenda = [(cost, audit, 0, state) for state, (cost, audit) in starts.items()]
    heapq.heapify(agenda)
    best, final, ends = {(0, s): w for s, w in starts.items()}, set(), {}

    def derive(cost: int, audit: str, at: int, state: int) -> None:
        old = best.get((at, state))
        if old is None or (cost, audit) < old:
            best[at, state] = (cost, audit)
            heapq.heappush(agenda, (cost, audit, at, state))

    while agenda:
        cost, audit, at, state = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == len(rows):
            if last and state in GOALS:
                return {state: (cost, audit)}
            ends[state] = (cost, audit)
        else:
            initial, fault = rows[at]
            if fault not in ("blank", "duplicate"):
                more = cost + (TRUNCATED if fault == "truncated" else 0)
                kept = KEEPS[state].get(initial)
                if kept is not None:
                    derive(more, audit + "K", at + 1, kept)
                derive(more + REROLE, audit + "R", at + 1, AFTER[state])
            derive(cost + DELETE, audit + "D", at + 1, state)
        derive(cost + INSERT, audit + "I", at, AFTER[state])
    return {s: w for s, w in ends.items() if not any(o != s and c + DETOUR.get((o, s), 1 << 60) < w[0] for o, (c, _) in ends.items())}


class Conversation:
    """One conversation as its rows come in. `emit` gets each edit: its letter, turn, role and text."""

    def __init__(self, conv_id: int | None, emit: Callable | None = None):
        self.conv_id, self.emit = conv_id, emit
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.low = self.high = self.at_turn = None
        self.turns = self.illegal = 0
        self.before, self.seen = None, set()
        self.rows, self.solved = [], 0  # rows not yet written; how many of them the weights cover
        self.weights = {FRESH: (0, "")}
        self.state, self.audit, self.hash, self.first = FRESH, [], hashlib.sha256(), True

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.at_turn
            self.high = self.at_turn = turn
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in PAIRS
        self.before = initial
        print_ = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        body = text.rstrip(BLANKS)
        fault = "blank" if not body else "duplicate" if print_ in self.seen else "" if body[-1] in ".!?" else "truncated"
        self.seen.add(print_)
        if fault:
            self.counts[fault] += 1
        self.rows.append((initial, fault, turn, role, text))
        if len(self.rows) - self.solved >= STRETCH:
            self._stretch(False)

    def _stretch(self, last: bool) -> None:
        self.weights = lightest([r[:2] for r in self.rows[self.solved :]], self.weights, last)
        self.solved = len(self.rows)
        common = os.path.commonprefix([audit for _, audit in self.weights.values()])
        self.weights = {s: (cost, audit[len(common) :]) for s, (cost, audit) in self.weights.items()}
        self._write(common)

    def _write(self, edits: str) -> None:
        used = 0
        for edit in edits:
            initial, _, turn, role, text = self.rows[used] if edit != "I" else ("", "", None, "", "")
            used += edit != "I"
            if edit in "RI":
                role = DUE[self.state]
            if edit != "D":
                self.state = KEEPS[self.state][initial] if edit == "K" else AFTER[self.state]
                self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
                self.first = False
            if self.emit:
                self.emit(self.conv_id, edit, turn, role, text)
        self.audit.append(edits)
        del self.rows[:used]
        self.solved -= used

    def summary(self) -> tuple:
        self._stretch(True)
        ((cost, _),) = self.weights.values()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *self.counts.values(), self.illegal, cost, "".join(self.audit), self.hash.hexdigest()


def _ordered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None) -> DataFrame:
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch], emit: Callable | None) -> Iterator[Conversation]:
    """Conversations of the task as their last row has come. The end of each batch gives None, so that what is held can be passed on."""
    now = None
    for batch in batches:
        for conv_id, turn, role, text, present in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                if now:
                    yield now
                now = Conversation(conv_id, emit)
            if present:
                now.add(turn, role, text)
        yield None
    if now:
        yield now


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [pa.field(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """One row for each conversation: `conv_id`, `gaps` (turn numbers missing), counts of faulty rows (`blank`, `duplicate`, `truncated`) and of
    `illegal` neighbours, `cost` and `audit` of its repair, `repaired_sha256` of the repaired `role:text` lines.

    `present`: which rows take part; a conversation without any is reported all the same.
    """

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for done in _conversations(batches, None):
            if done:
                out.append(done.summary())
            elif out:
                yield _batch(out, SUMMARY)
                out = []
        if out:
            yield _batch(out, SUMMARY)

    return _ordered(turns, conv_col, turn_col, role_col, text_col, present).mapInArrow(summaries, SUMMARY)


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations, one row for each edit that leaves a turn: `conv_id`, `position` (from 0), `edit` (K, R or I), the original `turn`, `role`, `text`."""

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = [], {}

        def emit(conv_id, edit, turn, role, text):
            if edit != "D":
                out.append((conv_id, place.setdefault(conv_id, 0), edit, turn, role, text))
                place[conv_id] += 1

        for done in _conversations(batches, emit):
            if done:
                done.summary()
                place.pop(done.conv_id, None)
            elif out:
                yield _batch(out, TURNS)
                out.clear()
        if out:
            yield _batch(out, TURNS)

    return _ordered(turns, conv_col, turn_col, role_col, text_col, None).mapInArrow(edited, TURNS)


def damaged(turns: DataFrame) -> DataFrame:
    """`conv_id`, `turn`, `role`, `text` with faults planted by the checksum of `conv_id:turn` (nulls: one space), and `present` (false: dropped)."""
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", either("role").alias("role"), either("text").alias("text"), (F.crc32(F.concat(either("conv_id"), F.lit(":"), either("turn"))) % 20).alias("fault"))
    rows = rows.withColumn("text", F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    times = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.withColumn("copy", F.explode(times)).select("conv_id", "turn", "role", "text", (F.col("fault") != 0).alias("present"))
