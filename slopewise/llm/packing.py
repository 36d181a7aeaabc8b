"""Packing of documents into sequences of a fixed length by best fit decreasing.

A document longer than a sequence is first cut into full windows; each is a sequence. The rests are packed longest
first, each into the open sequence with the least room that still takes it. That choice depends on lengths only, so it
is made on the number of rests of each length (a table as long as a sequence, whatever the corpus): a segment tree over
remaining room finds the tightest, and runs of sequences that look alike are moved together. The resulting plan says
where the first, second, ... rest of each length goes; a distributed rank within the length then places every document.

Edge cases: a null or empty text has only its end id. Null and repeated doc_ids keep their rows. Rests of equal length
are ranked by a row number that is written with them, so a lost task finds the same places and a third of all rows may
be alike. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, sized
from .spans import BLOCK_BYTES, blocks, ragged
from .tokens import KEPT_WORDS, forget, word_ids

LENGTH, END = 2048, 1
PER_SHARD = 100_000  # rests ranked by one task
SENT = 256  # pieces in a batch that a task returns, at most half a million ids
PIECE = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


class Room:
    """A segment tree over remaining room: how many open sequences have it; finds the least room of at least some size."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, room: int, count: int) -> None:
        at = room + self.size
        while at:
            self.open[at] += count
            at >>= 1

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit(counts: dict[int, int], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The plan for `counts[size]` rests of each size, and the number of sequences.

    A line (size, rank, count, sequence, each, offset): the `count` rests from `rank` on go to sequences from
    `sequence` on, `each` of them to one, the first at `offset`. Sequences that look alike are one group (first, how many).
    """
    tree, groups, plan, made = Room(length), {}, [], 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            groups.setdefault(room, []).append((first, many))
            tree.add(room, many)

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                each = length // size
                many = -(-left // each)
                first, room, made = made, length, made + many
            else:
                first, many = groups[room].pop()
                tree.add(room, -many)
                each = room // size
            whole = min(many, left // each)
            if whole:
                plan.append((size, rank, whole * each, first, each, length - room))
                put(room - each * size, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if left and whole < many:
                plan.append((size, rank, left, first + whole, left, length - room))
                put(room - left * size, first + whole, 1)
                whole, rank, left = whole + 1, rank + left, 0
            put(room, first + whole, many - whole)
    return plan, made


def _cutter(path: str, length: int, end: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, kept = (BLOCK_BYTES // 4, KEPT_WORDS // 2) if with_ids else (BLOCK_BYTES, KEPT_WORDS)
        for part in blocks(batches, "text", most):
            ids, counts = word_ids(path).encode(part.column("text"), kept)
            own = np.insert(ids, np.cumsum(counts), np.uint32(end)).astype("<u4", copy=False)
            counts = counts + 1
            many = -(-counts // length)  # pieces of each text
            of = np.repeat(np.arange(len(counts)), many)
            begin = (np.arange(len(of)) - (np.cumsum(many) - many)[of]) * length
            size = np.minimum(counts[of] - begin, length)
            ends = np.cumsum(size)
            for lo in range(0, len(of), SENT):
                some = slice(lo, lo + SENT)
                at = [int(ends[lo] - size[lo]), *ends[some].tolist()]
                crc = [zlib.crc32(own[x:y]) for x, y in zip(at, at[1:], strict=False)]
                numbers = (np.array(x, np.int64) for x in (begin[some], size[some], crc))
                arrays = [*(part.column(c).take(pa.array(of[some])) for c in ("doc_id", "row")), *map(pa.array, numbers), pa.array(counts[of[some]])]
                if with_ids:
                    arrays.append(ragged(own[at[0] : at[-1]].view(np.int32), size[some], pa.int32()))
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * with_ids)
        forget()

    return cut


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END,
         with_ids: bool = False) -> DataFrame:
    """One row for each piece: `doc_id`, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset` (and `ids`, if asked for).

    `tokenizer`: path of the tokenizer's file, the same on every machine.
    """
    scratch = Scratch(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    schema = PIECE + ", ids array<int>" * with_ids
    pieces = scratch.table(plain.mapInArrow(_cutter(tokenizer, length, end, with_ids), schema), "pieces")
    sizes = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # as many rows as a sequence is long, at most
    full = sizes.pop(length, 0)
    plan, made = best_fit(sizes, length)
    shards = max(1, -(-(sum(sizes.values()) + full) // PER_SHARD))

    # The rank of a piece within its length: pieces before its shard, then the place in the shard.
    wide = pieces
    pieces = pieces.drop("ids").withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(max(shards, 8))))
    before = pieces.groupBy("length", "shard").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    before = before.select("length", "shard", F.coalesce(earlier, F.lit(0).cast("long")).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "shard").orderBy("row", "start")) - 1
    ranked = pieces.withColumn("place", place).join(before, ["length", "shard"]).withColumn("rank", F.col("before") + F.col("place"))

    lines = docs.sparkSession.createDataFrame(plan or [(0, 0, 0, 0, 1, 0)], "size long, first long, many long, sequence long, each long, base long")
    whole = ranked.filter(F.col("length") == length).withColumns({"sequence_id": F.col("rank") + made, "offset": F.lit(0).cast("long")})
    fits = (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("many"))
    nth = F.col("rank") - F.col("first")
    rest = ranked.filter(F.col("length") < length).join(sized(lines), fits).withColumns({
        "sequence_id": F.expr("sequence + (rank - first) div each"), "offset": F.col("base") + F.pmod(nth, F.col("each")) * F.col("length")})
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if not with_ids:
        return rest.select(*names).unionByName(whole.select(*names))
    # The ids are shuffled once and never sorted: they stream past the places, which are short rows.
    at = ["row", "start"]
    placed = rest.select(*at, "sequence_id", "offset").unionByName(whole.select(*at, "sequence_id", "offset"))
    return wide.join(placed.hint("shuffle_hash"), at).select(*names, "ids")
