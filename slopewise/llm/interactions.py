"""How filters interact: what each removes in every order they could be applied in, by wide packed counters.

A document is a mask of the filters it fails (and of the labels it would be a loss for). For each mask there is one big
integer; its 64-bit fields hold, for every order of the filters and every step of it, whether such a document is kept,
removed, redundant, a failure of that filter only, or a labelled loss. The integers of a part's documents are summed, equal
ones by multiplication with their count, and the sum is unpacked. A count is a long, so no field reaches the next.

Masks are counted first (at most 2 to the number of filters and labels for each part), so a part that holds a third of
all rows is a handful of rows when its integers are summed.

Edge cases: a null text is empty; it has no words and no code points. A null part counts as the empty string. A label row
counts for every document of its doc_id, and of several label rows any that says so; a null doc_id has no label. Of equal
texts those of the least doc_id are no duplicates; a null doc_id is neither smaller nor a duplicate. Repeated rows
with the same doc_id and text are no duplicates of each other. No documents give no rows. Texts of any length are read whole
by Spark's own expressions. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
PARTS_A_BATCH = 64


class Counters:
    """The packed integer of each mask; a mask's low bits are the filters failed, the bits above them the labels."""

    def __init__(self, filters: int, labels: int):
        self.orders = np.array(list(permutations(range(filters))))
        self.outcomes = len(OUTCOMES) + labels
        self.packed = [self._pack(m, filters, labels) for m in range(1 << (filters + labels))]

    def _pack(self, mask: int, filters: int, labels: int) -> int:
        fails = (mask >> self.orders) & 1
        before = np.cumsum(fails, axis=1) - fails > 0
        removed = (fails > 0) & ~before
        alone = (mask & ((1 << filters) - 1)) == 1 << self.orders
        marks = [(mask >> (filters + k)) & 1 for k in range(labels)]
        fields = [(fails == 0) & ~before, removed, (fails > 0) & before, alone, *(removed & (x == 1) for x in marks)]
        return int.from_bytes(np.stack(fields).astype("<u8").tobytes(), "little")

    def unpack(self, total: int) -> np.ndarray:
        """Outcome by order by step."""
        wide = total.to_bytes(8 * self.outcomes * self.orders.size, "little")
        return np.frombuffer(wide, "<u8").reshape(self.outcomes, *self.orders.shape).astype(np.int64)


def interactions(rows: DataFrame, part: str, fails: dict[str, Column], lost: dict[str, Column], count: Column | None = None) -> DataFrame:
    """One row for each part, order of the filters (names joined) and step from 1: `kept`, `removed`, `redundant`, `unique_fails`,
    a count for each name of `lost` among the removed, and `shapley` (what the step's filter removes, over all orders).

    `rows` are documents, or pre-counted ones whose number is `count`. `part` is a string column without nulls.
    """
    names, labels = list(fails), list(lost)
    bits = [*fails.values(), *lost.values()]
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(bits)), F.lit(0))
    tally = rows.select(F.col(part).alias("part"), mask.alias("mask"), (F.lit(1) if count is None else count).cast("long").alias("n"))
    tally = tally.groupBy("part", "mask").agg(F.sum("n").alias("n"))
    tally = tally.groupBy("part").agg(F.collect_list(F.struct("mask", "n")).alias("masks"))
    measures = [*OUTCOMES, *labels, "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"`{m}` long" for m in measures)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(len(names), len(labels))
        shape = counters.orders.shape
        orders = np.repeat(["".join(names[k] for k in o) for o in counters.orders], shape[1])
        steps = np.tile(np.arange(1, shape[1] + 1, dtype=np.int32), shape[0])
        for batch in batches:
            for lo in range(0, batch.num_rows, PARTS_A_BATCH):
                some, out = batch.slice(lo, PARTS_A_BATCH), []
                for masks in some.column("masks").to_pylist():
                    fields = counters.unpack(sum(x["n"] * counters.packed[x["mask"]] for x in masks))
                    share = np.bincount(counters.orders.ravel(), fields[1].ravel(), len(names)).astype(np.int64)
                    out.append(np.concatenate([fields, share[counters.orders][None]]).reshape(len(measures), -1))
                values = np.concatenate(out, axis=1)
                parts = some.column("part").take(pa.array(np.repeat(np.arange(some.num_rows), len(steps))))
                yield pa.RecordBatch.from_arrays(
                    [parts, pa.array(np.tile(orders, len(out)).tolist(), pa.string()), pa.array(np.tile(steps, len(out))), *(pa.array(v) for v in values)],
                    ["part", "filter_order", "step", *measures])

    return tally.mapInArrow(unpacked, schema)


def marked_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Pre-counted documents: `part`, `a` to `e` (which filters they fail), `good`, `toxic`, `n`.

    Copies of a text are found over the whole table. Rows that agree in everything are summed before a text's rows meet, so
    many copies of one text come as one row for each part and task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    plain = plain.withColumn("words", F.expr(r"regexp_extract_all(text, '([^\\x20\\x09-\\x0D]+)', 1)"))
    capitals = F.octet_length("text") - F.octet_length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    narrow = plain.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("print"), (F.size("words") < FEW_WORDS).alias("a"),
        (100 * F.size(F.array_distinct("words")).cast("long") < DISTINCT_PERCENT * F.size("words").cast("long")).alias("b"),
        (100 * capitals.cast("long") > CAPITAL_PERCENT * F.char_length("text").cast("long")).alias("c"), F.col("text").rlike(r"[#$%&*|]").alias("d"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # Rows without an id are dealt by their text; they find no label.
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("print"), F.lit(1 << 20)) + 1).otherwise(0)
    found = narrow.withColumn("key", F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn("spread", spread)
    found = found.join(marks.withColumn("spread", F.lit(0).cast("long")), ["key", "spread"], "left")
    own = ["print", "part", "a", "b", "c", "d", "good", "toxic"]
    found = found.select("doc_id", *own[:-2], *(F.coalesce(c, F.lit(False)).alias(c) for c in own[-2:]))
    each = found.groupBy("doc_id", *own).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    sums = each.groupBy(*own).agg(first, F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    least = F.min("first.doc_id").over(Window.partitionBy("print"))
    sums = sums.withColumn("fresh", F.col("nameless") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    split = F.array(F.struct(F.lit(False).alias("e"), F.col("fresh").alias("n")), F.struct(F.lit(True).alias("e"), (F.col("n") - F.col("fresh")).alias("n")))
    return sums.select(*own[1:], F.inline(split)).filter("n > 0")


def document_interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The five filters A to E (short, repetitive, capitals, symbols, copies) in all orders, by part."""
    rows = marked_documents(docs, labels, id_col, text_col, part_col)
    return interactions(rows, "part", {x.upper(): F.col(x) for x in "abcde"}, {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")}, F.col("n"))
