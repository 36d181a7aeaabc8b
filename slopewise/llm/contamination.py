"""Benchmark decontamination with suffix arrays of the training texts.

Each block of training texts is a shard with a suffix array over its words. Every suffix of every benchmark item is
searched in it by bisection: the neighbours of its place give the longest verbatim match, and where that is as long as
a window, two more bisections give the places of all its occurrences. A document word inside an occurrence is hit. A
window is ten consecutive words of an item; an item of fewer words, but not none, is one window.

Words are runs of letters, digits and characters beyond ASCII after A-Z are lower-cased. The benchmark is broadcast in
blocks of bounded size, each of which passes over the documents in the same stage, so nothing is shuffled.

Edge cases: a null or empty document or item has no words and matches nothing. Repeated items count once, an item
without an id hits words but is not listed. An empty benchmark hits nothing. No match crosses documents or items.
Null and repeated doc_ids keep their rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import ALNUM, LOWER, Texts, blocks
from .suffix import SuffixArray, covered

WINDOW = 10
BENCHMARK_BYTES = 8 << 20
RESULT = "doc_id long, text string, n_words long, longest long, spans array<struct<start:long,length:long>>, items array<string>"


class Items:
    """Benchmark items as numbers of their vocabulary. A suffix is named by its place in `words`; `left` is the rest of its item."""

    def __init__(self, ids: list, texts: list, window: int):
        block = Texts(pa.array(texts, pa.string()), LOWER)
        begin, end, row = block.words(ALNUM)
        prints = block.prints(begin, end)
        self.vocabulary, words = np.unique(prints, return_inverse=True)
        self.words, self.item, self.ids = words + 1, row, np.array([None if x is None else str(x) for x in ids], object)
        counts = np.bincount(row, minlength=len(ids))
        place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.left = counts[row] - place
        self.window = np.minimum(window, counts)[row]  # of the suffix
        self.opens = self.left >= self.window  # a whole window begins here
        self.longest = int(counts.max(initial=0))


class Shard:
    """The suffix array of a block of documents, over words that the items have."""

    def __init__(self, texts: Texts, items: Items):
        begin, end, self.row = texts.words(ALNUM)
        self.rows, self.items = texts.rows, items
        prints = texts.prints(begin, end)
        at = np.minimum(np.searchsorted(items.vocabulary, prints), max(len(items.vocabulary) - 1, 0))
        number = np.where(items.vocabulary[at] == prints, at + 1, 0) if len(items.vocabulary) else np.zeros(len(prints), np.int64)
        self.slot = np.arange(len(prints)) + self.row  # one empty place after each text
        self.words = np.zeros(len(prints) + self.rows + 1, np.int64)
        self.words[self.slot] = number
        self.order = SuffixArray(self.words, self.words > 0, items.longest).order
        self.back = np.full(len(self.words), -1)
        self.back[self.slot] = np.arange(len(prints))

    def _agree(self, at: np.ndarray, suffix: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the common prefix of training and item suffix, up to `most`, and the sign of their difference after it."""
        length, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        on = np.flatnonzero(most > 0)
        while len(on):
            x, y = self.words[at[on] + length[on]], self.items.words[suffix[on] + length[on]]
            sign[on] = np.sign(x - y)
            on = on[x == y]
            length[on] += 1
            on = on[length[on] < most[on]]
        return length, sign

    def _bisect(self, suffix: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
        """First place in `order` whose suffix is not less than (`after`: greater than) the first `most` words of each item suffix."""
        low, high = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(self.order))
        while len(on := np.flatnonzero(low < high)):
            middle = (low[on] + high[on]) >> 1
            _, sign = self._agree(self.order[middle], suffix[on], most[on])
            right = sign <= 0 if after else sign < 0
            low[on[right]] = middle[right] + 1
            high[on[~right]] = middle[~right]
        return low

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """For each item suffix, its longest match in this shard and a place (word of the block) where it is found."""
        suffix = np.arange(len(self.items.words))
        best, where = np.zeros(len(suffix), np.int64), np.full(len(suffix), -1)
        if len(self.order):
            place = self._bisect(suffix, self.items.left, False)
            for near in (place - 1, place):
                ok = (near >= 0) & (near < len(self.order))
                at = self.order[np.where(ok, near, 0)]
                length = np.where(ok, self._agree(at, suffix, self.items.left)[0], 0)
                where = np.where(length > best, self.back[at], where)
                best = np.maximum(best, length)
        return best, where

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item suffix, place (word of the block) and length of the whole match, for every occurrence of a window."""
        best, _ = self.matches()
        suffix = np.flatnonzero(self.items.opens & (best >= self.items.window))
        need = self.items.window[suffix]
        low, high = self._bisect(suffix, need, False), self._bisect(suffix, need, True)
        times = high - low
        which = np.repeat(suffix, times)
        at = self.order[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        return which, self.back[at], self._agree(at, which, self.items.left[which])[0]


def _scan(items: Items, texts: Texts) -> tuple[Shard, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shard; which words are hit; the (row, item) pairs; the longest match of each row."""
    shard = Shard(texts, items)
    suffix, at, length = shard.occurrences()
    hit = covered(at, items.window[suffix], len(shard.row))
    pairs = np.unique(shard.row[at] * np.int64(len(items.ids) + 1) + items.item[suffix])
    longest = np.zeros(texts.rows, np.int64)
    np.maximum.at(longest, shard.row[at], length)
    return shard, hit, pairs // (len(items.ids) + 1), pairs % (len(items.ids) + 1), longest


def _finder(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for part in blocks(batches, "text"):
            shard, hit, pair_row, pair_item, longest = _scan(items, Texts(part.column("text"), LOWER))
            first = np.searchsorted(shard.row, np.arange(shard.rows + 1))
            for row, spans in enumerate(part.column("spans").to_pylist()):
                for span in spans:
                    hit[first[row] + span["start"] : first[row] + span["start"] + span["length"]] = True
            found = [set(x) for x in part.column("items").to_pylist()]
            for row, item in zip(pair_row, pair_item, strict=True):
                if items.ids[item] is not None:
                    found[row].add(items.ids[item])
            inside = np.flatnonzero(hit)
            fresh = np.diff(inside, prepend=-2) > 1
            fresh[1:] |= shard.row[inside][1:] != shard.row[inside][:-1]
            start = np.flatnonzero(fresh)
            length, of = np.diff(start, append=len(inside)), shard.row[inside[start]]
            spans = pa.StructArray.from_arrays([pa.array(inside[start] - first[of]), pa.array(length)], ["start", "length"])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=shard.rows))]).astype(np.int32)
            longest = np.maximum(longest, part.column("longest").to_numpy(zero_copy_only=False))
            arrays = [part.column("doc_id"), part.column("text"), pa.array(np.diff(first)), pa.array(longest),
                      pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "n_words", "longest", "spans", "items"])

    return find


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> Iterator[Items]:
    """The benchmark in blocks of about `most` bytes; one at a time is held by the driver."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // most) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        rows = items.filter(part == k).collect() if count > 1 else items.collect()
        yield Items([r[0] for r in rows], [r[1] for r in rows], window)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, most: int = BENCHMARK_BYTES) -> DataFrame:
    """One row for each document: `doc_id`, `n_words`, `n_hit`, `longest` (longest verbatim match, in words, among those with a
    window), `spans` (start and length of hit words), `items` (ids, as strings, of items with an occurring window), `contaminated`."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"),
                      F.lit(0).cast("long").alias("longest"), F.expr("cast(array() as array<struct<start:long,length:long>>)").alias("spans"),
                      F.expr("cast(array() as array<string>)").alias("items"))
    for items in _item_blocks(benchmark, item_col, item_text, window, most):
        out = out.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(items)), RESULT)
    hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.length)")
    return out.drop("text").withColumn("n_hit", hit).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          window: int = WINDOW, most: int = BENCHMARK_BYTES) -> DataFrame:
    """The documents without a hit word, same columns."""

    def keeper(shared):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in blocks(batches, text_col):
                _, _, rows, _, _ = _scan(shared.value, Texts(part.column(text_col), LOWER))
                good = np.ones(part.num_rows, bool)
                good[rows] = False
                yield part.filter(pa.array(good))

        return keep

    for items in _item_blocks(benchmark, item_col, item_text, window, most):
        docs = docs.mapInArrow(keeper(docs.sparkSession.sparkContext.broadcast(items)), docs.schema)
    return docs
