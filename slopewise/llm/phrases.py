"""Passages that occur more than once, found with Aho-Corasick automata over words.

A passage is a window of consecutive words whose sequence also starts somewhere else, in the same text or another one.

* Candidates: the least fingerprint of the shorter runs inside a window is its anchor. Equal windows have equal anchors, so a window
  whose anchor is met once in the whole corpus needs no second look, and neighbouring windows mostly share their anchor.
* Confirmation: stretches of neighbouring windows with one recurring anchor are brought together by it. A stretch met twice is a
  passage as it is; the windows of the others are compared word by word, and those met again are passages. Passages become
  the patterns of an automaton. A shard holds the anchors of a few megabytes of stretches.
* Search: the stretches of all documents stream through the automaton of their shard, which locates every occurrence.

An anchor with very many stretches is not brought together. Its windows are counted by 16-byte digests, which are summed in each
task first. The stretches stay where they are, each batch has an automaton of the windows that are too frequent for a shard, and
the windows it does not find go on by themselves, keyed by their digest.

Equal texts are searched once and count twice. Words are runs of characters other than space and U+0009 to U+000D, unchanged.

Edge cases: a null text is empty. A text of fewer words than a window has no passage. Null and repeated doc_ids keep their rows.
An empty table gives no rows. A text is held whole by one task, several times its size; stretches of windows are cut at a fixed number.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .spans import SPACE, Texts, blocks, mix
from .suffix import covered

WINDOW, ANCHOR = 35, 12
HOT = 4096  # stretches of an anchor up to which they are brought together
RUN = 64  # windows of a stretch
SHARD_BYTES = 2 << 20
BROADCAST_KEYS = 100_000  # at most so many keys can hold this fraction of all rows each
STRETCH = "anchor long, n long, print binary, twice boolean, start int, text string"
DEALT = "anchor long, print binary, twice boolean, start int, length int, text string"


def _run_prints(prints: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of each run of `n` words, by the fingerprints of its halves."""
    if n == 1:
        return prints
    half = _run_prints(prints, n // 2)
    rest = half if n % 2 == 0 else _run_prints(prints, n - n // 2)
    size = len(prints) - n + 1
    return mix(half[:size] * np.uint64(3) + mix(rest[n // 2 : n // 2 + size]))


def _sliding(values: np.ndarray, n: int, least: np.ufunc) -> np.ndarray:
    """`least` of each `n` neighbours."""
    span, out = 1, values
    while 2 * span <= n:
        out = least(out[: len(out) - span], out[span:])
        span *= 2
    return least(out[: len(out) - (n - span)], out[n - span :]) if span < n else out


class Windows:
    """The words of a block of texts and the anchor of each window (0 where the window would cross texts)."""

    def __init__(self, texts: Texts, window: int, anchor: int):
        self.begin, self.end, self.row = texts.words(~SPACE)
        n, inside = len(self.begin), window - anchor + 1
        self.first = np.searchsorted(self.row, np.arange(texts.rows))
        self.anchors, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n >= window:
            runs = _run_prints(texts.prints(self.begin, self.end), anchor) | np.uint64(1)
            whole = self.row[window - 1 :] == self.row[: n - window + 1]
            self.anchors = np.where(whole, _sliding(runs, inside, np.minimum), np.uint64(0))
            edge = np.zeros(inside - 1, np.uint64)
            met = _sliding(np.concatenate([edge, self.anchors, edge]), inside, np.maximum)
            self.places = np.flatnonzero(met == runs)  # where the anchor of some window lies
            self.place_anchors = runs[self.places]

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, anchor and number of places of each anchor of each text."""
        if not len(self.places):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        row, anchor = self.row[self.places], self.place_anchors
        by = np.lexsort((anchor, row))
        row, anchor = row[by], anchor[by]
        new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(anchor, prepend=~anchor[:1]) != 0))
        return row[new], anchor[new], np.diff(new, append=len(row))

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each stretch with one anchor, at most RUN windows long."""
        change = np.flatnonzero(np.diff(self.anchors, prepend=~self.anchors[:1]) != 0)
        size = np.diff(change, append=len(self.anchors))
        some = self.anchors[change] > 0
        change, size = change[some], size[some]
        pieces = -(-size // RUN)
        at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(change, pieces) + RUN * at
        return start, np.minimum(np.repeat(size, pieces) - RUN * at, RUN)


def _anchors(window: int, anchor: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            row, anchors, times = Windows(Texts(part.column("text")), window, anchor).counted()
            yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), part.column("print").take(pa.array(row)), pa.array(times)], ["anchor", "print", "n"])

    return find


def _stretches(window: int, anchor: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            texts = Texts(part.column("text"))
            w = Windows(texts, window, anchor)
            start, size = w.stretches()
            wanted = part.column("anchors")
            pairs = pd.DataFrame({"row": np.repeat(np.arange(part.num_rows), pc.list_value_length(wanted).to_numpy()),
                                  "anchor": wanted.flatten().field("anchor").to_numpy(), "n": wanted.flatten().field("n").to_numpy()})
            mine = pd.DataFrame({"row": w.row[start], "anchor": w.anchors[start].view(np.int64), "start": start, "size": size})
            mine = mine.merge(pairs, on=["row", "anchor"])
            start, row = mine["start"].to_numpy(), mine["row"].to_numpy()
            data = texts.data.tobytes()
            lo, hi = w.begin[start].tolist(), w.end[start + mine["size"].to_numpy() + window - 2].tolist()
            for at in range(0, len(mine), 8192):
                to = at + 8192
                text = pa.array([data[x:y] for x, y in zip(lo[at:to], hi[at:to], strict=True)], pa.binary()).cast(pa.string())
                take = pa.array(row[at:to])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine["anchor"].to_numpy()[at:to]), pa.array(mine["n"].to_numpy()[at:to]), part.column("print").take(take), pc.greater(part.column("copies").take(take), 1),
                     pa.array((start - w.first[row])[at:to].astype(np.int32)), text], ["anchor", "n", "print", "twice", "start", "text"])

    return cut


def _searched(patterns: list[bytes], ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which places of `ids` lie in an occurrence of a pattern (the bytes of its word numbers); `offsets` bound the stretches, which no match crosses."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for p in patterns:
        automaton.add_word(tuple(np.frombuffer(p, np.int32).tolist()))
    automaton.make_automaton()
    lengths = np.diff(offsets)
    apart = np.full(len(ids) + len(lengths), int(ids.max()) + 1, np.int64)  # a number of no word after each stretch
    slot = np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)
    apart[slot] = ids
    found = np.fromiter(chain.from_iterable(automaton.iter(tuple(apart.tolist()))), np.int64).reshape(-1, 2)
    return covered(found[:, 0] - found[:, 1] + 1, found[:, 1], len(apart))[slot]


def _numbered(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word numbers of all stretches, where each stretch begins, and the words."""
    lists = pc.ascii_split_whitespace(text)
    words = lists.flatten().dictionary_encode()
    return words.indices.to_numpy().astype(np.int32), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]), words.dictionary


def _windows_of(offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and stretch of each window."""
    sizes = np.maximum(np.diff(offsets) - window + 1, 0)
    of = np.repeat(np.arange(len(sizes)), sizes)
    return offsets[:-1][of] + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes), of


def _spans(rows: pa.RecordBatch, offsets: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    """Runs of hit words inside stretches, as spans of words of their texts."""
    found = np.flatnonzero(hit)
    of = np.searchsorted(offsets, found, "right") - 1
    new = np.flatnonzero((np.diff(found, prepend=-2) > 1) | (np.diff(of, prepend=-1) != 0))
    length = np.diff(new, append=len(found))
    of, take = of[new], pa.array(of[new])
    start = rows.column("start").to_numpy()[of] + found[new] - offsets[of]
    return pa.RecordBatch.from_arrays([rows.column("print").take(take), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))], ["print", "start", "length"])


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, cut into batches of about `most` bytes of text with every anchor whole."""
    held, size = [], 0
    for batch in batches:
        for part in blocks([batch], "text", most):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if size >= most:
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column("anchor").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from table.slice(0, cut).to_batches()
                table = table.slice(cut)
                held, size = table.to_batches(), pc.sum(pc.binary_length(table.column("text"))).as_py() or 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _confirmed(ids: np.ndarray, offsets: np.ndarray, twice: list[bool], window: int) -> list[bytes]:
    """The passages of a shard: stretches met twice, and windows of the others that are met again anywhere."""
    raw, times = ids.tobytes(), {}
    bounds = (4 * offsets).tolist()
    for lo, hi, two in zip(bounds, bounds[1:], twice, strict=False):
        key = raw[lo:hi]
        times[key] = times.get(key, 0) + 1 + two
    size = 4 * window
    whole = [key for key, n in times.items() if n > 1]
    known = {key[lo : lo + size] for key in whole for lo in range(0, len(key) - size + 4, 4)}
    met, again = set(), set()
    for key, n in times.items():
        if n == 1:
            for lo in range(0, len(key) - size + 4, 4):
                x = key[lo : lo + size]
                if x in known or x in met:
                    again.add(x)
                else:
                    met.add(x)
    return [*whole, *again]


def _located(window: int, shard_bytes: int):
    """Confirm the passages of a shard, compile its automaton, stream its stretches."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_bytes):
            ids, offsets, _ = _numbered(shard.column("text"))
            patterns = _confirmed(ids, offsets, shard.column("twice").to_pylist(), window)
            if patterns:
                yield _spans(shard, offsets, _searched(patterns, ids, offsets))

    return locate


def _digests(words: list[str], offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    at, of = _windows_of(offsets, window)
    return at, of, [hashlib.blake2b(" ".join(words[p : p + window]).encode(), digest_size=16).digest() for p in at.tolist()]


def _counted(window: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", SHARD_BYTES):
            ids, offsets, names = _numbered(part.column("text"))
            _, of, digests = _digests(names.take(pa.array(ids)).to_pylist(), offsets, window)
            rows = pd.DataFrame({"anchor": part.column("anchor").to_numpy()[of], "n": part.column("n").to_numpy()[of], "digest": digests,
                                 "times": 1 + part.column("twice").to_numpy(zero_copy_only=False)[of].astype(int)})
            yield pa.RecordBatch.from_pandas(rows.groupby(["anchor", "n", "digest"], as_index=False)["times"].sum(), preserve_index=False)

    return count


def _dealt(window: int):
    """Locate the most frequent windows of hot anchors; pass the others on as stretches of their own, keyed by digest."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", SHARD_BYTES):
            ids, offsets, names = _numbered(part.column("text"))
            words = names.take(pa.array(ids)).to_pylist()
            at, of, digests = _digests(words, offsets, window)
            often = [set(x or ()) for x in part.column("often").to_pylist()]
            frequent = np.array([d in often[k] for d, k in zip(digests, of.tolist(), strict=True)], bool)
            raw = ids.tobytes()
            patterns = {raw[4 * p : 4 * (p + window)] for p in at[frequent].tolist()}
            if patterns:
                s = _spans(part, offsets, _searched(list(patterns), ids, offsets))
                none = lambda kind: pa.nulls(s.num_rows, kind)
                yield pa.RecordBatch.from_arrays([none(pa.int64()), s.column("print"), none(pa.bool_()), s.column("start"), s.column("length"), none(pa.string())],
                                                 [x.split()[0] for x in DEALT.split(", ")])
            rest = np.flatnonzero(~frequent)
            take = pa.array(of[rest])
            start = part.column("start").to_numpy()[of[rest]] + at[rest] - offsets[of[rest]]
            keys = np.array([int.from_bytes(digests[k][:8], "little", signed=True) for k in rest.tolist()], np.int64)
            text = pa.array([" ".join(words[p : p + window]) for p in at[rest].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(keys), part.column("print").take(take), part.column("twice").take(take), pa.array(start.astype(np.int32)),
                                              pa.nulls(len(rest), pa.int32()), text], [x.split()[0] for x in DEALT.split(", ")])

    return deal


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches, "text"):
        texts = Texts(part.column("text"))
        begin, end, row = texts.words(~SPACE)
        first = np.searchsorted(row, np.arange(texts.rows + 1))
        spans = part.column("spans")
        flat = spans.flatten()
        base = np.repeat(first[:-1], pc.fill_null(pc.list_value_length(spans), 0).to_numpy())
        gone = covered(base + flat.field("start").to_numpy(), flat.field("length").to_numpy().astype(np.int64), len(row))
        removed = np.bincount(row[gone], minlength=texts.rows)
        data, left = texts.data.tobytes(), ~gone
        lo, hi = begin[left].tolist(), end[left].tolist()
        ends = np.searchsorted(row[left], np.arange(texts.rows + 1)).tolist()
        kept = [b" ".join([data[x:y] for x, y in zip(lo[a:b], hi[a:b], strict=True)]) for a, b in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [part.column("print"), part.column("copies"), pa.array(np.diff(first)), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
             pa.array(kept, pa.binary()).cast(pa.string())], ["print", "copies", "n_words", "n_removed", "kept_sha256", "kept"])


def dealt_join(left: DataFrame, right: DataFrame, key: str, count: str, how: str, hot: int = HOT) -> DataFrame:
    """Join to `right` (one row a key, with the number of `left` rows that have it), so that no task gets all rows of a frequent key.

    Keys with at least `hot` rows and a 100,000th of all rows, of which there can be no more than 100,000, are broadcast; the others meet in a shuffle.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    edge = max(hot, total // BROADCAST_KEYS + 1)
    often = right.filter(F.col(count) >= edge)
    if often.isEmpty():
        return left.join(right, key, how)
    some = left.join(F.broadcast(often), key)
    rest = left.join(F.broadcast(often.select(key)), key, "left_anti")
    return some.unionByName(rest.join(right.filter(F.col(count) < edge), key, how))


def _spread(prints: DataFrame, scratch: Scratch, window: int, anchor: int, hot: int, shard_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """`print`, `start`, `length` of the located passages, and the tables they are read from. `prints`: `print` and `text` of each document."""
    met = scratch.table(prints.mapInArrow(_anchors(window, anchor), "anchor long, print binary, n long"), "anchors")
    again = scratch.table(met.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).filter("n > 1"), "recurring")
    wanted = dealt_join(met.select("anchor", "print"), again, "anchor", "rows", "inner", hot)
    wanted = wanted.groupBy("print").agg(F.collect_set(F.struct("anchor", "n")).alias("anchors"))
    cut = _distinct(prints).join(wanted, "print").mapInArrow(_stretches(window, anchor), STRETCH)
    stretches = scratch.table(cut, "stretches")
    scratch.drop(met, again)
    cold = stretches.filter(F.col("n") < hot).select("anchor", "print", "twice", "start", "text")
    tables, out = [stretches], None
    warm = stretches.filter(F.col("n") >= hot)
    if not warm.isEmpty():
        often = warm.mapInArrow(_counted(window), "anchor long, n long, digest binary, times long").groupBy("anchor", "n", "digest").agg(F.sum("times").alias("times"))
        often = often.filter(F.col("times") >= hot).groupBy("anchor", "n").agg(F.collect_list("digest").alias("often"))
        salts = F.expr(f"n div {16 * hot}")
        often = often.select("anchor", F.explode(F.sequence(F.lit(0), salts)).alias("salt"), "often")
        warm = warm.withColumn("salt", F.pmod(F.xxhash64("print", "start"), salts + 1)).join(often, ["anchor", "salt"], "left").drop("salt", "n")
        dealt = scratch.table(warm.mapInArrow(_dealt(window), DEALT), "dealt")
        tables.append(dealt)
        out = dealt.filter("text is null").select("print", "start", "length")
        cold = cold.unionByName(dealt.filter("text is not null").select("anchor", "print", "twice", "start", "text"))
    found = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_located(window, shard_bytes), "print binary, start int, length int")
    return (found if out is None else found.unionByName(out)), tables


def _distinct(prints: DataFrame) -> DataFrame:
    return prints.groupBy("print").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT,
                      shard_bytes: int = SHARD_BYTES, with_text: bool = False) -> DataFrame:
    """One row for each document: `doc_id`, `n_words`, `n_removed` (words inside a repeated passage), `kept_sha256` of the words kept, joined by a space,
    and, with `with_text`, `kept` (those words)."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    prints = docs.select(F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("print"), text.alias("text"))
    found, tables = _spread(prints, scratch, window, anchor, hot, shard_bytes)
    spans = found.groupBy("print").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    schema = "print binary, copies long, n_words long, n_removed long, kept_sha256 string, kept string"
    cut = _distinct(prints).join(spans, "print", "left").mapInArrow(_cut, schema)
    cut = scratch.table(cut if with_text else cut.drop("kept"), "kept")
    scratch.drop(*tables)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("print"))
    return dealt_join(rows, cut, "print", "copies", "inner", hot).drop("print", "copies")
