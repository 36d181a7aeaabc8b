"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A shingle is five words; its weight is 1 + log2 of how often the text has it. Each shingle emits a Poisson process of
arrivals whose rate is its weight; each arrival falls into one of the registers, and a register keeps the shingle that
arrived first. Two texts agree in a register with the probability Jaccard similarity of their weighted shingles, which is
the plain one where no shingle repeats. A text's processes are followed in windows of time and end once each register
is taken, so a long text draws little more than one arrival for each shingle. Bands of registers give candidate
buckets; candidates are verified by the exact Jaccard similarity of their shingle sets. Where texts repeat shingles that is
another measure than the weighted one, and a pair can be far apart in it. A second signature of the same
processes with all weights one estimates the verified measure itself; its bands are candidates too. Where no shingle repeats
both signatures are the same and their bands are counted once.

Edge cases: a null text counts as empty. Equal texts are always one class, also those without a word, and no other
text is similar to one without a word. A text with one to four words is one shingle. Null and repeated doc_ids keep
their rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import classes, shared
from .scratch import Scratch, sized
from .spans import SPACE, Texts, blocks, mix, ragged, shingles

WORDS, SIMILAR = 5, 0.8
BANDS, IN_BAND = 16, 4
ROWS = 1 << 16  # of a block, since a row's number is packed with a fingerprint


def register_prints(prints: np.ndarray, row: np.ndarray, rows: int, registers: int, weighted: bool = True) -> np.ndarray:
    """Row by register: the fingerprint of the shingle that arrives there first (0 in rows without a shingle). At most ROWS rows."""
    key = np.sort((row.astype(np.uint64) << np.uint64(48)) | (prints >> np.uint64(16)))
    new = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    times = np.diff(new, append=len(key))
    key = key[new]
    of, element = (key >> np.uint64(48)).astype(np.int64), mix(key << np.uint64(16))
    weight = 1 + np.log2(times) if weighted else np.ones(len(times))
    total = np.bincount(of, weight, rows)
    window = np.divide(registers * (np.log(registers) + 4), total, out=np.zeros(rows), where=total > 0)
    until, taken = window.copy(), np.full(rows * registers, np.inf)
    first = np.zeros(rows * registers, np.uint64)
    at, k = np.zeros(len(key)), 0
    state = element.copy()
    at, state, register = _next(at, state, weight, registers)
    while True:
        on = np.flatnonzero(at < until[of])
        while len(on):
            cell, when = of[on] * registers + register[on], at[on]
            np.minimum.at(taken, cell, when)
            best = when == taken[cell]
            first[cell[best]] = element[on[best]]
            at[on], state[on], register[on] = _next(when, state[on], weight[on], registers)
            on = on[at[on] < until[of[on]]]
        short = np.isinf(taken.reshape(rows, registers)).any(1) & (total > 0)
        if not short.any():
            return first.reshape(rows, registers)
        until[short] += window[short]
        keep = short[of]
        at, state, register, of, element, weight = (x[keep] for x in (at, state, register, of, element, weight))


def _next(at: np.ndarray, state: np.ndarray, rate: np.ndarray, registers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The following arrival of each process: its time, the state of its random numbers, its register."""
    state = mix(state + np.uint64(0x9E3779B97F4A7C15))
    gap = -np.log(((state >> np.uint64(11)).astype(float) + 0.5) / 2**53)
    return at + gap / rate, state, (mix(state ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(registers)).astype(np.int64)


def band_keys(first: np.ndarray, bands: int, in_band: int) -> np.ndarray:
    """Row by band: one number for the band's registers, different from band to band."""
    parts = first.reshape(len(first), bands, in_band)
    out = mix(np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]))
    for k in range(in_band):
        out = mix(out * np.uint64(3) + parts[:, :, k])
    return out.view(np.int64)


def _signer(words: int, bands: int, in_band: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (block.slice(lo, ROWS) for block in blocks(batches, "text") for lo in range(0, block.num_rows, ROWS)):
            texts = Texts(part.column("text"))
            begin, end, row = texts.words(~SPACE)
            prints, of = shingles(texts.prints(begin, end), row, texts.rows, words)
            counts = np.bincount(of, minlength=texts.rows)
            some = np.flatnonzero(counts)
            keys = np.zeros((0, 2 * bands), np.int64)
            if len(some):
                both = [register_prints(prints, of, texts.rows, bands * in_band, weighted)[some] for weighted in (True, False)]
                keys = np.concatenate([band_keys(x, bands, in_band) for x in both], axis=1)
            lists = ragged(keys.ravel(), np.where(counts > 0, 2 * bands, 0), pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "digest")), lists], ["doc_id", "digest", "bands"])

    return sign


def _setter(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            texts = Texts(part.column("text"))
            begin, end, row = texts.words(~SPACE)
            prints, of = shingles(texts.prints(begin, end), row, texts.rows, words)
            cuts = np.searchsorted(of, np.arange(texts.rows + 1))
            own = [np.unique(prints[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
            lists = ragged(np.concatenate(own).view(np.int64), np.array([len(x) for x in own]), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "shingles"])

    return sets


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                 similar: float = SIMILAR, bands: int = BANDS, in_band: int = IN_BAND) -> DataFrame:
    """One row for each document: `doc_id`, `class_id` (least doc_id of its class), `copies` (documents in the class),
    `kept` (true for one document of each class), `digest` (of the text) and `row` (a number of its own).

    A class holds equal texts and texts that a chain of links joins. The rows are read from a written table.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))
    signed = scratch.table(plain.mapInArrow(_signer(words, bands, in_band), "doc_id long, digest binary, bands array<long>"), "signed")
    signed_rows = signed.withColumn("row", F.monotonically_increasing_id())
    nodes = signed.groupBy("digest").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("doc_id"))
    nodes = scratch.table(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    members = scratch.table(shared(nodes.select("id", F.explode(F.array_distinct("bands")).alias("bucket"))), "members")
    wanted = nodes.join(members.select("id").distinct(), "id", "left_semi").select("id", "digest", "doc_id")
    wanted = sized(scratch.table(wanted, "wanted"))
    texts = plain.join(wanted.withColumnsRenamed({"doc_id": "own", "digest": "print"}),
                       F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("print")))
    sets = scratch.table(texts.select("id", "text").mapInArrow(_setter(words), "id long, shingles array<long>").dropDuplicates(["id"]), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.join(x, "a").join(y, "b").filter(both >= similar * (F.size("sa") + F.size("sb") - both))

    def elements(ids: DataFrame) -> DataFrame:
        return sets.join(ids, "id").select("id", F.explode("shingles").alias("element"))

    roots = classes(scratch, members, verify, elements, similar)
    label = nodes.select("id", "digest").join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("class"))
    rows = scratch.table(signed_rows.select("row", "doc_id", "digest").join(label, "digest").select("row", "doc_id", "digest", "class"), "rows")
    best = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("best"), F.count("*").alias("copies"))
    out = rows.join(best, "class").select("doc_id", F.col("best.doc_id").alias("class_id"), "copies", (F.col("row") == F.col("best.row")).alias("kept"), "digest", "row")
    scratch.drop(signed, nodes, members, wanted, sets, roots)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, same columns. Rows are found again by doc_id and digest; of rows that have both the same one stays."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(near_classes(docs, id_col, text_col, **options).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_print"), "kept"), "classes")
    keys = rows.groupBy("_id", "_print").agg(F.max("kept").alias("any"), F.count("*").alias("n"))
    gone = scratch.table(keys.filter("not any").select("_id", "_print"), "gone")
    again = scratch.table(keys.filter("any and n > 1").select("_id", "_print"), "again")
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_print"))
    key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    out = docs.select(F.struct("*").alias("_own"), F.col(id_col).cast("long").alias("_doc"), key.alias("_key"))
    out = out.join(sized(gone), same, "left_anti")
    if not again.isEmpty():
        twice = out.join(sized(again), same, "left_semi").dropDuplicates(["_doc", "_key"])
        out = out.join(sized(again), same, "left_anti").unionByName(twice)
    return out.select("_own.*")
