"""Quality rules from the repetition inside each text, found with suffix arrays.

The words of a block of texts form one suffix array in which no common prefix crosses texts. The longest common prefix
of neighbouring suffixes bounds the maximal repeated runs of words; the union of their spans is the repeated part.
A text passes if runs of at least `LEAST` words cover at most `SHARE` of its words and no repeated run is longer than
`LONGEST` words, and if it does not fail the base rules.

Edge cases: a null or empty text has no words, fails the base rules (under 20 words) and is not kept. Overlapping
occurrences count as repeats. Null and repeated doc_ids keep their rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import SPACE, Texts, blocks, forget, mix
from .suffix import SuffixArray, covered

LEAST, SHARE, LONGEST = 5, 0.4, 50
WINDOW, FEW_WORDS, BASE_PERCENT = 8, 20, 30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
PASSING_BYTES = 1 << 20  # of a block where whole documents pass through
MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, repeats array<struct<start:long,length:long>>"


def _counts(column: pa.Array, least: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The numbers of MEASURES for each text of a block, which words runs of `least` cover, and each word's row."""
    texts = Texts(column)
    rows, data = texts.rows, texts.data
    begin, end, row = texts.words(~SPACE)
    words = texts.prints(begin, end)
    longest = SuffixArray(mix(words ^ mix(row.astype(np.uint64)))).longest(len(words)) if len(words) else np.zeros(0, np.int64)
    per_row = lambda hit, of: np.bincount(of[hit], minlength=rows)
    spread = {}
    for k in {least, WINDOW}:
        at = np.flatnonzero(longest >= k)
        spread[k] = covered(at, longest[at], len(words))
    upto = lambda hit: np.concatenate([[0], np.cumsum(hit, dtype=np.int32 if len(data) < 1 << 31 else np.int64)])
    chars, symbols = upto((data & 0xC0) != 0x80), upto(SYMBOLS[data])
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row, longest)
    numbers = [np.bincount(row, minlength=rows), np.bincount(row, chars[end] - chars[begin], rows), symbols[texts.ends] - symbols[texts.starts], _repeated_lines(texts, begin),
               per_row(spread[WINDOW], row), per_row(spread[least], row), most]
    return [x.astype(np.int64) for x in numbers], spread[least], row


def _measure(least: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            numbers, hit, row = _counts(part.column("text"), least)
            arrays = [part.column("doc_id"), *map(pa.array, numbers), _merged(hit, row, part.num_rows)]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in MEASURES.split(", ")])

    return measure


def _repeated_lines(texts: Texts, word_begin: np.ndarray) -> np.ndarray:
    """For each text, its lines that hold a word and equal an earlier line."""
    begin, end, row = texts.runs(texts.data != 0x0A)
    full = np.searchsorted(word_begin, end) > np.searchsorted(word_begin, begin)
    begin, end, row = begin[full], end[full], row[full]
    if not len(begin):
        return np.zeros(texts.rows, np.int64)
    _, first = np.unique(mix(texts.prints(begin, end) ^ mix(row.astype(np.uint64))), return_index=True)
    return np.bincount(row, minlength=texts.rows) - np.bincount(row[first], minlength=texts.rows)


def _merged(hit: np.ndarray, row: np.ndarray, rows: int) -> pa.ListArray:
    """Runs of covered words of each text, as places in the text."""
    first = np.searchsorted(row, np.arange(rows))
    inside = np.flatnonzero(hit)
    fresh = np.diff(inside, prepend=-2) > 1
    fresh[1:] |= row[inside][1:] != row[inside][:-1]
    start = np.flatnonzero(fresh)
    length = np.diff(start, append=len(inside))
    of = row[inside[start]]
    spans = pa.StructArray.from_arrays([pa.array(inside[start] - first[of]), pa.array(length)], ["start", "length"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), spans)


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, share: float = SHARE,
               longest: int = LONGEST) -> DataFrame:
    """One row for each document: its counts, `repeats` (start and length in words), `base_failed`, `kept`."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return judged(plain.mapInArrow(_measure(least), MEASURES), share, longest)


def judged(measured: DataFrame, share: float = SHARE, longest: int = LONGEST) -> DataFrame:
    base = f"n_words < {FEW_WORDS} or 100 * n_repeat_words > {BASE_PERCENT} * n_words"
    verdict = f"covered_words <= {share}D * n_words and longest_repeat <= {longest}"
    return measured.withColumn("base_failed", F.expr(base)).withColumn("kept", F.expr(f"not base_failed and {verdict}"))


def passing(docs: DataFrame, text_col: str = "text", least: int = LEAST, share: float = SHARE, longest: int = LONGEST) -> DataFrame:
    """The documents that are kept, same columns, in one pass without a shuffle."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text_col, PASSING_BYTES):
            (n_words, _, _, _, repeated, spread, longest_run), _, _ = _counts(part.column(text_col), least)
            good = (n_words >= FEW_WORDS) & (100 * repeated <= BASE_PERCENT * n_words)
            good &= (spread <= share * n_words) & (longest_run <= longest)
            yield part.filter(pa.array(good))
        forget()

    return docs.mapInArrow(keep, docs.schema)
