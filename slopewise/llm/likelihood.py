"""Language-model scores of documents: marginal likelihood over all segmentations into subword pieces.

A text is a stream of units that ends with an end unit. A unit is a piece of a public vocabulary, a whole word of the
training texts, or the end; all probabilities sum to one. A word's probability is the sum over all its segmentations,
by forward recursion in log space over a trie of the corpus's distinct words. Whole words have their discounted count;
what the discount (n1 / (n1 + 2 n2), of words seen once and twice) takes off goes to the pieces, whose expected counts in
the distinct training words are re-estimated from the vocabulary's own scores by expectation maximisation.

The corpus is counted in Spark: distinct words are rows of a table, never gathered. The driver sees one number for
each piece of the vocabulary. Each block of texts sends one row for each of its distinct words, listing the documents;
the word's scores join to it, and sums return to the documents with map-side combining.

Edge cases: a null or empty text is only an end. Null doc_ids are hashed as an empty text. Null and repeated doc_ids
keep their rows. Without training documents every word has smoothing alone. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counts import distinct_words
from .lattice import Pieces, expected_counts, log_totals, public_pieces
from .scratch import Scratch
from .spans import LOWER, Texts, blocks

FOLDS, HELD_OUT, ROUNDS, SMOOTHING = 5, 1, 2, 0.1
WORDS_AT_ONCE = 100_000
END = ""  # stands for the end unit among the words, none of which is empty
USES = "word string, base long, uses array<int>, train long, doc_ids array<long>"


def held_out(id_col: str, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block one row for each distinct word: its documents (place in the block * 2**16 + times), its times in training texts."""
    for big in blocks(batches, "text"):
        for lo in range(0, big.num_rows, 1 << 14):
            part = big.slice(lo, 1 << 14)
            texts = Texts(part.column("text"), LOWER)
            _, begin, end, number, row = distinct_words(texts)
            train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
            pair, times = np.unique(number * np.int64(texts.rows) + row, return_counts=True)
            of, at = pair // texts.rows, pair % texts.rows
            trained = np.bincount(of, times * train[at], len(begin)).astype(np.int64)
            more = -(-times // 0xFFFF)  # entries with more than 16 bits are split
            left = np.repeat(times, more)
            nth = np.arange(len(left)) - np.repeat(np.cumsum(more) - more, more)
            left = np.minimum(left - nth * 0xFFFF, 0xFFFF)
            packed, sizes = np.repeat(at, more) << 16 | left, np.bincount(np.repeat(of, more), minlength=len(begin))
            raw = texts.data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)] + [END]
            packed = np.append(packed, np.arange(texts.rows) << 16 | 1).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(np.append(sizes, texts.rows))]).astype(np.int32)
            ids = pa.array([None] * len(begin) + [part.column("doc_id").to_pylist()], pa.list_(pa.int64()))
            base = np.full(len(words), part.column("row")[0].as_py())
            arrays = [pa.array(words, pa.string()), pa.array(base), pa.ListArray.from_arrays(pa.array(offsets), pa.array(packed)),
                      pa.array(np.append(trained, train.sum()).astype(np.int64)), ids]
            whole = pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in USES.split(", ")])
            for a in range(0, len(words), 10_000):
                yield whole.slice(a, 10_000)


def _expected(scores: dict[str, float]):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, total = Pieces(scores), {}
        for words in _sorted_words(batches):
            for piece, n in expected_counts(pieces, [w for w, _ in words]).items():
                total[piece] = total.get(piece, 0.0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64())], ["piece", "n"])

    return expect


def _scored(scores: dict[str, float], discount: float, units: float, tokens: int, kinds: int, ended: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(scores)
        for words in _sorted_words(batches):
            count = np.array([c for _, c in words], float)
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(count - discount, 0) / units)
                total = np.logaddexp(np.array(log_totals(pieces, [w for w, _ in words])), whole)
            end = np.array([w == END for w, _ in words])
            total[end] = log((ended + 0.5) / units)
            base = np.log10((count + 0.5) / (tokens + 0.5 * (kinds + 1)))
            arrays = [pa.array([w for w, _ in words], pa.string()), pa.array(count > 0), pa.array(base), pa.array(total / log(10))]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "known", "base", "own"])

    return score


def _sorted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int]]]:
    """The words and their training counts, sorted, many at once so that prefixes are shared."""
    held: list[tuple[str, int]] = []
    for batch in batches:
        held += zip(batch.column("word").to_pylist(), batch.column("c").to_pylist(), strict=True)
        if len(held) >= WORDS_AT_ONCE:
            yield sorted(held)
            held = []
    if held:
        yield sorted(held)


def score_texts(docs: DataFrame, pieces: str, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None,
                rounds: int = ROUNDS) -> DataFrame:
    """One row for each document: `doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`.

    `train`: a condition for training documents (default: not held out). `pieces`: path of a public piece file.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    train = ~held_out(id_col) if train is None else train
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), train.alias("train"),
                        F.monotonically_increasing_id().alias("row"))
    uses = plain.mapInArrow(_uses, USES)
    words = scratch.table(uses.groupBy("word").agg(F.sum("train").alias("c")), "words")
    stats = words.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long")), *(F.sum((F.col("c") == n).cast("long")) for n in (1, 2)),
                      F.sum(F.when(F.col("word") == END, F.col("c"))), F.sum(((F.col("c") > 0) & (F.col("word") != END)).cast("long"))).first()
    tokens, kinds, once, twice, ended, types = (x or 0 for x in stats)
    discount = once / (once + 2 * twice) if once and twice else 0.5

    # Expected counts of pieces in the distinct training words, and the mass the discount leaves to them.
    scores = public_pieces(pieces)
    trained = words.filter((F.col("c") > 0) & (F.col("word") != END))
    for _ in range(rounds if types else 0):
        got = trained.mapInArrow(_expected(scores), "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        counts = {r[0]: discount * r[1] for r in got.collect() if r[0] in scores}  # as many rows as the vocabulary has, at most
        mass = sum(counts.values()) + SMOOTHING * len(scores)
        scores = {p: log((counts.get(p, 0.0) + SMOOTHING) / mass) for p in scores}
    mass = mass if types else SMOOTHING * len(scores)
    units = tokens - ended - discount * types + mass + ended + 0.5
    scores = {p: s + log(mass / units) for p, s in scores.items()}

    scored = scratch.table(words.mapInArrow(_scored(scores, discount, units, tokens, kinds, ended), "word string, known boolean, base double, own double"), "scored")
    scratch.drop(words)
    use = F.explode("uses").alias("use")
    ids = F.when(F.col("doc_ids").isNotNull(), F.element_at("doc_ids", F.shiftright("use", 16) + 1))
    times = F.col("use").bitwiseAND(0xFFFF)
    each = uses.drop("train").join(scored.withColumnRenamed("base", "plain"), "word").select("base", "doc_ids", "known", "plain", "own", use)
    each = each.select((F.col("base") + F.shiftright("use", 16)).alias("row"), ids.alias("doc_id"), times.cast("long").alias("n"),
                       F.when(F.col("known"), times).otherwise(0).cast("long").alias("k"), (times * F.col("plain")).alias("b"), (times * F.col("own")).alias("s"))
    out = each.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("k").alias("n_known"),
                                  F.sum("b").alias("base_score"), F.sum("s").alias("score"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"),
                      "base_score", "score")
