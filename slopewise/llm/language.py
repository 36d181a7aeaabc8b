"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword of bits. For each bit a binary classifier (log odds of hashed n-grams of lower-cased
bytes, orders 1 to 4) tells the languages with the bit from those without. Its margin on a text is the mean log odds of
the text's n-grams. A text goes to the language whose codeword has the least loss over all bits; a bit's loss is
logistic, and weighs as much as its classifier separates the training texts. The score is the share of the chosen
language when losses are turned into probabilities; a text whose two best languages are close is marked ambiguous.

Training counts n-grams of each language over all labelled training texts, summed in Spark; the driver sees one table of
counts, as large as languages times features, whatever the corpus. All rows are scored in one pass.

Edge cases: a null text, or one without a letter, is `und` with score 0; so is every text where there is nothing to
learn from. With one language all other texts go to it. Null and repeated doc_ids keep their rows (null is hashed as an
empty text). The names of languages, sources and ids are never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import LOWER, Texts, blocks, mix

FOLDS, HELD_OUT = 4, 2
ORDERS, FEATURES = (1, 2, 3, 4), 1 << 16
UNKNOWN, CLOSE = "und", 0.2
MOST_LANGUAGES = 1000  # beyond it, codes would need another way of being made; the job stops


def held_out(id_col: str, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def codewords(languages: int) -> np.ndarray:
    """A row of bits for each language: all ways to part a few languages in two, or hashed balanced columns for many."""
    if languages <= 6:
        bits = max(1, 2 ** (languages - 1) - 1)
        return np.array([[(k >> row) & 1 for k in range(1, bits + 1)] for row in range(languages)], bool)
    bits = int(np.ceil(15 * np.log2(languages)))
    rank = mix(np.arange(1, languages * bits + 1, dtype=np.uint64)).reshape(languages, bits).argsort(axis=0).argsort(axis=0)
    return rank < languages // 2


def grams(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the feature of each n-gram and its row; n-grams do not cross texts."""
    data = texts.data.astype(np.uint64)
    row = np.repeat(np.arange(texts.rows), texts.ends - texts.starts + 1)
    out, code = [], np.zeros(len(data), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code = (code[: len(code) - (n > 1)] << np.uint64(8)) | data[n - 1 :] if n > 1 else data.copy()
        if n in ORDERS:
            whole = row[: len(code)] == row[n - 1 :]
            out.append(((mix(code[whole] + (np.uint64(n) << np.uint64(40))) & np.uint64(FEATURES - 1)).astype(np.int64), row[: len(code)][whole]))
    return out


def _counter(languages: list[str]):
    number = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * FEATURES, np.int64)
        for part in blocks(batches, "text"):
            lang = np.array([number[x] for x in part.column("lang").to_pylist()])
            for feature, row in grams(Texts(part.column("text"), LOWER)):
                total += np.bincount(lang[row] * FEATURES + feature, minlength=len(total))
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 100_000):
            some = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    return count


class Classifiers:
    """Log odds of features for each bit, in whose units the mean margin of the languages' own n-grams is near 1, and the bits' weights."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.codes = languages, codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        odds, weight = [], []
        for bit in self.codes.T:
            if bit.all() or not bit.any():
                odds.append(np.zeros(FEATURES))
                weight.append(0.0)
                continue
            own = np.log(share[bit].mean(axis=0)) - np.log(share[~bit].mean(axis=0))
            margins = np.where(bit, 1, -1) * (share @ own)
            odds.append(own / max(np.abs(margins).mean(), 1e-9))
            weight.append(max(margins.min() / max(np.abs(margins).mean(), 1e-9), 0.05))
        self.odds = np.array(odds, np.float32)
        self.weight = np.array(weight) / max(sum(weight), 1e-9)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its probability and whether it is close to the next, from row by bit margins."""
        sign = np.where(self.codes, 1.0, -1.0)
        loss = np.stack([(self.weight * np.logaddexp(0, -4 * sign[k] * margins)).sum(axis=1) for k in range(len(sign))], axis=1)
        share = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        two = -np.sort(-share, axis=1)[:, :2]
        return loss.argmin(axis=1), share.max(axis=1), (two[:, 0] - two[:, -1] < CLOSE) & (share.shape[1] > 1)


def _guesser(shared):
    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages, object)
        for part in blocks(batches, "text"):
            texts = Texts(part.column("text"), LOWER)
            margins, total = np.zeros((texts.rows, len(model.odds))), np.zeros(texts.rows)
            for feature, row in grams(texts):
                total += np.bincount(row, minlength=texts.rows)
                for k, odds in enumerate(model.odds):
                    margins[:, k] += np.bincount(row, odds[feature], texts.rows)
            best, score, close = model.decode(margins / np.maximum(total, 1)[:, None])
            letters = part.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            lang = np.where(letters, names[best], UNKNOWN)
            arrays = [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(close & letters)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score", "ambiguous"])

    return guess


def fit(labelled: DataFrame, text_col: str, lang_col: str) -> Classifiers | None:
    """Classifiers from all rows of `labelled`; None without a language."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    languages = [r[0] for r in rows.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return None
    cells = rows.mapInArrow(_counter(languages), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(languages) * FEATURES)
    got = cells.toPandas()  # at most languages times features
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    return Classifiers(languages, counts.reshape(len(languages), FEATURES))


def identify(docs: DataFrame, model: Classifiers | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: `doc_id`, `lang_pred`, `score`, `ambiguous`."""
    letters = F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), letters.alias("letters"))
    if model is None:
        return plain.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return plain.mapInArrow(_guesser(shared), "doc_id long, lang_pred string, score double, ambiguous boolean")


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predictions for all documents, learned from the labelled ones that are not held out; with `held_out`."""
    model = fit(docs.filter(~held_out(id_col)), text_col, lang_col)
    out = identify(docs, model, id_col, text_col)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")
