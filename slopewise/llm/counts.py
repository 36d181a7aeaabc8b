"""Token counts of documents under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

A pre-token is a longest run of characters other than white space (space and the five controls from tab to carriage
return). Each task keeps one count for each distinct pre-token it has met (a bounded number); new ones of a block of
texts are sorted into a trie, whose shared prefixes are scored once, and the count at a pre-token's end is stored. A
document's tokens are the sum over its pre-tokens. Nothing is shuffled.

Edge cases: a null or empty text has no tokens. Null and repeated doc_ids keep their rows. A character without a piece
counts as many tokens as it has bytes. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import Pieces, public_pieces, token_counts
from .spans import SPACE, Texts, blocks

KEPT_WORDS = 1_000_000
_open: dict[str, tuple[Pieces, dict[int, int]]] = {}


def distinct_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, begin and end of each distinct word of a block; for each word its number there and its row."""
    begin, end, row = texts.words(~SPACE)
    prints, first, number = np.unique(texts.prints(begin, end), return_index=True, return_inverse=True)
    return prints, begin[first], end[first], number, row


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _open:
            _open[path] = Pieces(public_pieces(path)), {}
        pieces, known = _open[path]
        for part in blocks(batches, "text"):
            texts = Texts(part.column("text"))
            prints, begin, end, number, row = distinct_words(texts)
            keys = prints.tolist()
            new = [k for k, x in enumerate(keys) if x not in known]
            if len(known) + len(new) > KEPT_WORDS:
                known.clear()
                new = range(len(keys))
            raw = texts.data.tobytes()
            words = sorted((raw[begin[k] : end[k]].decode(), keys[k]) for k in new)
            known.update(zip((x for _, x in words), token_counts(pieces, [w for w, _ in words]), strict=True))
            each = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
            tokens = np.bincount(row, each[number], texts.rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.bincount(row, minlength=texts.rows)), pa.array(tokens)], ["doc_id", "n_pretokens", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: `doc_id`, `n_pretokens`, `n_tokens`. `pieces`: path of a public piece file."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(_counter(pieces), "doc_id long, n_pretokens long, n_tokens long")
