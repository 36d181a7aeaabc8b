"""Token ids of whole texts by a public tokenizer, word by word.

The tokenizer's pieces never cross a space or a line feed, so a text's ids are those of its words in order. A task
keeps the ids of the words it has met (a bounded number) and asks the tokenizer for new ones only. Words of printable
ASCII and Latin letters up to U+017F are lower-cased and split here as the tokenizer does, so that its vocabulary model
is asked for unknown parts only; this is used where the tokenizer's file has the normalizer and splitter stated below,
and no text of the block has the string of a special token.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .spans import trim

KEPT_WORDS = 300_000
#: What the file must state for the short way.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+").fullmatch  # without U+0130, whose lower case is two characters
LATIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+").findall
_printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Byte-level vocabularies write a byte that has no printed character of its own as the next one from U+0100 on.
BYTES = {b: b for b in _printed} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _printed)}
_open: dict[str, WordIds] = {}


class WordIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

        self.model = self.tokenizer.model
        plan = json.loads(self.tokenizer.to_str())
        first = (plan["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.short = plan["normalizer"] == NORMAL and first.get("pattern") == {"Regex": SPLIT} and first.get("invert") is True
        self.special = [x["content"] for x in plan["added_tokens"]]
        self._reset()

    def _reset(self) -> None:
        self.number, self.part = {"": 0}, {}
        self.count, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, new: list[str], short: bool) -> None:
        """Ids of new words, by parts; a word that has other characters is left to the tokenizer itself."""
        part, tokenize, got, rest = self.part, self.model.tokenize, [], []
        for word in new:
            if not (short and LATIN(word)):
                rest.append(len(got))
                got.append(())
                continue
            low, ids = word.lower(), ()
            for x in (low,) if low.isalpha() else LATIN_SPLIT(low):
                own = part.get(x)
                if own is None:
                    shown = x if x.isascii() else x.encode().decode("latin-1").translate(BYTES)
                    own = part[x] = tuple([t.id for t in tokenize(shown)])
                ids += own
            got.append(ids)
        for k, x in zip(rest, self.tokenizer.encode_batch([new[k] for k in rest], add_special_tokens=False), strict=True):
            got[k] = x.ids
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.count = np.append(self.count, np.fromiter(map(len, got), np.int64, len(got)))
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(got), np.uint32))

    def encode(self, texts: pa.Array, kept: int = KEPT_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and how many each text has."""
        texts = pc.fill_null(texts, "")
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = pc.list_flatten(parts).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.number) > kept:
            self._reset()
        new = [x for x in distinct if x not in self.number]
        if new:
            self._learn(new, self.short and not any(pc.any(pc.match_substring(texts, x)).as_py() for x in self.special))
        number = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        count = self.count[number]
        start = (np.cumsum(self.count) - self.count)[number]
        ids = self.ids[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        return ids, np.add.reduceat(count, np.cumsum(sizes) - sizes) if len(texts) else np.zeros(0, np.int64)


def word_ids(path: str) -> WordIds:
    """The tokenizer of this worker process."""
    if path not in _open:
        _open[path] = WordIds(path)
    return _open[path]


def forget() -> None:
    """Give up the tokenizers and words of this worker process; for the end of a task."""
    _open.clear()
    trim()
