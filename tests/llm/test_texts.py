"""Operators that look at one text at a time against brute force."""

import math
import random
import re
import zlib

import brute
import numpy as np
import pytest

from slopewise.llm import lattice
from slopewise.llm.contamination import clean, contamination
from slopewise.llm.counts import count_tokens
from slopewise.llm.language import Classifiers, codewords, languages
from slopewise.llm.likelihood import score_texts
from slopewise.llm.packing import best_fit, pack
from slopewise.llm.quality import passing, repetition
from slopewise.llm.queries import tokenizer_path
from slopewise.llm.suffix import SuffixArray

WORDS, PIECES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")


def test_suffix_array_and_common_prefixes():
    pick = np.random.default_rng(0)
    for _ in range(200):
        n = int(pick.integers(1, 50))
        w = pick.integers(0, 3, n).astype(np.uint64)
        found, plain = SuffixArray(w), w.tolist()
        assert [plain[i:] for i in found.order] == sorted(plain[i:] for i in range(n))
        for (a, b), got in zip(zip(found.order, found.order[1:]), found.common()[1:]):
            k = 0
            while max(a, b) + k < n and plain[a + k] == plain[b + k]:
                k += 1
            assert got == k


def test_repetition(odd_docs, odd_rows):
    got = repetition(odd_docs).drop("repeats").collect()
    short = [(i, t) for i, t in odd_rows if len(t or "") < 5000]
    want = sorted((str(i), *brute.repetition(t)) for i, t in short)
    have = sorted((str(r[0]), *r[1:]) for r in got if r.doc_id != 92)
    assert have == want and len(got) == len(odd_rows)
    kept = passing(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert repetition(odd_docs.limit(0)).count() == 0


def test_passing_agrees_over_several_blocks_of_a_batch(spark):
    pick = random.Random(3)
    rows = [(k, " ".join(pick.choice(["again and again it goes on"] if k % 3 == 0 else [str(pick.random()) for _ in range(9)]) for _ in range(4000 + 997 * (k % 11)))) for k in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).cache()
    assert sum(len(t) for _, t in rows) > 8 << 20
    kept = {r.doc_id for r in repetition(docs).filter("kept").collect()}
    assert {r.doc_id for r in passing(docs).collect()} == kept and 0 < len(kept) < 180


def test_contamination(spark, odd_docs, odd_rows):
    texts = dict(r for r in odd_rows if r[1])
    items = [(1, texts[10][5:200]), (2, "nothing here is in any of the texts at all, is it"), (3, None), (4, ""), (5, "WORD"), (5, "one TWO"), (None, texts[60][:90]),
             (30, " ".join(texts[92].split(" ")[500:540]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i), *brute.contaminated(t, items)) for i, t in odd_rows)
    for most in (8 << 20, 100):  # one block, and many
        got = contamination(odd_docs, bench, most=most).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in got) == want
    left = clean(odd_docs, bench, most=100)
    assert left.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(x[0] for x in want if not x[2])
    assert contamination(odd_docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert contamination(odd_docs.limit(0), bench).count() == 0


def test_best_fit_is_the_plain_one():
    for seed in range(150):
        pick = random.Random(seed)
        length = pick.choice([16, 33, 64])
        counts = {s: pick.randrange(0, 12) for s in range(1, length)}
        plan, made = best_fit(counts, length)
        rooms = []
        for s in sorted(counts, reverse=True):
            for _ in range(counts[s]):
                at = min((k for k in range(len(rooms)) if rooms[k] >= s), key=lambda k: rooms[k], default=None)
                if at is None:
                    rooms.append(length - s)
                else:
                    rooms[at] -= s
        used = {}
        for size, _, many, first, each, base in plan:
            for k in range(many):
                used.setdefault(first + k // each, []).append((base + k % each * size, size))
        for pieces in used.values():
            at = 0
            for begin, size in sorted(pieces):
                assert begin == at
                at += size
        assert sorted(length - sum(s for _, s in x) for x in used.values()) == sorted(rooms) and made == len(rooms)


def test_packing(spark, odd_docs, odd_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    for docs, rows in ((odd_docs, odd_rows), (odd_docs.limit(0), [])):
        got = pack(docs, WORDS, length=256, with_ids=True).collect()
        want = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows)
        by = {}
        for r in got:
            assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for pieces in by.values():
            at = 0
            for begin, n in sorted(pieces):
                assert begin == at
                at += n
            assert at <= 256
        singles = {}
        for r in got:
            singles.setdefault(str(r.doc_id), []).append(r)
        for name, pieces in singles.items():
            own = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows if str(i) == name)
            if len(own) == 1:
                assert sum((list(r.ids) for r in sorted(pieces, key=lambda r: r.start)), []) == own[0]
        assert sum(r.length for r in got) == sum(map(len, want))


def test_token_counts(odd_docs, odd_rows):
    from tokenizers import Tokenizer, models

    scores = lattice.public_pieces(PIECES)
    plain = Tokenizer(models.Unigram([("<unk>", 0.0), *scores.items()], unk_id=0, byte_fallback=True))
    got = count_tokens(odd_docs, PIECES).collect()
    want = sorted((str(i), len(brute.words(t)), sum(len(plain.encode(lattice.MARK + w).ids) for w in brute.words(t))) for i, t in odd_rows)
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == want
    assert count_tokens(odd_docs.limit(0), PIECES).count() == 0


SMALL = {"a": 0.2, "b": 0.1, "ab": 0.2, "▁a": 0.2, "▁": 0.1, "ba": 0.1, "<0xC3>": 0.05, "<0xA9>": 0.05}


def _segmentations(word):
    if not word:
        yield []
        return
    for k in range(1, len(word) + 1):
        if word[:k] in SMALL:
            for rest in _segmentations(word[k:]):
                yield [word[:k], *rest]
    if word[0] == "é":
        for rest in _segmentations(word[1:]):
            yield ["<0xC3>", "<0xA9>", *rest]


def test_lattice_sums_all_segmentations():
    words = sorted({"".join(random.Random(k).choices("abé", k=1 + k % 7)) for k in range(60)})
    pieces = lattice.Pieces({p: math.log(x) for p, x in SMALL.items()})
    expected = {}
    for word, total in zip(words, lattice.log_totals(pieces, words)):
        ways = [(s, math.prod(SMALL[p] for p in s)) for s in _segmentations("▁" + word)]
        mass = sum(x for _, x in ways)
        assert math.isclose(math.log(mass), total, abs_tol=1e-9)
        for s, x in ways:
            for p in s:
                expected[p] = expected.get(p, 0) + x / mass
    got = lattice.expected_counts(pieces, words)
    assert set(got) == set(expected) and all(math.isclose(got[p], expected[p], abs_tol=1e-9) for p in got)


def test_likelihood(odd_docs, odd_rows):
    got = score_texts(odd_docs, PIECES).collect()
    assert len(got) == len(odd_rows)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = [(i, [*brute.words(low(t)), None]) for i, t in odd_rows]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    counts = {}
    for i, ws in tokens:
        for w in ws:
            counts[w] = counts.get(w, 0) + (not held(i))
    seen = {w: n for w, n in counts.items() if n}
    total, kinds = sum(seen.values()), len(seen)
    want = sorted((str(i), held(i), len(ws), sum(w in seen for w in ws), total, round(sum(math.log10((seen.get(w, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws), 4))
                  for i, ws in tokens)
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert score_texts(odd_docs.limit(0), PIECES).count() == 0


def test_likelihood_is_a_distribution_and_learns(spark):
    pick = random.Random(1)
    vocabulary = ["".join(pick.choices(["the", "on", "er", "ing", "ha"], k=pick.randrange(1, 4))) for _ in range(60)]
    docs = [(k, " ".join(pick.choices(vocabulary, k=50))) for k in range(200)] + [(1000 + k, " ".join("".join(pick.choices("qzxwkv", k=6)) for _ in range(50))) for k in range(20)]
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame(docs, "doc_id long, text string"), PIECES).collect()}
    known = [r.score / r.n_tokens for i, r in got.items() if i < 1000 and r.held_out]
    strange = [r.score / r.n_tokens for i, r in got.items() if i >= 1000 and r.held_out]
    assert max(strange) < min(known) - 2


def test_languages(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert len(rows) == docs.count() and sum(held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_texts(spark, odd_docs, odd_rows):
    got = {str(r.doc_id): r for r in languages(odd_docs).collect()}
    assert {got[k].lang_pred for k in "1 2 3 8".split()} == {"und"} and got["4"].lang_pred == "en"
    none = languages(spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in none} == {"und"} and languages(odd_docs.limit(0)).count() == 0


def test_codes_differ_in_many_bits():
    for n in (2, 4, 6, 9, 40):
        codes = codewords(n)
        apart = min((codes[a] != codes[b]).sum() for a in range(n) for b in range(a))
        assert apart >= (1 if n == 2 else codes.shape[1] // 4)
    model = Classifiers(["a", "b"], np.array([[9.0] + [0.0] * 65535, [0.0, 9.0] + [0.0] * 65534]))
    best, share, close = model.decode(np.array([[0.0]]))
    assert close[0] and abs(share[0] - 0.5) < 1e-9


def test_packing_needs_the_stated_tokenizer():
    with pytest.raises(Exception):  # noqa: B017
        from slopewise.llm.tokens import word_ids

        word_ids("/nowhere.json")
