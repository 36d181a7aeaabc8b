"""Repeated passages against a plain count of all windows."""

import hashlib
import random
from collections import Counter

import brute
import numpy as np
import pytest

from slopewise.llm import phrases as ph


def expected(rows, window):
    texts = [brute.words(t) for _, t in rows]
    times = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = {j for k in range(len(w) - window + 1) if times[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    pick = random.Random(11)
    word = lambda: pick.choice("alpha beta gamma delta x épée 日本 🙂 to of".split()) + str(pick.randrange(400))
    run = lambda n: [word() for _ in range(n)]
    common, other = run(60), run(36)
    rows = [(None, None), (1, ""), (2, " \n"), (3, " ".join(run(34))), (3, " ".join(run(34)))]
    for k in range(60):
        rows.append((10 + k, "  ".join(run(pick.randrange(50))) + "\n\t" + " ".join(common[pick.randrange(20) :]) + " " + "\x0b".join(run(pick.randrange(40)))))
    for k in range(8):
        rows.append((100 + k, " ".join(run(pick.randrange(9)) + other + run(9) + other[:35])))
    near = run(300)
    for k in range(12):
        w = list(near)
        w[pick.randrange(300)] = word()
        rows.append((200 + k, " ".join(w)))
    rows += [(300 + k % 5, " ".join(near[:200])) for k in range(15)]
    rows += [(400, "same " * 700), (401, "a b c " * 90), (402, "a b c d " * 12), (403, "x" * 200_000 + " tail"), (404, " ".join(run(40))), (405, "same " * 700 + "end")]
    return rows


@pytest.mark.parametrize("window, anchor, hot", [(35, 12, 4096), (35, 12, 3), (8, 3, 5), (6, 6, 100), (5, 1, 2)])
def test_every_repeated_window_is_removed(spark, window, anchor, hot):
    rows = corpus()
    table = spark.createDataFrame([(*r, 1, b"p") for r in rows], "doc_id long, text string, n int, print binary").repartition(5)
    got = ph.repeated_passages(table, window=window, anchor=anchor, hot=hot, shard_bytes=4000, with_text=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == expected(rows, window)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_odd_rows_and_empty_table(spark, odd_docs, odd_rows):
    got = ph.repeated_passages(odd_docs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(odd_rows, 35)
    assert ph.repeated_passages(odd_docs.limit(0)).count() == 0


def test_sliding_and_run_prints():
    values = np.random.default_rng(1).integers(0, 1 << 60, 200).astype(np.uint64)
    for n in (1, 2, 3, 7, 24):
        assert (ph._sliding(values, n, np.minimum) == [values[i : i + n].min() for i in range(201 - n)]).all()
        runs = ph._run_prints(np.concatenate([values, values]), n)
        assert (runs[: 200 - n] == runs[200 : 400 - n]).all() and len(runs) == 401 - n
