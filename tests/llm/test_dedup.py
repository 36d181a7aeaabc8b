"""Near-duplicate documents and lines against all pairs."""

import random

import brute
from pyspark.sql import functions as F

from slopewise.llm import links, spans
from slopewise.llm.lines import dedup_lines, line_classes
from slopewise.llm.near import near_classes, one_of_each, register_prints
from slopewise.llm.scratch import Scratch


def test_near_classes_are_those_of_all_pairs(odd_docs, odd_rows):
    got = near_classes(odd_docs).collect()
    assert len(got) == len(odd_rows) and sum(r.kept for r in got) == len(brute.near(odd_rows))
    want = sorted(sorted(str(odd_rows[k][0]) for k in c) for c in brute.near(odd_rows))
    by = {}
    for r in got:
        by.setdefault((str(r.class_id), r.copies), []).append(str(r.doc_id))
    assert sorted(map(sorted, by.values())) == want
    assert all(len(v) % k[1] == 0 for k, v in by.items())


def test_one_of_each_keeps_columns_and_one_row_a_class(odd_docs, odd_rows):
    got = one_of_each(odd_docs)
    assert got.columns == odd_docs.columns
    kept = [r.row for r in got.collect()]
    classes = brute.near(odd_rows)
    assert sorted(next(k for k, c in enumerate(classes) if x in c) for x in kept) == list(range(len(classes)))


def test_line_classes_are_those_of_all_pairs(odd_docs, odd_rows):
    got = line_classes(odd_docs).collect()
    assert len(got) == sum(t.count("\n") + 1 for _, t in odd_rows if t is not None)
    classes = brute.line_places(odd_rows)
    assert sum(r.kept for r in got if r.class_line is not None) == len(classes)
    want = sorted(sorted(f"{odd_rows[k][0]}:{n}" for k, n in c) for c in classes)
    by = {}
    for r in got:
        if r.class_line is not None:
            by.setdefault((str(r.class_doc), r.class_line), []).append(f"{r.doc_id}:{r.line_no}")
        else:
            assert r.kept
    assert sorted(map(sorted, by.values())) == want


def test_dedup_lines_keeps_the_first_line_of_each_class(odd_docs, odd_rows):
    got = dedup_lines(odd_docs)
    assert got.columns == odd_docs.columns
    rows = got.collect()
    left = [x for r in rows for x in (r.text or "").split("\n") if x.strip()]
    assert len(left) == len(brute.line_places(odd_rows))
    assert {r.doc_id for r in rows} >= {1, 2, 3, 4, 8} and sum(r.doc_id == 6 for r in rows) == 1
    again = line_classes(got).filter("not kept").count()
    assert again == 0


def test_empty_tables(odd_docs):
    none = odd_docs.limit(0)
    assert near_classes(none).count() == 0 and line_classes(none).count() == 0
    assert one_of_each(none).count() == 0 and dedup_lines(none).columns == odd_docs.columns


def test_hot_bucket_of_a_chain_is_one_class_without_all_pairs(spark):
    """Two hundred sets in one bucket, each like its neighbours only."""
    n, pairs = 200, []
    sets = {k: set(range(k, k + 20)) for k in range(n)}
    members = spark.range(n).select(F.lit(1).cast("long").alias("bucket"), "id")
    rows = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "id long, s array<long>").cache()

    def verify(found):
        out = found.join(rows.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(rows.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        pairs.append(out.count())
        return out.filter("size(array_intersect(sa, sb)) >= 0.8 * size(array_union(sa, sb))")

    got = links.classes(Scratch(spark), members, verify, lambda ids: rows.join(ids, "id").select("id", F.explode("s").alias("element")), 0.8)
    assert {r.root for r in got.collect()} == {0} and got.count() == n
    assert sum(pairs) < n * n / 2


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 9), (20, 21), (21, 22), (22, 20), (9, 100)]
    got = {r.id: r.root for r in links.components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 100: 1, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20}


def test_registers_agree_as_often_as_weighted_sets_are_alike():
    import numpy as np

    rng = np.random.default_rng(3)
    hits, wanted = [], []
    for _ in range(40):
        common, a, b = (rng.integers(1, 2**63, n).astype(np.uint64) for n in (80, 10, 10))
        prints, row = np.concatenate([common, a, common, b]), np.repeat([0, 1], 90)
        first = register_prints(prints, row, 2, 64)
        hits.append((first[0] == first[1]).mean())
        wanted.append(80 / 100)
    assert abs(np.mean(hits) - np.mean(wanted)) < 0.03


def test_fingerprints_and_words():
    import pyarrow as pa

    texts = spans.Texts(pa.array(["aa b", None, "b\taa", ""]))
    begin, end, row = texts.words(~spans.SPACE)
    prints = texts.prints(begin, end)
    assert row.tolist() == [0, 0, 2, 2] and prints[0] == prints[3] and prints[1] == prints[2] and prints[0] != prints[1]


def test_lines_that_repeat_a_phrase_are_copies_of_lines_that_have_it_once_more(spark):
    """Their sets of shingles are alike or equal, however often each shingle is there."""
    import random

    pick = random.Random(11)
    phrase = lambda: " ".join("".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(pick.randrange(2, 9))) for _ in range(12)) + ". "
    phrases = [phrase() for _ in range(60)]
    lines = [["Buy now! " * 2, "Buy now! " * 3], *([p * k, p * (k + 1)] for k in (1, 2, 3) for p in phrases[20 * k - 20 : 20 * k])]
    rows = [(2 * k + n, line) for k, pair in enumerate(lines) for n, line in enumerate(pair)]
    got = {r.doc_id: r.class_doc for r in line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    root = brute.joined([t for _, t in rows], {t: brute.runs(t, 8) for _, t in rows}, 0.8)
    copies = [k for k in range(len(lines)) if root[lines[k][0]] == root[lines[k][1]]]
    assert len(copies) > 40 and [k for k in copies if got[2 * k + 1] != 2 * k] == []


def test_no_pair_of_short_lines_is_missed(spark):
    import random

    pick = random.Random(12)
    text = lambda n: "".join(pick.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    pairs = [(x := text(n), x + text(more)) for n, more in ((11, 1), (12, 1), (13, 1), (15, 2), (16, 1), (17, 2), (19, 2)) for _ in range(150)]
    pairs = [p for p in pairs if brute.jaccard(*(brute.runs(x, 8) for x in p)) >= 0.8]
    rows = [(2 * k + n, line) for k, p in enumerate(pairs) for n, line in enumerate(p)]
    got = {r.doc_id: r.class_doc for r in line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 900 and [p for k, p in enumerate(pairs) if got[2 * k + 1] != got[2 * k]] == []


def test_numbers_of_removed_lines_count_towards_a_broadcast(spark, monkeypatch):
    """Two documents that lose a thousand lines each are two rows, but two thousand numbers."""
    from slopewise.llm import lines, scratch

    text = "\n".join(f"line number {k} of a long document" * 2 for k in range(1000))
    rows = [(1, text), (2, "a first line of its own\n" + text), (3, "another line, of the third document\n" + text)]
    marked = []

    def watched(df, most=500, **options):
        out = scratch.sized(df, most, **options)
        if "_gone" in df.columns:
            marked.append("broadcast" in out._jdf.queryExecution().analyzed().toString())
        return out

    monkeypatch.setattr(lines, "sized", watched)
    before = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert marked == [False] and before[2] == rows[1][1].split("\n")[0] and before[3] == rows[2][1].split("\n")[0]


def families(pick):
    """Pairs whose shingle sets are alike (at least 0.8) although one text repeats a passage and the other does not."""
    word = lambda: f"w{pick.randrange(10**6)}"
    run = lambda n: [word() for _ in range(n)]
    for k in range(120):
        base, passage = run(150), run(50)
        yield "once against fifty times", base + passage, base + passage * 50
        base, passage = run(100), run(100)
        yield "ten words more", base + passage * 20, base + passage * 20 + run(10)
        base = run(200)
        at = pick.randrange(180)
        yield "no repeats", base, base[:at] + run(4) + base[at + 4 :]


def test_recall_of_near_copies_that_repeat_passages(spark):
    rows, kinds = [], {}
    for k, (kind, a, b) in enumerate(families(random.Random(8))):
        if brute.jaccard(brute.runs(a, 5), brute.runs(b, 5)) >= 0.8:
            rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
            kinds[2 * k] = kind
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for kind in set(kinds.values()):
        own = [k for k, x in kinds.items() if x == kind]
        assert len(own) > 100 and sum(got[k] == got[k + 1] for k in own) >= 0.99 * len(own), kind


def test_many_rows_in_a_batch(spark):
    """More rows than a row's number has room for: cut into several blocks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    try:
        table = spark.range(0, 70_000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id") % 69_000, *[F.concat(F.lit(x), F.col("id") % 69_000) for x in "abcdef"]).alias("text"))
        got = near_classes(table).groupBy("copies").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.copies: r["count"] for r in got} == {1: 68_000, 2: 2_000}
