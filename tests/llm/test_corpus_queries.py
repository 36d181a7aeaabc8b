"""Registered corpus queries against SQL, and the pipeline's stages against brute force."""

import brute
import duckdb
import pytest

import corpus_pipeline
from slopewise.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    rel = con.execute(ORACLES[name])
    names = [c[0] for c in rel.description]
    want = sorted(rel.fetchall(), key=repr)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == want


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted((r.doc_id, r.text) for r in docs.collect())
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == {i for i, _ in before}
            continue
        assert docs.columns == columns
        after = sorted((r.doc_id, r.text) for r in docs.collect())
        if name == "quality_rules":
            assert after == [r for r in before if brute.repetition(r[1])[-1]]
        elif name == "line_dedup":
            gone = {p for c in brute.line_places(before) for p in c[1:]}
            want = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if (j, n) not in gone)) for j, (i, t) in enumerate(before)]
            assert after == [r for r in want if r[1].strip()]
        elif name == "near_dedup":
            assert after == sorted(before[c[0]] for c in brute.near(before))
        else:
            assert after == [r for r in before if not brute.contaminated(r[1], items)[1]]


def test_run_returns_packed_pieces(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns) and got.count() > 0


def test_pipeline_returns_the_ids_of_its_sequences(spark):
    from tokenizers import Tokenizer

    from slopewise.llm.queries import tokenizer_path

    texts = ["some words here", "", None, "word " * 5000, *(f"text {k} " * (k + 1) for k in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer, by = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), {}
    for r in sorted(corpus_pipeline.packing(spark, docs, "").collect(), key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == r.length <= 2048
        by.setdefault(r.doc_id, []).extend(r.ids)
    assert by == {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, None), (3, " \n "), (4, "word " * 3)], [(5, "some text here " * 30), (5, "some text here " * 30), (None, "x y z " * 40)]])
def test_run_on_few_and_odd_rows(spark, tmp_path, rows):
    """Nulls, empties, repeated rows and no rows at all; documents without n_chars and with columns of clashing names."""
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, class string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("i", None), ("j", "word word")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        assert got.count() <= len(rows)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= len(rows)
