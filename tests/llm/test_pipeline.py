import os

import pytest

import corpus_pipeline
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name == "near_dedup":
            want = brute.classes([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in seen[name]) == sorted(set(want.values()))
        if name == "pii":
            assert {r.doc_id for r in seen[name]} == {r.doc_id for r in seen["near_dedup"]} and all(r.n_chars == len(r.text) for r in seen[name])
    assert len({(r.sequence_id, r.offset) for r in seen["pack"]}) == len(seen["pack"])
    assert {r.doc_id for r in seen["pack"]} == {r.doc_id for r in seen["mix"]}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("empty", [False, True])
def test_stages_of_odd_rows(spark, tmp_path, empty):
    """Nulls in any column, empty and long texts, repeated rows and ids, clashing columns, and an empty table."""
    long = " ".join(f"w{i % 997}" for i in range(20_000))
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (1, "another text of doc one", None, "s", None), (None, "x y z", "en", None, 5), (2, None, "en", "s", 0), (3, "", "en", "t", 0), (5, long, "en", "t", len(long)), (6, long + " end", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame([] if empty else [(*r, "clash", "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, shard string")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert i == 4 or out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
    if empty:
        assert kept == [0] * 5
    else:
        # no row is toxic; two texts of doc 1, x y z, one of the empty ones and one of the long ones stay
        assert kept[:3] == [9, 5, 5] and kept[3] > 0 and kept[4] >= kept[3]


def test_names():
    import __spark_entry__ as e

    q = e.queries()
    assert all(any(n.startswith(f"op{i}_") for n in q) for i in range(1, 11)) and "pipeline" in q
    assert set(e.oracle_sql()) <= set(q)
