"""The pipeline on awkward rows: each stage's defined result."""

import corpus_pipeline as C
import pytest

GOOD = "The river runs slowly past the old mill and the children play along its green banks until the evening bell. "
LONG = " ".join(f"{w}{k}" for k in range(4000) for w in ("stone", "river", "field", "light"))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows"))
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, GOOD), (3, GOOD), (4, GOOD), (5, LONG), (6, LONG + " end"), (None, GOOD.upper() + "and more of it than before"), (7, "word " * 50)]
    spark.createDataFrame([(i, t, "s", 1, "k") for i, t in rows], "doc_id long, text string, source string, kept int, rule string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (7, 0, 0), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == ["doc_id", "text", "source", "kept", "rule"], name
        if name == "quality_rules":
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["3", "3", "4", "5", "6", "None"]
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["3", "5", "None"]
    found = C.run(spark, tables).collect()
    assert {r.doc_id for r in found} == {3, 5, None}
    assert sum(r.length for r in found if r.doc_id == 5) == next(r.doc_tokens for r in found if r.doc_id == 5)


def test_empty(spark, tables, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
