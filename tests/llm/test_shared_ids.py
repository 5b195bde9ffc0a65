"""Rows that share an id are one document of the near-duplicate stage, of which one row stays."""

from arcwright.llm import near_duplicates

A, B, C = ("".join(f"{x}{k} " for k in range(40)) for x in "abc")
SCHEMA = "doc_id long, text string, source string"


def kept(spark, rows):
    return sorted(((r.doc_id, r.text) for r in near_duplicates.keep_first(spark.createDataFrame([(*r, "s") for r in rows], SCHEMA)).collect()), key=str)


def test_tied_ids(spark):
    rows = [(5, A), (5, B), (3, B), (9, A), (20, C), (20, ""), (12, ""), (30, C)]
    found = near_duplicates.classes(spark.createDataFrame([(*r, "s") for r in rows], SCHEMA)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(3, 3), (5, 3), (9, 3), (12, 12), (20, 20), (30, 20)}
    assert kept(spark, rows) == [(12, ""), (20, C), (3, B)]


def test_tied_to_a_wordless_row(spark):
    assert kept(spark, [(5, ""), (5, A), (3, A)]) == [(3, A)]


def test_repeated_rows(spark):
    assert kept(spark, [(1, A)] * 3 + [(2, A), (4, B), (None, C), (None, C)]) == [(1, A), (4, B), (None, C), (None, C)]
