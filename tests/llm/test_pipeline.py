"""Each stage keeps what its operator's judgement says, on the rows of the stage before."""

import corpus_pipeline as C

from arcwright.llm import near_duplicates, quality_rules, toxicity
from arcwright.llm.common import spool, table

DIR = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark):
    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    good = spool(C.quality(spark, docs, DIR), "good")
    assert good.columns == docs.columns
    assert ids(good) == ids(quality_rules.judge(docs, labels).where("kept"))
    clean = spool(C.clean(spark, good, DIR), "clean")
    assert ids(clean) == ids(toxicity.score(good, toxicity.fit(good, labels)).where("score < 0.7"))
    once = spool(C.once(spark, clean, DIR), "once")
    assert once.columns == docs.columns
    assert ids(once) == ids(near_duplicates.classes(clean).where("kept"))
    pieces = C.packed(spark, once, DIR)
    assert sorted({r.doc_id for r in pieces.collect()}) == ids(once)

