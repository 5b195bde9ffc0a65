"""One long labelled text neither ends nor empties the sample that op8's dictionaries are trained on."""

import random

import pytest
import zstandard
from pyspark.sql import functions as F

from arcwright.llm import zstd_quality


@pytest.mark.parametrize("long", [1_500_000, 990_000])
def test_long_text(spark, monkeypatch, long):
    draw = random.Random(1)
    text = lambda words, n: " ".join(draw.choices(words, k=n))
    good, bad = (["".join(draw.choices("abcdefghijklmnop" if k else "ghijklmnopqrstuv", k=7)) for _ in range(500)] for k in (0, 1))
    # The long text comes first in its class.
    first = spark.range(40).orderBy(F.xxhash64("id", F.lit("part")), "id").first().id
    rows = [(k, text(good, long // 8 if k == first else 625)) for k in range(40)] + [(k, text(bad, 625)) for k in range(40, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(80)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(zstandard, "train_dictionary", lambda size, parts, f=zstandard.train_dictionary: (seen.append(parts), f(size, parts))[1])
    model = zstd_quality.fit(docs, labels, sample_mb=1)
    assert model.weights
    assert [len(parts) for parts in seen] == [24, 24]
    assert all(sum(map(len, parts)) <= 1 << 20 for parts in seen)
    scores = model.scores([text(good, 300), text(bad, 300)])
    assert scores[0] > 0.5 > scores[1]
