"""Quality by compression: which of two dictionaries shortens a text more.

Labelled good and bad texts give a zstandard dictionary each.  A text is compressed with either one; the
difference of the two sizes, as a share of their sum, tells which kind of text it resembles, and a logistic
fit on labelled texts that weren't used for the dictionaries turns it into a score.

Bounded: the labelled sample (``rows``) and each dictionary's training texts (``texts`` texts, at most
``sample_mb`` of them; of a text longer than the dictionary, its first ``dictionary_kb``, so that no single text
uses up the sample), all parameters.  Every document is compressed whole.

Defined results: null and empty texts have the difference 0 (their score is the fit's at 0); ties and repeated
rows score alike; a single labelled text of a kind makes both the dictionary and the fit; without labels of both
kinds the score is 1 everywhere (nothing is known to be bad); extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import slices
from .common import arrow_batches, fold
from .labelled import sample
from .toxicity import logistic


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    level: int = 3
    weights: tuple[float, ...] = ()

    def sizes(self, texts: list[str | None]) -> np.ndarray:
        """Compressed sizes with the good and the bad dictionary, and plain sizes."""
        import zstandard

        coders = []
        for data in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(data)
            held.precompute_compress(level=self.level)
            coders.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        raw = [(t or "").encode() for t in texts]
        return np.array([[len(coders[0].compress(r)), len(coders[1].compress(r)), len(r)] for r in raw], float).reshape(-1, 3)

    @staticmethod
    def inputs(sizes: np.ndarray) -> np.ndarray:
        good, bad, plain = sizes.T
        diff = np.where(plain > 0, (bad - good) / np.maximum(good + bad, 1), 0.0)
        return np.column_stack([diff * 20, diff * np.log1p(plain)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.weights:
            return np.ones(len(texts))
        x = self.inputs(self.sizes(texts))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 0, held_out: int = -1, rows: int = 12_000, texts: int = 1500, sample_mb: int = 8, dictionary_kb: int = 256, level: int = 3) -> Model:
    import zstandard

    held = sample(docs, labels, "quality", folds=folds, held_out=held_out, rows=rows)
    part = min(dictionary_kb << 10, sample_mb << 20)
    held = held.withColumn("draw", F.xxhash64("doc_id", F.lit("part"))).withColumn("name", F.xxhash64("doc_id", "text"))
    counts = {r["label"]: r["count"] for r in held.groupBy("label").count().collect()}  # one row a label
    if not counts.get(0) or not counts.get(1):
        return Model(level=level)
    names: list[int] = []
    for y in (0, 1):
        # The first texts of each kind by hash, without their texts: at most ``texts`` rows, found by a bounded heap in each task.
        most = max(1, min(texts, int(counts[y] * 0.6)))
        first = held.where(F.col("label") == y).select("name", F.least(F.octet_length("text"), F.lit(part)).alias("size"), "draw", "doc_id")
        room = sample_mb << 20
        for r in first.orderBy("draw", "doc_id", "name").limit(most).collect():
            if r["size"] <= room:
                room -= r["size"]
                names.append(r["name"])
    first = F.col("name").isin(names)
    chosen = held.where(first).select("draw", "doc_id", "name", "label", F.substring(F.col("text").cast("binary"), 1, part).alias("part")).collect()
    # In the order of the draw: what a dictionary becomes depends on the order of its texts.
    chosen.sort(key=lambda r: (r["draw"], r["doc_id"], r["name"]))
    kinds = {y: [bytes(r["part"]) for r in chosen if r["label"] == y] for y in (0, 1)}
    # The only text of its kind serves for the dictionary and for the fit.
    lonely = [y for y in (0, 1) if counts[y] == len(kinds[y])]

    def dictionary(parts: list[bytes]) -> bytes:
        size = dictionary_kb << 10
        try:
            return zstandard.train_dictionary(size, parts).as_bytes()
        except zstandard.ZstdError:  # too few texts to train on: their own bytes serve as the dictionary
            return b"".join(parts)[-size:] or b"\0" * 8

    model = Model(dictionary(kinds[1]), dictionary(kinds[0]), level)
    arrow_batches(docs.sparkSession)

    def measured(batches):
        for b in slices(batches):
            sizes = model.sizes(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("label"), *[pa.array(c) for c in sizes.T]], names=["label", "good", "bad", "plain"])

    seen = held.where(~first | F.col("label").isin(lonely)).select("label", "text").mapInArrow(measured, "label int, good double, bad double, plain double").collect()  # at most ``rows``
    y = np.array([r["label"] for r in seen], float)
    x = model.inputs(np.array([[r["good"], r["bad"], r["plain"]] for r in seen]))
    model.weights = tuple(map(float, logistic(x, y)))
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every document."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(b.column("text").to_pylist()))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model that never saw the held-out fold's labels."""
    out = score(docs, fit(docs, labels, folds=folds, held_out=held_out))
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
