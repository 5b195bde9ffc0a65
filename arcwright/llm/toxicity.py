"""Toxic passages as maximum-scoring segments.

Labelled documents give each token (a word, or the first four or five letters of longer ones) a log-odds with
an informative Dirichlet prior: the background frequency of the token, as so large a share of the labelled
documents, is added to either class.  Tokens with a significant excess score their log-odds, every other token a small constant drop.  The
linear-time all-maximal-segments scan then finds each passage whose total can't be raised by lengthening or
shortening it.  Totals are compared across texts of any length by extreme-value statistics: with lambda from
the score distribution of clean text and K from its observed tail, a passage of total S in a text of n tokens
has the expected number of equals K n exp(-lambda S).  A document's evidence sums the significant passages'
minus log expectations; a logistic fit on the labelled sample turns it into a score.

Where clean text's scores have no positive root, lambda is ``lam_else``; it is at most ``lam_most``, as few hits in
little clean text would make it as large as one likes.  The log-odds of tokens without significant excess aren't told
apart from 0 by the sample; the drop stands for all of them.

Bounded: the labelled sample (``rows``) and the lexicon (``terms``), both parameters.  All else covers all data.

Defined results: null or empty texts have no passage and get the score of no evidence; ties and repeated rows
score alike; a table without labels of both kinds gives the score 0 everywhere; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import slices
from .common import arrow_batches, fold
from .labelled import sample

WORD = re.compile(r"[^\W\d_]+")
#: Letters of the beginnings that stand for inflected and compound forms.
HEADS = (4, 5)


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features(words: set[str]) -> set[str]:
    return words | {f"^{w[:n]}" for w in words for n in HEADS if len(w) > n}


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    drop: float = 0.25
    lam: float = 1.0
    k: float = 1.0
    intercept: float = -math.inf
    slope: float = 0.0
    heads: set[str] = field(default_factory=set)

    def weight(self, word: str) -> float:
        get = self.terms.get
        return max(get(word, 0.0), *(get(f"^{word[:n]}", 0.0) if len(word) > n else 0.0 for n in HEADS))

    def passages(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(first token, end token, total) of every maximal segment of positive total."""
        heads, n = self.heads, HEADS[0]
        hits = [(at, s) for at, w in enumerate(words) if w[:n] in heads and (s := self.weight(w)) > 0]
        return maximal_segments(hits, self.drop)

    def expected(self, total: float, n: int) -> float:
        return self.k * max(n, 1) * math.exp(-min(700.0, self.lam * total))

    def evidence(self, words: list[str], level: float = 0.05) -> tuple[float, int, float]:
        """Sum of minus log expectations over significant passages, their number, and the best total."""
        found = self.passages(words)
        bits = [-math.log(max(e, 1e-300)) for _, _, s in found if (e := self.expected(s, len(words))) < level]
        return sum(bits), len(bits), max((s for _, _, s in found), default=0.0)

    def score(self, evidence: float) -> float:
        x = self.intercept + self.slope * math.log1p(evidence) if self.slope else self.intercept
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def maximal_segments(hits: list[tuple[int, float]], drop: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence whose tokens score ``hits``' values, and minus ``drop`` elsewhere.

    Candidates lie on a stack with the running totals before and after each; a new one is joined to the latest
    candidate that starts lower, if that one also ends lower.  Each step removes or adds one candidate.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, total before, total after, latest candidate that starts lower
    running, seen = 0.0, 0
    for at, s in hits:
        before = running - drop * (at - seen)
        running, seen = before + s, at + 1
        first, low, high = at, before, running
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                break
            first, low = stack[j][0], stack[j][2]
            link = stack[j][4]
            del stack[j:]
            j = link
        stack.append((first, at + 1, low, high, j))
    return [(a, z, high - low) for a, z, low, high, _ in stack]


def _solve_lambda(scores: Counter, otherwise: float) -> float:
    """The positive root of E[exp(lambda s)] = 1 for clean text's token scores, whose mean is negative."""
    s, n = np.array(list(scores)), np.array(list(scores.values()), float)
    if not (s > 0).any() or (s * n).sum() >= 0:
        return otherwise
    lo, hi = 1e-6, 50.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (n * np.exp(np.minimum(mid * s, 700))).sum() > n.sum() else (mid, hi)
    return lo


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a ridge logistic regression, the intercept first and free."""
    X = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(X.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (X.shape[1] - 1)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -35, 35)))
        step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + penalty, X.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 0, held_out: int = -1, rows: int = 20_000, terms: int = 20_000, prior: float = 0.25, level: float = 0.01, least_docs: int = 5, least_odds: float = 1.0, drop: float = 0.25, lam_else: float = 2.0, lam_most: float = 5.0) -> Model:
    spark = docs.sparkSession
    arrow_batches(spark)
    held = sample(docs, labels, "toxic", folds=folds, held_out=held_out, rows=rows)

    def count(batches):
        seen: Counter = Counter()
        for b in slices(batches):
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                found = features(set(tokens(text)))
                seen.update((f, label) for f in found)
                seen["", label] += 1
        keys = list(seen)
        for a in range(0, len(keys), 50_000):
            part = keys[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([y for _, y in part], pa.int32()), pa.array([seen[k] for k in part], pa.int64())], names=["term", "label", "n"])

    counts = held.mapInArrow(count, "term string, label int, n long").groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") != 1, F.col("n")).otherwise(0)).alias("good"))
    counts = counts.where((F.col("bad") >= least_docs) | (F.col("term") == ""))
    total = counts.where(F.col("term") == "").first()
    model = Model(drop=drop)
    if total is None or not total["bad"] or not total["good"]:
        return model
    nb, ng = total["bad"], total["good"]
    # The prior weighs a share of the labelled documents, and a term's excess must stand out among all terms tried,
    # so that selection means the same for few labels as for many.
    prior *= nb + ng
    least_z = NormalDist().inv_cdf(1 - level / max(1, counts.count() - 1))
    alpha = prior * (F.col("bad") + F.col("good")) / (nb + ng)
    odds = F.log((F.col("bad") + alpha) / (nb + prior - F.col("bad") - alpha)) - F.log((F.col("good") + alpha) / (ng + prior - F.col("good") - alpha))
    z = odds / F.sqrt(1 / (F.col("bad") + alpha) + 1 / (F.col("good") + alpha))
    best = counts.where("term <> ''").select("term", odds.alias("odds"), z.alias("z")).where((F.col("z") >= least_z) & (F.col("odds") >= least_odds)).orderBy(F.desc("z"), "term").limit(terms)
    model.terms = {r["term"]: r["odds"] for r in best.collect()}
    model.heads = {t.removeprefix("^")[: HEADS[0]] for t in model.terms}

    def scored(batches):
        for b in slices(batches):
            out = []
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                words = tokens(text)
                hits = [s for w in words if w[: HEADS[0]] in model.heads and (s := model.weight(w)) > 0]
                out.append((label, len(words), hits, [s for _, _, s in model.passages(words)]))
            yield pa.RecordBatch.from_pylist([dict(zip(("label", "n", "hits", "totals"), r, strict=True)) for r in out], schema=pa.schema([("label", pa.int32()), ("n", pa.int64()), ("hits", pa.list_(pa.float64())), ("totals", pa.list_(pa.float64()))]))

    rows_of = held.mapInArrow(scored, "label int, n long, hits array<double>, totals array<double>").collect()  # at most ``rows``
    clean = [r for r in rows_of if r["label"] != 1]
    scores = Counter(round(s, 1) for r in clean for s in r["hits"])
    scores[-drop] += max(1, sum(r["n"] for r in clean) - scores.total())
    model.lam = min(lam_most, _solve_lambda(scores, lam_else))
    floor = min(model.terms.values(), default=1.0)
    over = sum(s >= floor for r in clean for s in r["totals"])
    model.k = max(over, 0.5) / max(1.0, sum(r["n"] for r in clean) * math.exp(-model.lam * floor))
    x, y = [], []
    for r in rows_of:
        x.append(math.log1p(sum(-math.log(max(e, 1e-300)) for s in r["totals"] if (e := model.expected(s, r["n"])) < 0.05)))
        y.append(float(r["label"] == 1))
    model.intercept, model.slope = map(float, logistic(np.array(x)[:, None], np.array(y)))
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_passages, best_total and the significant passages' token spans of every document."""
    arrow_batches(docs.sparkSession)
    schema = "doc_id long, score double, n_passages long, best_total double"

    def run(batches):
        for b in slices(batches):
            found = [model.evidence(tokens(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([model.score(e) for e, _, _ in found], pa.float64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.float64())], names=["doc_id", "score", "n_passages", "best_total"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def spans(docs: DataFrame, model: Model, *, level: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_token, end_token, total, expected of every significant passage."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            out = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = tokens(t)
                out += [(i, a, z, s, e) for a, z, s in model.passages(words) if (e := model.expected(s, len(words))) < level]
            names = ["doc_id", "first_token", "end_token", "total", "expected"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, first_token long, end_token long, total double, expected double")


def judge(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of every document, by a model that never saw the held-out fold's labels."""
    model = fit(docs, labels, folds=folds, held_out=held_out)
    out = score(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")


def keep(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their own columns; each row is judged by its own text."""
    model = fit(docs, labels)
    arrow_batches(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            yield b.filter(pa.array([model.score(model.evidence(tokens(t))[0]) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
