"""Quality rules: a base of fixed thresholds, then a learned decision list.

Statistics of each text are built-in expressions.  A bounded sample of labelled documents is binned natively
into at most ``bins`` values a statistic and grouped to cells of equal bins; over those cells, sequential
covering grows one conjunction of thresholds after another (each added condition is the one with the highest
information gain), prunes it on the cells of the other part of the sample, and removes what it covers.  The
list is emitted as ordered conditional expressions: the first rule that fits rejects, a text no rule fits is kept.

Defined results: null and empty texts have no words and fail the base; repeated rows are judged alike; without
labels of both kinds the list is empty and the base alone decides; an empty table gives an empty result; extra
columns are ignored by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of
from .labelled import sample

SYMBOLS = "#*$%&|<>"
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _removed(text: Column, characters: str) -> Column:
    """How many characters of an ASCII set a text holds."""
    return F.octet_length(text) - F.octet_length(F.translate(text, characters, ""))


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The five base statistics (long) beside the given columns.

    Words in repeated windows: windows are compared by 64-bit hash first; only a text with equal hashes goes on
    to compare the windows themselves, so that the count is exact.  Window starts that repeat are sorted, and
    neighbours less than a window apart share words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn("_w", words_of(F.col(text_col))).withColumn("_n", F.size("_w"))
    starts = F.when(F.col("_n") >= WINDOW, F.sequence(F.lit(0), F.col("_n") - WINDOW)).otherwise(F.array().cast("array<int>"))
    word = lambda i, k: F.get(F.col("_w"), i + k)
    out = out.withColumn("_h", F.transform(starts, lambda i: F.xxhash64(*[word(i, k) for k in range(WINDOW)])))
    spelt = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *[word(i, k) for k in range(WINDOW)]).alias("s"), i.alias("i")))
    # Equal windows stand side by side once sorted; a start is repeated if either neighbour holds the same window.
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(spelt)))
    same = lambda a, b: F.coalesce(F.get(F.col("_s"), a)["s"] == F.get(F.col("_s"), b)["s"], F.lit(False))
    repeated = F.filter(F.transform("_s", lambda x, k: F.when((k > 0) & same(k - 1, k) | same(k, k + 1), x["i"])), lambda x: x.isNotNull())
    out = out.withColumn("_r", F.sort_array(repeated))
    covered = F.aggregate(F.transform("_r", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_r"), k + 1) - x, F.lit(WINDOW))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_l", lines)
    return out.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": _removed(text, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        }
    ).drop("_w", "_n", "_h", "_s", "_r", "_l")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def learned_statistics(text_col: str = "text") -> dict[str, Column]:
    """Per-text shares that the decision list may test; the text's words must be counted already."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.greatest(F.octet_length(text), F.lit(1)).cast("double")
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    upper = F.octet_length(text) - F.octet_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "symbol_share": F.col("n_symbols") / words,
        "pipe_share": _removed(text, "|") / words,
        "bang_share": _removed(text, "!?") / words,
        "stop_share": _removed(text, ".,;:") / words,
        "upper_share": upper / size,
        "digit_share": _removed(text, "0123456789") / size,
        "word_length": F.col("word_chars") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / words,
        "words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether above, threshold); ``wrong`` of the texts it covered in the sample, and of which bad."""

    conditions: tuple[tuple[str, bool, float], ...]
    covered: int
    bad: int

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.conditions:
            out = out & (F.col(name) > F.lit(at) if above else F.col(name) <= F.lit(at))
        return out


def emit(rules: list[Rule]) -> Column:
    """The number of the first rule that fits, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1].column(), F.lit(k)).otherwise(out)
    return out


def _cells(held: DataFrame, bins: int) -> tuple[list[str], dict[str, list[float]], list[tuple[tuple[int, ...], int, int, int]]]:
    """Statistic names, thresholds of each, and (bins, part of the sample, good, bad) of each distinct cell."""
    stats = learned_statistics()
    held = with_statistics(held).select("doc_id", "label", *[c.alias(n) for n, c in stats.items()])
    names = list(stats)
    steps = [k / bins for k in range(1, bins)]
    at = {n: sorted(set(q)) for n, q in zip(names, held.approxQuantile(names, steps, 0.002), strict=True)}
    # Thresholds of the rarer class too: its range may lie beyond the quantiles of all.
    worse = held.where("label = 0").approxQuantile(names, steps, 0.01)
    at = {n: sorted({*at[n], *q}) for n, q in zip(names, worse, strict=True)}
    place = [sum(((F.col(n) > F.lit(v)).cast("int") for v in at[n]), F.lit(0)).alias(n) for n in names]
    part = (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).cast("int").alias("part")
    rows = held.select(*place, part, "label").groupBy(*names, "part").agg(F.sum((F.col("label") == 1).cast("int")).alias("good"), F.sum((F.col("label") != 1).cast("int")).alias("bad")).collect()
    return names, at, [(tuple(r[n] for n in names), r["part"], r["good"], r["bad"]) for r in rows]


def learn(docs: DataFrame, labels: DataFrame, *, rows: int = 12_000, bins: int = 24, longest: int = 3, most_rules: int = 12, least_precision: float = 0.9, least_bad: int = 8) -> list[Rule]:
    """The decision list, from at most ``rows`` labelled documents."""
    held = sample(docs, labels, "quality", rows=rows)
    names, at, cells = _cells(held, bins)
    grow, prune = [c for c in cells if c[1] == 0], [c for c in cells if c[1] == 1]
    tests = [(k, above, j) for k, n in enumerate(names) for j in range(len(at[n])) for above in (True, False)]

    def fits(cell, conditions) -> bool:
        return all((cell[0][k] > j) == above for k, above, j in conditions)

    def counts(part, conditions=()) -> tuple[int, int]:
        good = bad = 0
        for c in part:
            if fits(c, conditions):
                good, bad = good + c[2], bad + c[3]
        return good, bad

    def smoothed(good: int, bad: int) -> float:
        return (bad + 1) / (good + bad + 2)

    rules: list[Rule] = []
    while len(rules) < most_rules:
        conditions: list[tuple[int, bool, int]] = []
        inside = grow
        good, bad = counts(inside)
        while len(conditions) < longest and good and bad:
            base, best = math.log2(bad / (good + bad)), (0.0, None)
            for k in range(len(names)):
                n = len(at[names[k]]) + 1
                g, b = [0] * n, [0] * n
                for c in inside:
                    g[c[0][k]] += c[2]
                    b[c[0][k]] += c[3]
                low_g = low_b = 0
                for j in range(n - 1):
                    low_g, low_b = low_g + g[j], low_b + b[j]
                    for above, x, y in ((False, low_g, low_b), (True, good - low_g, bad - low_b)):
                        if y >= least_bad and (gain := y * (math.log2(y / (x + y)) - base)) > best[0] + 1e-9:
                            best = (gain, (k, above, j))
            if best[1] is None:
                break
            conditions.append(best[1])
            inside = [c for c in inside if fits(c, [best[1]])]
            good, bad = counts(inside)
        # Prune: drop final conditions while the other part of the sample says that this is no worse.
        value = lambda cs: (lambda g, b: (b - g) / max(1, g + b))(*counts(prune, cs))
        while len(conditions) > 1 and value(conditions[:-1]) >= value(conditions):
            conditions.pop()
        seen = [x + y for x, y in zip(counts(grow, conditions), counts(prune, conditions), strict=True)]
        if not conditions or seen[1] < least_bad or smoothed(*seen) < least_precision:
            break
        # Of two bounds on one side of a statistic only the closer one tells anything.
        closest: dict[tuple[int, bool], int] = {}
        for k, above, j in conditions:
            closest[k, above] = max(closest.get((k, above), j), j) if above else min(closest.get((k, above), j), j)
        rules.append(Rule(tuple((names[k], above, at[names[k]][j]) for (k, above), j in closest.items()), sum(seen), seen[1]))
        grow = [c for c in grow if not fits(c, conditions)]
        prune = [c for c in prune if not fits(c, conditions)]
    return rules


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics and base_failed of every document."""
    return with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))).select("doc_id", *BASE, base_failed().alias("base_failed"))


def _judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    out = with_statistics(docs).withColumns(learned_statistics())
    # The optimiser would copy the statistics' nested expressions into a filter below them, again and again; it leaves
    # a column that depends on the task where it is.
    placed = F.spark_partition_id() >= 0
    return out.withColumn("base_failed", base_failed()).withColumn("rule", emit(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull() & placed)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and the number of the rule that rejected."""
    rules = learn(docs, labels)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return _judged(narrow, rules).select("doc_id", *BASE, "base_failed", "kept", "rule")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    rules = learn(docs, labels)
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col("text"))
    kept = _judged(packed, rules).where("kept").select("_row")
    return kept.select(*[F.col("_row")[n].alias(n) for n in names])


