"""Quality rules as learned decision lists, in DataFrame functions alone.

Statistics of a text are higher-order functions over its words, evaluated in one scan without a shuffle or
an explode. From the statistics of a bounded labelled sample (``cap`` rows a label value at most, each with the
weight that restores the whole table's mix of labels, so that precision means the same at every size) the driver learns
an ordered list of rules by sequential covering: a rule, a conjunction of thresholds, is grown condition by
condition by the gain in information over the rejected texts, pruned from its end on rows kept apart, and
kept while it is precise there; what it covers is removed and the next is grown. The list becomes one
ordered Spark conditional expression.

Defined results: a null, empty or blank text has no words and fails the base rule; repeated rows give
repeated rows; without labelled rows the list is empty and the base rule decides; of conditions with equal gain the
first in the order of statistics and thresholds counts; texts of any length are evaluated whole; an empty table gives
an empty one; columns named stats, base_failed, rule or kept are replaced, and other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import labelled_sample, quoted, without

SPACES = r"[\x20\x09-\x0D]+"
#: The statistics that rules may test.
FEATURES = ("n_words", "mean_word", "symbol_share", "upper_share", "digit_share", "bang_share", "bar_share", "dup_line_share", "repeat_share", "distinct_share")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, width: int = 5) -> Column:
    """How many words lie in windows of so many words that occur twice or more, the first one included."""

    def covered(positions: Column) -> Column:
        reach = F.transform(positions, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(positions, j + 1) - p, F.lit(width))))
        return F.aggregate(reach, F.lit(0), lambda total, n: total + n)

    def positions(sorted_windows: Column) -> Column:
        twice = F.filter(sorted_windows, lambda w, j: F.coalesce(F.get(sorted_windows, j - 1)["h"] == w["h"], F.lit(False)) | F.coalesce(F.get(sorted_windows, j + 1)["h"] == w["h"], F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda w: w["i"])), covered)

    def found(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # Most texts repeat nothing, which a hash set tells without the sort.
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, positions))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(width))))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(windows, found))


def statistics(df: DataFrame, text_col: str = "text", name: str = "stats") -> DataFrame:
    """All columns of df with a struct of whole-text statistics."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")

    def measured(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            *counts,
        )

    counts = [count(r"[#*$%&|<>]").alias("n_symbols"), count(r"[A-Z]").alias("n_upper"), count(r"[0-9]").alias("n_digits"), count(r"!!").alias("n_bangs"), count(r"\x20\|\x20").alias("n_bars"), F.size(lines).cast("long").alias("n_lines")]
    return df.select(*(quoted(c) for c in without(df, [name])), let(words, measured).alias(name))


def shares(stats: str = "stats") -> dict[str, Column]:
    """FEATURES from a struct of statistics."""
    s = lambda c: F.col(f"{stats}.{c}").cast("double")
    words, chars = F.greatest(s("n_words"), F.lit(1.0)), F.greatest(s("word_chars"), F.lit(1.0))
    values = (s("n_words"), chars / words, s("n_symbols") / chars, s("n_upper") / chars, s("n_digits") / chars, s("n_bangs") / words, s("n_bars") / words, s("n_dup_lines") / F.greatest(s("n_lines"), F.lit(1.0)), s("n_repeat_words") / words, s("n_distinct") / words)
    return dict(zip(FEATURES, values, strict=True))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, FEATURES.index(self.feature)]
        return column >= self.threshold if self.above else column <= self.threshold

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] >= self.threshold if self.above else values[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


def _covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, weight: np.ndarray, most: int, cuts: int = 48) -> list[Condition]:
    rule: list[Condition] = []
    inside, wrong = np.ones(len(x), dtype=bool), weight * bad
    while len(rule) < most and (p0 := wrong[inside].sum()) and not bad[inside].all():
        before, best = np.log2(p0 / weight[inside].sum()), (1e-9, None)
        for k, feature in enumerate(FEATURES):
            for t in np.unique(np.quantile(x[inside & bad, k], np.linspace(0, 1, cuts), method="nearest")).tolist():
                for above in (True, False):
                    hit = inside & (x[:, k] >= t if above else x[:, k] <= t)
                    p = wrong[hit].sum()
                    if p and (gain := p * (np.log2(p / weight[hit].sum()) - before)) > best[0]:
                        best = gain, Condition(feature, above, t)
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, weight: np.ndarray | None = None, most_rules: int = 8, most_conditions: int = 4, precision: float = 0.95, least: int = 5) -> list[list[Condition]]:
    """Sequential covering of the bad rows: grown on two thirds, pruned and judged on the third; counts are weighted."""
    rules: list[list[Condition]] = []
    weight = np.ones(len(x)) if weight is None else weight
    apart = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and bad[~apart].any():
        rule = _grow(x[~apart], bad[~apart], weight[~apart], most_conditions)

        def worth(r: list[Condition]) -> float:
            hit = _covers(r, x[apart])
            return ((weight * bad)[apart][hit].sum() + 0.5) / (weight[apart][hit].sum() + 1) if r else 0.0

        rule = max((rule[:n] for n in range(1, len(rule) + 1)), key=worth, default=[])  # the shortest of equals
        hit = _covers(rule, x)
        if not rule or bad[hit].sum() < least or (weight * bad)[hit].sum() / weight[hit].sum() < precision:
            break
        rules.append(rule)
        x, bad, weight, apart = x[~hit], bad[~hit], weight[~hit], apart[~hit]
    return rules


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", cap: int = 3000, id_col: str = "doc_id", text_col: str = "text", **options) -> list[list[Condition]]:
    """Rules that reject label 0, from at most cap labelled documents a value."""
    sample = statistics(labelled_sample(docs, labels, label, cap, id_col, text_col))
    values = shares()
    # Numbers alone, about 100 bytes a row, go to the driver.
    rows = sorted(tuple(r) for r in sample.select("label", "weight", *(values[f].alias(f) for f in FEATURES)).collect())
    if not rows:
        return []
    rows = np.array(rows, dtype=float)
    rows = rows[np.random.default_rng(11).permutation(len(rows))]
    return learn(rows[:, 2:], rows[:, 0] == 0, rows[:, 1], **options)


def decision(rules: list[list[Condition]], stats: str = "stats") -> Column:
    """The list as an ordered conditional: the number of the first rule that holds, null for none."""
    values = shares(stats)
    out: Column | None = None
    for k, rule in enumerate(rules):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column(values)
        out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def apply_rules(df: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """All columns of df with stats, base_failed, rule (that rejects it) and kept."""
    s = lambda c: F.col(f"stats.{c}")
    out = statistics(df, text_col)
    out = out.withColumn("base_failed", (s("n_words") < 10) | (100 * s("n_repeat_words") > 20 * s("n_words")))
    return out.withColumn("rule", decision(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
