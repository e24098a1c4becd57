"""Quality rules: a decision list learned by sequential covering, emitted as ordered Spark conditions.

The statistics of a text are column expressions over that row alone. The
learner sees a bounded sample of labelled rows (``SAMPLE_ROWS`` rows of
statistics, chosen by a hash of ``doc_id``); the rules it emits are applied to
every row.

Defined results: a null text has no words and fails; rows with a null label,
and labels of unknown documents, are not learned from; a document labelled
more than once takes its lowest label; without both classes the learned list
is empty and the fixed rules alone decide; rows that repeat are judged each, an
empty table gives an empty result, texts of any length are counted whole;
columns named as a statistic, ``base_failed``, ``rule`` or ``kept`` are replaced,
and all others stay, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import let
from tidemark.functions.names import unused

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Labelled rows the learner may see, and how it grows and prunes.
SAMPLE_ROWS, CUTS, MAX_RULES, MAX_CONDITIONS = 8192, 48, 12, 4
MIN_PRECISION, MIN_COVER = 0.95, 8


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words that stand in a window of ``WINDOW`` words found twice or more in the text."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeated(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            ordered,
            lambda s: let(
                F.array_sort(
                    F.transform(
                        F.filter(s, lambda x, j: (x["h"] == F.get(s, j + 1)["h"]) | ((j > 0) & (x["h"] == F.get(s, F.greatest(j - 1, F.lit(0)))["h"]))),
                        lambda x: x["i"],
                    )
                ),
                covered,
            ),
        )

    def windows_of(hashes: Column) -> Column:
        return F.transform(
            F.slice(hashes, 1, F.size(hashes) - WINDOW + 1),
            lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, WINDOW))),
        )

    def measure(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(repeated(windows))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(hashed, lambda h: let(windows_of(h), measure)))


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_digits")


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns of ``STATISTICS``, all counts; columns of these names are replaced, others stay.

    They are columns of their own, not one struct: the optimizer would inline
    a struct's parts into every later use and count each text many times.
    """
    kept = docs.drop(*STATISTICS)
    words, lines = unused(kept, "_words", "_lines")
    body = F.coalesce(F.col(text), F.lit(""))
    filled = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    staged = kept.withColumns({words: F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), lines: filled})
    words, lines = F.col(words), F.col(lines)
    counts = (
        F.size(words).cast("long"),
        _count(body, WORD),
        _count(body, r"[#*$%&|<>]"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        _repeat_words(words),
        F.size(lines).cast("long"),
        _count(body, r"[^\p{L}\p{N}\s]+"),
        _count(body, r"[\p{Lu}]+"),
        _count(body, r"[0-9]+"),
    )
    return staged.select(*kept.columns, *(c.alias(name) for name, c in zip(STATISTICS, counts, strict=True)))


def features() -> dict[str, Column]:
    """Ratios that the rules may test, by name."""
    over = lambda a, b: F.round(F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)), 6)
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": over("word_chars", "n_words"),
        "symbols_per_word": over("n_symbols", "n_words"),
        "duplicate_lines": over("n_dup_lines", "n_lines"),
        "repeated_words": over("n_repeat_words", "n_words"),
        "marks_per_word": over("n_marks", "n_words"),
        "upper_per_char": over("n_upper", "word_chars"),
        "digits_per_char": over("n_digits", "word_chars"),
        "words_per_line": over("n_words", "n_lines"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.cut if self.at_least else x[self.feature] <= self.cut

    def column(self, cols: dict[str, Column]) -> Column:
        return cols[self.feature] >= self.cut if self.at_least else cols[self.feature] <= self.cut


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, cuts: dict[str, np.ndarray]) -> Rule:
    """Adds the condition of the largest information gain until only positives are covered."""
    rule: Rule = ()
    inside = np.ones(len(y), dtype=bool)
    while len(rule) < MAX_CONDITIONS:
        p, n = int(y[inside].sum()), int((~y[inside]).sum())
        if p == 0 or n == 0:
            break
        prior, best = np.log2(p / (p + n)), (1e-9, None)
        for name, values in cuts.items():
            v = x[name][inside]
            for at_least in (True, False):
                hit = v[None, :] >= values[:, None] if at_least else v[None, :] <= values[:, None]
                pos = (hit & y[inside]).sum(axis=1)
                every = hit.sum(axis=1)
                gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1) / np.maximum(every, 1)) - prior), -1.0)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], Condition(name, at_least, float(values[at])))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def learn_rules(x: dict[str, np.ndarray], positive: np.ndarray) -> list[Rule]:
    """Ordered rules for the positive class; grown on two rows of three, pruned on the third."""
    rules: list[Rule] = []
    alive = np.ones(len(positive), dtype=bool)
    fold = np.arange(len(positive)) % 3 == 0
    while len(rules) < MAX_RULES:
        grow, prune = alive & ~fold, alive & fold
        if positive[grow].sum() < MIN_COVER or not (~positive[grow]).any():
            break
        gx, px = ({k: v[part] for k, v in x.items()} for part in (grow, prune))
        cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, CUTS))) for k, v in gx.items()}
        rule = _grow(gx, positive[grow], cuts)
        py, best = positive[prune], (-2.0, rule)
        for size in range(1, len(rule) + 1):
            hit = _covers(rule[:size], px, len(py))
            worth = (py[hit].sum() - (~py[hit]).sum()) / hit.sum() if hit.any() else -1.0
            if worth > best[0]:
                best = (worth, rule[:size])
        rule = best[1]
        hit = _covers(rule, x, len(positive)) & alive
        if not rule or hit.sum() < MIN_COVER or positive[hit].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        alive &= ~hit
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules that reject documents labelled 0, from at most ``sample_rows`` labelled rows."""
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min(label).alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    named = features()
    rows = text_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    got = (
        rows.select("doc_id", "_label", base_failed().alias("_failed"), *(c.alias(k) for k, c in named.items()))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
    )
    got = [r for r in got if not r["_failed"]]
    x = {k: np.array([r[k] for r in got], dtype=float) for k in named}
    return learn_rules(x, np.array([r["_label"] == 0 for r in got], dtype=bool)) if got else []


def rejected_by(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 where none does."""
    cols, out = features(), F.lit(0)
    for at in range(len(rules), 0, -1):
        holds = F.lit(True)
        for c in rules[at - 1]:
            holds = holds & c.column(cols)
        out = F.when(holds, F.lit(at)).otherwise(out)
    return out


def judge_quality(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds the statistics, ``base_failed``, ``rule`` (0: none) and ``kept``."""
    staged = text_statistics(docs.drop("base_failed", "rule", "kept"))
    marked = staged.withColumns({"base_failed": base_failed(), "rule": rejected_by(rules)})
    return marked.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    from tidemark.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    return judge_quality(docs, rules).select("doc_id", *STATISTICS[:5], "base_failed", "kept", "rule")
