"""Quality rules: statistics of each text and decision lists learned from labels.

Sequential covering: a conjunction of thresholds is grown on one part of the labelled
statistics, pruned on the other, and what it covers is set aside before the next one.
The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import arrow_map, labelled, stored

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Symbols that count as noise (fixed values).
SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")

#: Labelled documents that rules are learned from at most (in expectation).
MAX_TRAINING_ROWS = 20_000

#: What rules may test, as Spark SQL over the statistics.
MEASURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
}


def repeated_words(words: list[str]) -> int:
    """How many words lie in a 3-word window that occurs at least twice."""
    if len(words) < 4:
        return 0
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) > 1_000_000:  # keeps the product below 2 ** 63
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(known) + ids[2:]
    order = np.sort(windows)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    starts = np.flatnonzero(np.isin(windows, again))
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[starts + k] = True
    return int(inside.sum())


def measured(text: str) -> tuple[int, ...]:
    """STATISTICS of one text, but for the last two."""
    words = _WORD.findall(text)
    lines = text.split("\n")
    seen, twice = set(), 0
    for line in lines:
        if line in seen:
            twice += _WORD.search(line) is not None
        seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), twice, repeated_words(words), len(lines)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of every row of docs, whole texts; null counts as empty."""

    def run(batch):
        data, at = textkit.packed(batch.column("text"))
        rows = np.array([measured(t or "") for t in batch.column("text").to_pylist()], np.int64).reshape(-1, 6)
        marks = (textkit.CLASSES == textkit.OTHER) | (np.arange(256) == 0)
        upper = np.arange(256)
        upper = (upper >= 65) & (upper < 91)
        counts = [np.diff(np.concatenate([[0], np.cumsum(table[data])])[at]) for table in (upper, marks)]
        return pa.record_batch([batch.column("doc_id"), *(pa.array(c) for c in rows.T), *(pa.array(c.astype(np.int64)) for c in counts)], ["doc_id", *STATISTICS])

    schema = "doc_id long, " + ", ".join(f"{s} long" for s in STATISTICS)
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


@dataclass(frozen=True)
class Test:
    """One threshold: measure >= value, or measure <= value."""

    measure: str
    above: bool
    value: float

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        x = data[self.measure]
        return x >= self.value if self.above else x <= self.value

    def column(self) -> Column:
        x = F.expr(MEASURES[self.measure])
        return x >= self.value if self.above else x <= self.value


Rule = tuple[Test, ...]


def covered(rule: Rule, data: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for test in rule:
        hit &= test.holds(data)
    return hit


def _best_test(data, bad, inside, cuts):
    """The test with the highest information gain over the rows still inside."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    base, best, gain = np.log2(p0 / (p0 + n0)), None, 1e-9
    for name, grid in cuts.items():
        x = data[name]
        for above in (True, False):
            side = "left" if above else "right"
            p, n = np.searchsorted(np.sort(x[bad & inside]), grid, side), np.searchsorted(np.sort(x[~bad & inside]), grid, side)
            if above:
                p, n = p0 - p, n0 - n
            with np.errstate(divide="ignore", invalid="ignore"):
                found = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - base), -1)
            if len(found) and (k := int(found.argmax())) is not None and found[k] > gain:
                best, gain = Test(name, above, float(grid[k])), found[k]
    return best


def learn(data: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 5, most_tests: int = 4, most_rules: int = 12) -> list[Rule]:
    """An ordered list of rules for bad rows; empty where none is precise enough."""
    n, rules = len(bad), []
    if not n or not bad.any() or bad.all():
        return rules
    cuts = {k: np.unique(np.quantile(x, np.linspace(0, 1, 257))) for k, x in data.items()}
    left, failures = np.ones(n, bool), 0
    random = np.random.default_rng(3)
    while len(rules) < most_rules and failures < 3 and (bad & left).sum() >= least:
        held = random.permutation(n) % 3 == 0
        grow, prune = left & ~held, left & held
        rule, inside = (), grow.copy()
        while len(rule) < most_tests and (bad & inside).any() and (~bad & inside).any():
            if (test := _best_test(data, bad, inside, cuts)) is None:
                break
            rule, inside = (*rule, test), inside & test.holds(data)

        def worth(r, rows=prune):
            hit = covered(r, data, n) & rows
            p, q = int((bad & hit).sum()), int((~bad & hit).sum())
            return (p - q) / (p + q) if p + q else 0.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())
        hit = covered(rule, data, n) & left
        right = int((bad & hit).sum())
        if not rule or right < least or right < precision * hit.sum() or worth(rule) < 2 * precision - 1.1:
            failures += 1  # another split may find one
            continue
        rules.append(rule)
        left &= ~hit
    return rules


def as_column(rules: list[Rule]) -> Column:
    """True for rows that no rule rejects: one ordered conditional expression."""
    verdict = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        condition = rule[0].column()
        for test in rule[1:]:
            condition = condition & test.column()
        verdict = verdict.when(condition, F.lit(False))
    return verdict.otherwise(F.lit(True))


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{t.measure} {'>=' if t.above else '<='} {t.value:.6g}" for t in r) for r in rules]


def fit(stats: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS, **options) -> list[Rule]:
    """Rules from the statistics of labelled documents (quality 0 is bad).

    About `most` labelled ids are used at most (a documented bound), one row each: an id's
    label is that of most of its label rows, its statistics the least of its rows'.
    """
    names = ("n_words", *(s for s in STATISTICS if s != "n_words"))
    own = F.min(F.struct(*names)).alias("s")
    found = stats.withColumnRenamed("doc_id", "k").join(F.broadcast(labelled(labels, "quality", most)), "k").groupBy("k", "y").agg(own)
    found = found.select("k", "y", "s.*").select("k", "y", *(F.expr(e).alias(m) for m, e in MEASURES.items()))
    table = found.toArrow()
    table = table.sort_by([("k", "ascending"), ("y", "ascending")])
    return learn({m: np.asarray(table[m]) for m in MEASURES}, np.asarray(table["y"]) == 0, **options)


def base_failed() -> Column:
    """Under 50 words, or over half of them in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, STATISTICS, base_failed, kept of every row of docs.

    base_failed: under 50 words, or over half of them in repeated 3-word windows. Other
    documents are kept unless a learned rule fits; without labels all of them are. Repeated
    and null ids give a row each, equal texts the same verdict; null texts count as empty,
    long ones are read whole. Other columns are not read. Of tests with equal gain the
    first measure, then the lowest cut is taken.
    """
    stats = stored(statistics(docs))
    rules = fit(stats, labels, **options)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & as_column(rules))
