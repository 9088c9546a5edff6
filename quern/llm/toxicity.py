"""Toxicity: a linear classifier of character n-grams, scaled by log-count ratios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import scoring, textkit

THRESHOLD = 0.5
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Lengths of the n-grams, in characters of the text with punctuation made spaces.
ORDERS = (3, 5, 7)


def characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of packed UTF-8 texts, each as the number that its one to four bytes form, and each row's first."""
    lead = (data & 0xC0) != 0x80
    lead[at[:-1][at[:-1] < len(data)]] = True
    first = np.flatnonzero(lead)
    size = np.diff(np.append(first, len(data)))
    found = data[first].astype(np.uint64)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        found[longer] |= data[first[longer] + k].astype(np.uint64) << np.uint64(8 * k)
    return found, np.searchsorted(first, at)


def char_keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distinct n-grams of characters of lower-cased texts, hashed; none crosses a row."""
    shift = np.uint64(64 - scoring.BITS)
    plain = np.where(textkit.CLASSES[data] == textkit.WORD, data, np.uint8(32))
    wide, at = characters(plain, at)
    n, row = len(wide), np.repeat(np.arange(len(at) - 1), np.diff(at))
    gram, found = wide, [np.zeros(0, np.int64)]
    for k in range(1, max(ORDERS)):
        if k >= n:
            break
        gram = gram[:-1] * _STEP + wide[k:]
        if k + 1 in ORDERS:
            inside = row[k:] == row[: n - k]
            h = textkit.mix(gram[inside] + np.uint64(k)) >> shift
            found.append((row[: n - k][inside] << scoring.BITS) | h.astype(np.int64))
    return textkit.distinct(np.concatenate(found))


def fit(docs: DataFrame, labels: DataFrame, **options):
    """Learn `labels.toxic`; see scoring.train for the bound on rows and for nulls."""
    return scoring.train(docs, labels, "toxic", char_keys, cost=1.0, **options)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, score, predicted (1: toxic) of every row of docs; see scoring.score."""
    return scoring.score(docs, fit(docs, labels, **options), char_keys, threshold)
