"""Quality classifier: Naive Bayes support vectors on word n-grams.

N-gram indicators are scaled by class log-count ratios; a linear hinge-loss model is
fitted by dual coordinate descent and calibrated to 0..1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import scoring, textkit

#: Documents that score less are rejected.
THRESHOLD = 0.3
_REPEATED = np.uint64(0x51ED270B)


def word_keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distinct unigrams and bigrams of word and punctuation runs, hashed.

    Two equal neighbours give one common feature, whatever the word.
    """
    shift = np.uint64(64 - scoring.BITS)
    h, row, _ = textkit.tokens(data, at)
    inside = row[1:] == row[:-1]
    pair = np.where(h[1:] == h[:-1], _REPEATED, h[:-1] * np.uint64(3) + h[1:])[inside]
    one = (row << scoring.BITS) | (h >> shift).astype(np.int64)
    two = (row[1:][inside] << scoring.BITS) | (textkit.mix(pair) >> shift).astype(np.int64)
    return textkit.distinct(np.concatenate([one, two]))


def fit(docs: DataFrame, labels: DataFrame, **options):
    """Learn `labels.quality`; see scoring.train for the bound on rows and for nulls."""
    return scoring.train(docs, labels, "quality", word_keys, cost=0.1, **options)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, score, predicted (1: good) of every row of docs; see scoring.score.

    Without labels (or with one class only) every document gets that class's share.
    """
    return scoring.score(docs, fit(docs, labels, **options), word_keys, threshold)


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of docs that the classifier does not reject, all columns unchanged.

    Columns may have any name; the verdict on a row depends on its text alone, a null one
    counts as empty, repeated rows stay or go together.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    def run(batches):
        for batch in batches:
            found = scoring.features(batch, word_keys)
            scores = model.value.scores(model.value.margins(found, scoring.BITS, batch.num_rows))
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
