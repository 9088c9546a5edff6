"""Fit a Naive-Bayes-scaled linear model on labelled documents and score all of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear, textkit
from .common import MAX_TRAINING_ROWS, arrays, arrow_map, fold, labelled, stored

#: Features are hashed to this many bits.
BITS = 20

#: keys(data, offsets): distinct `row << BITS | feature` of one piece of packed texts.
Keys = Callable[[np.ndarray, np.ndarray], np.ndarray]


def features(batch: pa.RecordBatch, keys: Keys) -> np.ndarray:
    """Distinct `row << BITS | feature` of the batch's lower-cased texts (column `text`)."""
    data, at = textkit.packed(pc.utf8_lower(batch.column("text")))
    found = [np.zeros(0, np.int64)]
    for i, j in textkit.pieces(at):
        found.append(keys(data[at[i] : at[j]], at[i : j + 1] - at[i]) + (i << BITS))
    return np.concatenate(found)


def train(docs: DataFrame, labels: DataFrame, label: str, keys: Keys, cost: float, most: int = MAX_TRAINING_ROWS) -> linear.LinearModel:
    """A model of `labels.<label>` from rows outside fold 0.

    At most about `most` labelled ids are used (a documented bound, in expectation), one
    row each: an id's label is that of most of its label rows, its text the least of its
    rows' texts, an empty one where none has a text. Features are counted on the executors;
    what reaches the driver are 2 ** BITS counts at most, then the features of at most
    about `most` rows that the log-count ratios keep.
    """
    rows = labelled(labels.filter(fold() != 0), label, most)
    rows = rows.withColumn("tune", F.pmod(F.xxhash64("k", F.lit("tune")), F.lit(5)) == 0)
    texts = docs.select(F.col("doc_id").cast("long").alias("k"), "text").join(F.broadcast(rows), "k")  # one row an id, about `most`
    sample = stored(texts.groupBy("k", "y", "tune").agg(F.min("text").alias("text")).select("text", "y", "tune"))
    n = {(bool(r["tune"]), r["y"] == 1): r["count"] for r in sample.groupBy("tune", (F.col("y") == 1).alias("y")).count().collect()}
    some = n.get((False, True), 0) and n.get((False, False), 0)

    def count(batches):
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            found = features(batch, keys)
            used = ~np.asarray(batch.column("tune")) if some else np.ones(batch.num_rows, bool)
            good = np.asarray(batch.column("y")) == 1
            row, f = found >> BITS, found & ((1 << BITS) - 1)
            for k, own in enumerate((used & good, used & ~good)):
                counts[k] += np.bincount(f[own[row]], minlength=1 << BITS)
        f = np.flatnonzero(counts.any(0))
        yield pa.record_batch([pa.array(f.astype(np.int32)), pa.array(counts[0, f]), pa.array(counts[1, f])], ["f", "p", "q"])

    counts = sample.mapInArrow(count, "f int, p long, q long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).filter("p + q >= 3").toArrow()
    ratios = np.zeros(1 << BITS)
    sizes = [n.get((False, y), 0) + (0 if some else n.get((True, y), 0)) for y in (True, False)]
    ratios[np.asarray(counts["f"])] = linear.log_ratios(np.asarray(counts["p"]).astype(float), np.asarray(counts["q"]).astype(float), *sizes)
    kept = sample.sparkSession.sparkContext.broadcast(ratios != 0)

    def featurise(batch):
        found = features(batch, keys)
        found = found[kept.value[found & ((1 << BITS) - 1)]]
        starts = np.searchsorted(found >> BITS, np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array((found & ((1 << BITS) - 1)).astype(np.int32)))
        return pa.record_batch([batch.column("y"), batch.column("tune"), lists], ["y", "tune", "f"])

    table = arrow_map(sample, featurise, "y int, tune boolean, f array<int>").toArrow()
    order = np.lexsort((_row_hash(table), np.asarray(table["y"]))) if table.num_rows else []
    table = table.take(pa.array(order, pa.int64()))  # the same order however the tasks ended
    starts, found = arrays(table, "f")
    return linear.fit(starts, found, np.asarray(table["y"]), np.asarray(table["tune"]), ratios, cost)


def _row_hash(table: pa.Table) -> np.ndarray:
    starts, found = arrays(table, "f")
    sums = np.concatenate([[np.uint64(0)], np.cumsum(textkit.mix(found.astype(np.uint64)))])
    return sums[starts[1:]] - sums[starts[:-1]]


def score(docs: DataFrame, model: linear.LinearModel, keys: Keys, threshold: float) -> DataFrame:
    """doc_id, score and predicted of every document.

    Each row of `docs` gives one row, repeated ids and null ids included; a null or
    empty text is scored from the bias alone, a very long one as a whole. Equal texts have
    equal scores, a score at the threshold counts as above it. Other columns are not read.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights, whatever the input

    def run(batch):
        model = broadcast.value
        margins = model.margins(features(batch, keys), BITS, batch.num_rows)
        scores = model.scores(margins)
        return pa.record_batch([batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")
