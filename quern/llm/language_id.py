"""Language identification of whole and mixed texts.

Script ranges narrow each word's candidate languages; words are scored by character
trigrams and as wholes; a Viterbi pass with a switching penalty labels the words, and
equal neighbours form spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import arrow_map, bounded, fold

#: Documents that are learned from at most (in expectation).
MAX_TRAINING_ROWS = 12_000
#: Features are hashed to 2 ** BITS for trigrams and as many for words.
BITS = 15
#: What a change of language costs, in units of log likelihood.
SWITCH = 8.0
#: Bytes of text that are labelled in step.
PIECE = 4 << 20
UNKNOWN = "und"

#: First code points of scripts (fixed values); a script ends where the next begins.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
_FIRST = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


def words(data: np.ndarray, at: np.ndarray):
    """Starts, ends, rows and scripts of runs of letters, and the plain lower-cased bytes."""
    letters = _LETTERS[data]
    starts, ends, rows = textkit.runs(letters.astype(np.uint8), at)
    plain = np.where(letters, textkit.LOWER[data], np.uint8(32))
    wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    b0, b1, b2 = (wide[starts + k] for k in range(3))
    point = np.where(b0 < 0xC0, b0 & 0x7F, np.where(b0 < 0xE0, ((b0 & 31) << 6) | (b1 & 63), ((b0 & 15) << 12) | ((b1 & 63) << 6) | (b2 & 63)))
    return starts, ends, rows, _SCRIPT[np.searchsorted(_FIRST, point, "right") - 1], plain


def word_features(plain: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Trigram features with the word of each, and one feature for each whole word."""
    padded = np.concatenate([[np.uint8(32)], plain, np.full(2, 32, np.uint8)]).astype(np.uint64)
    lengths = ends - starts
    word = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    first, last = padded[at], padded[at + 2]
    first[np.cumsum(lengths) - lengths] = 32  # a word's own ends, whatever is next to it
    last[np.cumsum(lengths) - 1] = 32
    grams = textkit.mix(first | (padded[at + 1] << np.uint64(8)) | (last << np.uint64(16))) >> np.uint64(64 - BITS)
    whole = textkit.run_hashes(plain, starts, ends) >> np.uint64(64 - BITS)
    return grams.astype(np.int64), word, whole.astype(np.int64) + (1 << BITS)


@dataclass
class LanguageModel:
    """Log likelihoods of features by language, and which scripts a language is written in."""

    languages: list[str]
    table: np.ndarray  # features x languages
    scripts: np.ndarray  # scripts x languages, 0 or a prohibitive penalty

    def word_scores(self, plain, starts, ends, scripts) -> np.ndarray:
        grams, word, whole = word_features(plain, starts, ends)
        total = np.add.reduceat(self.table[grams], np.flatnonzero(np.diff(word, prepend=-1))) if len(word) else np.zeros((0, len(self.languages)), np.float32)
        return total + self.table[whole] + self.scripts[scripts]


#: Words that a row advances by one after the other; longer rows are cut into such blocks, which advance side by side.
STEPS = 512


def viterbi(scores: np.ndarray, at: np.ndarray, penalty: float, steps: int = STEPS) -> np.ndarray:
    """The best label of every word; rows (words at[i] to at[i + 1]) advance in step.

    A long row is cut into blocks of `steps` words. Each block finds the best way through it
    from each label to each, all blocks in step; the few blocks of a row are then chained,
    and the ways that the chain takes are traced back, again in step.
    """
    lengths, n = np.diff(at), scores.shape[1]
    cuts = -(-lengths // steps)
    row = np.repeat(np.arange(len(lengths)), cuts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin = at[:-1][row] + nth * steps
    size = np.minimum(at[1:][row] - begin, steps)
    entry = np.full(len(row), -1, np.int16)  # the label of the word before a block
    later = np.flatnonzero(nth > 0)
    if len(later):
        entry[later] = _entries(scores, begin, size, nth, later, penalty)
    out = np.zeros(len(scores), np.int16)
    first = np.full((len(row), n), 0.0)
    has = entry >= 0
    first[has] = -penalty
    first[has, entry[has]] = 0.0
    last = np.full(len(row), -1, np.int16)
    last[np.flatnonzero(nth[1:] > 0)] = entry[np.flatnonzero(nth[1:] > 0) + 1]
    _advance(scores, begin, size, first, penalty, out, last)
    return out


def _advance(scores, begin, size, value, penalty, out=None, last=None) -> np.ndarray:
    """The best sums of blocks by their last label, from `value` before their first word on.

    With `out` the labels of each block's best way are put there, or of its best way that
    ends in the label `last`, where that is not negative.
    """
    order = np.argsort(-size, kind="stable")
    starts, lengths = begin[order], size[order]
    value, labels = value[order], np.arange(scores.shape[1], dtype=np.int16)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # blocks longer than each step
    back = np.zeros(scores.shape, np.int16) if out is not None else None
    for t in range(longest):
        k = active[t]
        v, place = value[:k], starts[:k] + t
        if t:
            best = v.argmax(1).astype(np.int16)
            moved = v[np.arange(k), best] - penalty
            switch = v < moved[:, None]
            if back is not None:
                back[place] = np.where(switch, best[:, None], labels)
            value[:k] = np.where(switch, moved[:, None], v) + scores[place]
        else:
            value[:k] = v + scores[place]
    if out is not None and longest:
        state = value.argmax(1).astype(np.int16)
        if last is not None:
            state = np.where(last[order] >= 0, last[order], state).astype(np.int16)
        for t in range(longest - 1, -1, -1):
            k = active[t]
            place = starts[:k] + t
            out[place] = state[:k]
            state[:k] = back[place, state[:k]]
    result = np.empty_like(value)
    result[order] = value
    return result


def _entries(scores, begin, size, nth, later, penalty) -> np.ndarray:
    """The label of the word before each of the blocks `later`, on the best way through its whole row."""
    n = scores.shape[1]
    # Ways through a block from each label before it: as many blocks again for each label.
    start = np.full((n, n), -penalty)
    np.fill_diagonal(start, 0.0)
    through = np.empty((len(later), n, n))
    for label in range(n):
        through[:, label] = _advance(scores, begin[later], size[later], np.broadcast_to(start[label], (len(later), n)).copy(), penalty)
    heads = np.flatnonzero(nth == 0)
    long = heads[np.append(nth[1:], 0)[heads] > 0]
    head = _advance(scores, begin[long], size[long], np.zeros((len(long), n)), penalty)
    place = {int(b): k for k, b in enumerate(later.tolist())}
    entry = np.zeros(len(later), np.int16)
    for k, b in enumerate(long.tolist()):
        value, back, x = head[k], [], b + 1
        while x in place and nth[x] > 0:
            ways = value[:, None] + through[place[x]]
            back.append(ways.argmax(0))
            value, x = ways.max(0), x + 1
        state = int(value.argmax())
        for y in range(len(back) - 1, -1, -1):
            state = int(back[y][state])
            entry[place[b + 1 + y]] = state
    return entry


def fit(docs: DataFrame, most: int = MAX_TRAINING_ROWS) -> LanguageModel:
    """Learn from text and non-null lang of documents outside fold 0, about `most` at most.

    Rows are chosen by id and text, so that repeated ids are no more than other rows; equal
    rows are chosen together, but only counted. What reaches the driver is a count for each
    language and hashed feature.
    """
    rows = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(fold() != 0)
    rows = bounded(rows, most, "doc_id", "text")
    size = 2 << BITS

    def count(batch):
        data, at = textkit.packed(batch.column("text"))
        names = batch.column("lang").to_pylist()
        out: dict[str, np.ndarray] = {}
        for i, j in textkit.pieces(at):
            starts, ends, row, scripts, plain = words(data[at[i] : at[j]], at[i : j + 1] - at[i])
            grams, word, whole = word_features(plain, starts, ends)
            own = np.array(names[i:j], object)
            for lang in set(names[i:j]):
                is_own = (own == lang)[row]
                sums = out.setdefault(lang, np.zeros(size + len(_NAMES), np.int64))
                sums[:size] += np.bincount(np.concatenate([grams[is_own[word]], whole[is_own]]), minlength=size)
                sums[size:] += np.bincount(scripts[is_own], minlength=len(_NAMES))
        found = [(lang, f, sums[f]) for lang, sums in out.items() for f in [np.flatnonzero(sums)]]
        return pa.record_batch([pa.array([l for l, f, _ in found for _ in f], pa.string()), pa.array(np.concatenate([f for _, f, _ in found]).astype(np.int32)), pa.array(np.concatenate([s for *_, s in found]))], ["lang", "f", "n"])

    table = arrow_map(rows, count, "lang string, f int, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table["lang"].to_pylist()))
    counts = np.zeros((size + len(_NAMES), len(languages)))
    place = {l: i for i, l in enumerate(languages)}
    counts[np.asarray(table["f"]), [place[l] for l in table["lang"].to_pylist()]] = np.asarray(table["n"])
    likely = np.zeros((size, len(languages)), np.float32)
    for part in (slice(0, 1 << BITS), slice(1 << BITS, size)):
        c = counts[part] + 0.5
        likely[part] = np.log(c / c.sum(0))
    likely -= likely.mean(1, keepdims=True) if languages else 0
    scripts = counts[size:]
    used = scripts >= 0.001 * np.maximum(scripts.sum(0), 1)
    return LanguageModel(languages, likely, np.where(used | ~used.any(1, keepdims=True), 0, -1000).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, penalty: float = SWITCH, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score of every row, and on demand its spans.

    lang_pred labels most words (the first in order of name of equals), score is the
    share of words it labels. A text that is null or has no letter is `und` with score
    0. Repeated rows and null ids give a row each, very long texts are labelled whole, other
    columns are not read. spans: array of (start, end, lang), byte offsets into the UTF-8 text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** (BITS + 1) values for each language

    def run(batch):
        model = shared.value
        data, at = textkit.packed(batch.column("text"))
        n = batch.num_rows
        best, share, found = np.full(n, -1), np.zeros(n), [[] for _ in range(n)]
        for i, j in textkit.pieces(at, PIECE):
            starts, ends, row, scripts, plain = words(data[at[i] : at[j]], at[i : j + 1] - at[i])
            if not len(starts) or not model.languages:
                continue
            labels = viterbi(model.word_scores(plain, starts, ends, scripts), np.searchsorted(row, np.arange(j - i + 1)), penalty)
            tally = np.bincount(row * len(model.languages) + labels, minlength=(j - i) * len(model.languages)).reshape(j - i, -1)
            some = tally.any(1)
            best[i:j] = np.where(some, tally.argmax(1), -1)
            share[i:j] = tally.max(1) / np.maximum(tally.sum(1), 1)
            if spans:
                cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (labels[1:] != labels[:-1])]))
                for a, b in zip(cut, np.append(cut[1:], len(row))):
                    base = at[i + row[a]] - at[i]
                    found[i + row[a]].append({"start": int(starts[a] - base), "end": int(ends[b - 1] - base), "lang": model.languages[labels[a]]})
        low = textkit.LOWER[data]
        ascii_letters = np.concatenate([[0], np.cumsum((low >= 97) & (low < 123))])
        for i in np.flatnonzero((best >= 0) & (np.diff(ascii_letters[at]) == 0)):
            if not any(map(str.isalpha, batch.column("text")[int(i)].as_py())):
                best[i], share[i], found[i] = -1, 0.0, []
        names = [*model.languages, UNKNOWN]
        columns = [batch.column("doc_id"), pa.array([names[k] for k in best]), pa.array(share)]
        if spans:
            columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
        return pa.record_batch(columns, ["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<start: int, end: int, lang: string>>" * spans
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
