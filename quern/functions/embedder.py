"""A deterministic text embedder, the default provider of vectors."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors

DIMENSIONS = 384
_NOT_WORD = re.compile(r"[^\w\s]", re.ASCII)
_known: dict[str, np.ndarray] = {}


def fnv1a(word: str) -> int:
    """32-bit FNV-1a of the UTF-8 bytes."""
    h = 0x811C9DC5
    for b in word.encode():
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h


def _word_vector(word: str) -> np.ndarray:
    if word not in _known:
        if len(_known) > 20_000:
            _known.clear()
        _known[word] = np.sin(((fnv1a(word) + 31 * np.arange(DIMENSIONS, dtype=np.int64)) & 0xFFFFFFFF) / 1e6)
    return _known[word]


def embed(text: str | None) -> np.ndarray:
    """Summed word vectors at length 1; zeros without words, the first axis for a zero sum."""
    words = _NOT_WORD.sub(" ", (text or "").lower()).split()
    total = np.zeros(DIMENSIONS)
    for word in words:
        total += _word_vector(word)
    length = np.linalg.norm(total)
    if length:
        return total / length
    if words:
        total[0] = 1.0
    return total


_MASK, _STEP = 0xFFFFFFFF, 31
#: Words whose hash is at least this begin again at 0 for one of the entries.
_WRAPS = (1 << 32) - _STEP * (DIMENSIONS - 1)


def word_hashes(text: Column) -> Column:
    """FNV-1a of each word of a text: runs of a-z, 0-9 and _ in lower case, so one byte a letter."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(0x01000193)).bitwiseAND(F.lit(_MASK))
    return F.transform(words, lambda w: F.aggregate(F.split(w, ""), F.lit(0x811C9DC5).cast("long"), step))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def summed(text: Column) -> Column:
    """See `summed_hashes`; the words of a text are hashed once."""
    return _let(word_hashes(text), summed_hashes)


def summed_hashes(hashes: Column) -> Column:
    """What a text's vector depends on: sums s and c of sines and cosines of h / 1e6, the number of words n, and `around`, all hashes if one wraps."""
    around = F.when(F.exists(hashes, lambda h: h >= _WRAPS), hashes).otherwise(F.array().cast("array<bigint>"))
    sines, cosines = (_total(F.transform(hashes, lambda h: f(h / F.lit(1e6)))) for f in (F.sin, F.cos))
    return F.struct(sines.alias("s"), cosines.alias("c"), F.size(hashes).alias("n"), around.alias("around"))


def summed_vector(p: Column) -> Column:
    """The vector that `embed` gives for words with the sums p.

    Entry i sums sin((h + 31 i mod 2**32) / 1e6). By the sine of a sum this is
    s cos(31 i / 1e6) + c sin(31 i / 1e6), so that words are summed once and not once an
    entry; the few words that wrap around are corrected.
    """

    steps = _STEP * np.arange(DIMENSIONS)
    cosines, sines = (F.array(*(F.lit(float(x)) for x in f(steps / 1e6))) for f in (np.cos, np.sin))
    plain = F.zip_with(cosines, sines, lambda x, y: p["s"] * x + p["c"] * y)

    def righted(v: Column, i: Column) -> Column:
        at = i.cast("long") * F.lit(_STEP)
        wrapped = lambda h: F.when(h + at > _MASK, F.sin((h + at - F.lit(_MASK + 1)) / F.lit(1e6)) - F.sin((h + at) / F.lit(1e6))).otherwise(0.0)
        return v + _total(F.transform(p["around"], wrapped))

    raw = F.when(F.size(p["around"]) == 0, plain).otherwise(F.transform(plain, righted))

    def scaled(v: Column) -> Column:
        return _let(F.sqrt(_total(F.transform(v, lambda x: x * x))), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(first))

    first = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), DIMENSIONS - 1))
    return F.when(p["n"] == 0, F.array_repeat(F.lit(0.0), DIMENSIONS)).otherwise(_let(raw, scaled))


def summed_similarity(p: Column, q: Column) -> Column:
    """The cosine of two texts' vectors from their sums: no entry is computed unless a word wraps."""
    at = _STEP * np.arange(DIMENSIONS) / 1e6
    cc, cs, ss = (F.lit(float(x)) for x in (np.cos(at) @ np.cos(at), np.cos(at) @ np.sin(at), np.sin(at) @ np.sin(at)))
    dot = lambda a, b: a["s"] * b["s"] * cc + (a["s"] * b["c"] + a["c"] * b["s"]) * cs + a["c"] * b["c"] * ss
    plain = (F.size(p["around"]) == 0) & (F.size(q["around"]) == 0)
    length = F.sqrt(dot(p, p)) * F.sqrt(dot(q, q))
    short = F.when((p["n"] == 0) | (q["n"] == 0) | (length == 0), F.lit(0.0)).otherwise(dot(p, q) / length)
    return F.when(plain, short).otherwise(vectors.cosine_similarity(summed_vector(p), summed_vector(q)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def embedding(text: Column, provider: Callable[[str | None], np.ndarray] | None = None) -> Column:
    """The vectors of a text column: of `embed` as a column expression, of another provider by Arrow batches."""
    if provider is None:
        return _let(summed(text), summed_vector)

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([provider(t) for t in texts])

    return run(text)
