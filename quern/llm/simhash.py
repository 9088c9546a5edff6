"""SimHash near-duplicates, with candidates by pigeonring filtering.

A fingerprint's 64 bits lie on a ring of five segments. Two fingerprints with at most
four differing bits have a segment from which, clockwise, every chain of l segments
differs in at most 4 * l / 5 bits: 0, 1, 2, 3, 4. Chains of one and two segments are
looked up by key (an equal segment, then one at most one bit away); longer chains prune
the candidates before the full Hamming check.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import arrow_map, fresh, joined, stored
from .components import components

#: Differing bits up to which two fingerprints are linked.
BITS = 4
SHINGLE = 4
WIDTHS = (13, 13, 13, 13, 12)
#: Fingerprints of one key that one group compares; larger keys are dealt in cells.
CELL = 8192

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SHIFTS = tuple(int(x) for x in np.cumsum((0, *WIDTHS[:-1])))
_MASKS = tuple(((1 << w) - 1) << s for w, s in zip(WIDTHS, _SHIFTS))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of the `size`-word shingles of lower-cased text."""
    words = _WORD.findall(text.lower())
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[len(words) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        bits = np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16 if n < 60_000 else np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of every row; null text counts as empty."""

    def run(batch):
        texts = batch.column("text").cast(pa.large_binary())
        fps = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64)
        return pa.record_batch([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def _ring_keys(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Keys of each fingerprint: its own (kind 0) and those one bit off in the next segment (kind 1)."""
    fp = np.asarray(batch.column("fp")).view(np.uint64)
    keys, kinds, owners = [], [], []
    for i in range(5):
        j = (i + 1) % 5
        both = np.uint64(_MASKS[i] | _MASKS[j])
        own = fp & both
        for bit in (None, *range(_SHIFTS[j], _SHIFTS[j] + WIDTHS[j])):
            off = own if bit is None else own ^ np.uint64(1 << bit)
            keys.append(_folded(off, i))
            kinds.append(np.full(len(fp), 0 if bit is None else 1, np.int8))
            owners.append(fp)
    return pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(kinds)), pa.array(np.concatenate(owners).view(np.int64))], ["key", "kind", "fp"])


def _folded(masked: np.ndarray, i: int) -> np.ndarray:
    """The two segments' bits and the segment's number in one long below 2 ** 29."""
    j = (i + 1) % 5
    a, b = (masked & np.uint64(_MASKS[i])) >> np.uint64(_SHIFTS[i]), (masked & np.uint64(_MASKS[j])) >> np.uint64(_SHIFTS[j])
    return ((np.uint64(i) << np.uint64(26)) | (a << np.uint64(13)) | b).astype(np.int64)


def chained(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chains from segment `start` stay in budget, then the full check."""
    differ = a ^ b
    masks = np.array(_MASKS, np.uint64)
    ok, so_far = np.ones(len(differ), bool), np.zeros(len(differ), np.int64)
    for l in range(1, 5):
        so_far += np.bitwise_count(differ & masks[(start + l - 1) % 5])
        ok &= so_far <= l * BITS // 5
    ok[ok] = np.bitwise_count(differ[ok]) <= BITS
    return ok


def _links(key: int, index: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the key connects: a forest over index, then one per probe and tree."""
    start = np.array([key >> 26])
    a, b = [], []
    tree = np.full(len(index), -1)
    for seed in range(len(index)):
        if tree[seed] >= 0:
            continue
        tree[seed], front = seed, [seed]
        while front:
            rest = np.flatnonzero(tree < 0)
            i = front.pop()
            near = rest[chained(np.broadcast_to(index[i], len(rest)), index[rest], start)]
            tree[near] = seed
            a.append(np.full(len(near), index[i], np.uint64))
            b.append(index[near])
            front += near.tolist()
    for i in range(0, len(probes), max(1, (1 << 20) // max(1, len(index)))):
        part = probes[i : i + max(1, (1 << 20) // max(1, len(index)))]
        p, q = np.divmod(np.arange(len(part) * len(index)), len(index))
        ok = chained(part[p], index[q], start)
        pairs = textkit.distinct(p[ok] * len(index) + tree[q[ok]])
        a.append(part[pairs // len(index)])
        b.append(index[pairs % len(index)])
    return (np.concatenate(a), np.concatenate(b)) if a else (index[:0], index[:0])


#: Rows of one unfinished group that are kept before its probes are worked off.
_WAITING = 200_000


def _compare(key: np.ndarray, cell: np.ndarray, kind: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the groups of rows sorted by key, cell, kind; small groups all at once."""
    if not len(key):
        return fp, fp
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
    sizes = np.diff(np.append(new, len(key)))
    first = np.add.reduceat((kind == 0).astype(np.int64), new)
    worth = (first > 0) & (sizes > 1)
    small = worth & (first * sizes <= 256)
    out = [(fp[:0], fp[:0])]
    for g in np.flatnonzero(worth & ~small):
        s = slice(new[g], new[g] + sizes[g])
        out.append(_links(int(key[new[g]]), fp[s][kind[s] == 0], fp[s][kind[s] == 1]))
    g = np.flatnonzero(small)
    pairs = first[g] * sizes[g]
    which = np.repeat(g, pairs)
    at = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    p, q = new[which] + at % first[which], new[which] + at // first[which]
    p, q = p[p < q], q[p < q]
    ok = chained(fp[p], fp[q], key[p] >> 26)
    out.append((fp[p[ok]], fp[q[ok]]))
    a, b = (np.concatenate(x) for x in zip(*out))
    return a, b


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each (key, cell) group; a group may go on over several batches."""
    rest = None
    for batch in batches:
        rows = [np.asarray(batch.column(c)) for c in ("key", "cell", "kind", "fp")]
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows)]
        key, cell, kind, fp = rows
        if not len(key):
            continue
        last = int(np.flatnonzero((key != key[-1]) | (cell != cell[-1]))[-1]) + 1 if (key[0], cell[0]) != (key[-1], cell[-1]) else 0
        rest = [x[last:] for x in rows]
        yield _as_links(_compare(key[:last], cell[:last], kind[:last], fp[:last].view(np.uint64)))
        if len(rest[0]) > _WAITING:
            yield _as_links(_compare(*rest[:3], rest[3].view(np.uint64)))
            rest = [x[rest[2] == 0] for x in rest]
    if rest is not None:
        yield _as_links(_compare(*rest[:3], rest[3].view(np.uint64)))


def _as_links(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in found], ["a", "b"])


def links(distinct: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (a, b) between fingerprints of `distinct` (fp), enough to connect all that are linked.

    A key with more than `cell` fingerprints is dealt in cells: each pair of its blocks
    meets in one, each probe meets every block, so that nothing is left out.
    """
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.select("fp").repartition(parts, "fp")  # stored rows may lie in few files; each becomes seventy
    keyed = arrow_map(spread, _ring_keys, "key long, kind byte, fp long")
    heavy = stored(keyed.filter("kind = 0").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > cell))
    if heavy.isEmpty():
        dealt = keyed.withColumn("cell", F.lit(0).cast("long"))
    else:
        blocks = F.ceil(F.col("n") / cell).cast("int")
        dealt = keyed.join(heavy, "key", "left").withColumn("blocks", F.coalesce(blocks, F.lit(1))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        low, high = F.least(own, "other"), F.greatest(own, "other")
        dealt = dealt.withColumn("cell", F.when(F.col("kind") == 0, low * F.col("blocks") + high).otherwise(F.col("other") * F.col("blocks") + F.col("other")).cast("long"))
    rows = dealt.select("key", "cell", "kind", "fp").repartition("key", "cell").sortWithinPartitions("key", "cell", "kind")
    return rows.mapInArrow(_group_links, "a long, b long")


def grouped(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs.

    Equal fingerprints are one node, so copies are never paired with each other. A row
    with a null id is linked like others but never names a component: one of such rows
    only has a null component_id. Repeated rows share their component, equal distances need
    no rule: all links within BITS count. Very long texts are read whole, other columns not.
    """
    prints = stored(fingerprints(docs))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, cell), "a", "b")
    named = stored(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined(named, least, "root").select("fp", "component_id")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return joined(prints, stored(named), "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """One document of each group: the rows of docs that name their component, all columns.

    Of several rows with one id the one with the least text stays (a null text comes
    first), of equal texts the one with the least hash of all columns. Rows with a null id
    cannot be named and stay. Input columns may have any name.
    """
    name, rows = fresh("id", docs), fresh("rows", docs)
    names = stored(grouped(docs, cell).filter("doc_id = component_id").groupBy(F.col("doc_id").alias(name)).agg(F.count("*").alias(rows)))
    kept = docs.join(names, docs["doc_id"] == names[name], "left").filter(F.col(name).isNotNull() | F.col("doc_id").isNull())
    if names.filter(F.col(rows) > 1).isEmpty():
        return kept.select(docs.columns)
    once = kept.filter(F.coalesce(rows, F.lit(1)) <= 1).select(docs.columns)
    whole = F.struct(*docs.columns)
    chosen = F.min_by(whole, F.struct("text", F.xxhash64(F.to_json(whole)))).alias("row")
    return once.unionByName(kept.filter(F.col(rows) > 1).groupBy(name).agg(chosen).select("row.*"))
