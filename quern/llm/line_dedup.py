"""Removal of lines that many documents have, by a sharded minimal perfect hash.

1. Documents are read in blocks; a block keeps its documents' ids and the 128-bit digests
   of their lines' keys. Blocks are small beside the texts and are stored.
2. Digests are dealt into shards. A shard gathers its distinct digests, each with the
   largest ids of documents that have it, and builds its part of the index: bit arrays,
   level by level, which give each digest a slot of its own without storing it (keys
   that collide in one level go to the next); and by slot a short fingerprint and the
   number of documents, with the largest id for those slots alone that count.
3. Blocks probe the arrays: each distinct digest of a block once, sent to its shard. Only
   digests that lines are dropped for are answered.
4. Blocks turn the answers into the digests to drop, document by document, and documents
   with any meet these by id and hash of the text.

A line that a third of all documents have is one probe a block, and one slot. The number
of blocks and shards grows with the lines, their sizes don't.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import fresh, stored

#: A key has so many code points at least, and so many documents with it make it go.
LEAST_CHARS, LEAST_DOCUMENTS = 20, 3
#: Digests of a block (one document's at least) and, about, of a shard.
BLOCK, SHARD = 1 << 18, 1 << 20
#: Digests that a task gathers before it sends what it has.
GATHERED = 1 << 21
#: Bits of a level for each key that comes to it.
GAMMA = 2
#: The id that stands for a null one.
NO_ID = -(1 << 63)

_BLOCKS = "block long, ids array<long>, h array<long>, g array<int>, sizes array<int>, digests binary"
_INDEX = "shard long, levels array<long>, bits binary, fingerprints binary, counts binary, owners binary"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


# Lines ---------------------------------------------------------------------------------


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all lines of packed texts; starts and ends of their stripped keys, and the keys' code points."""
    breaks = np.flatnonzero(data == 10)
    starts, ends = np.sort(np.concatenate([at[:-1], breaks + 1])), np.sort(np.concatenate([breaks, at[1:]]))
    rows = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(breaks, at)) + 1)
    ink = np.flatnonzero(~_SPACE[data])
    first, last = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
    some = first < last
    key_starts, key_ends = starts.copy(), starts.copy()
    key_starts[some], key_ends[some] = ink[first[some]], ink[last[some] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return starts, ends, rows, key_starts, key_ends, points[key_ends] - points[key_starts]


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """128-bit digests of byte ranges, A-Z in lower case."""
    lower = data.tobytes().lower()
    return [xxhash.xxh3_128_digest(lower[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]


def _halves(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(joined, np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _block(number: int, documents: list[tuple]) -> pa.RecordBatch:
    ids, h, g, found = zip(*documents)
    columns = [[number], [ids], [h], [g], [[len(x) for x in found]], [b"".join(d for x in found for d in x)]]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in _BLOCKS.split(", ")])


def _keyed(docs: DataFrame, names=("doc_id", "h", "g")) -> DataFrame:
    """docs with the columns that name a row's content: its id (NO_ID for null) and two hashes of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(dict(zip(names, (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(text), F.hash(text)))))


def blocks(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row a block: ids and hashes of its documents, how many digests each has, and these (each once a document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ids, h, g = (batch.column(c).to_pylist() for c in ("doc_id", "h", "g"))
            data, at = textkit.packed(batch.column("text"))
            for i, j in textkit.pieces(at):
                base, part = at[i], data[at[i] : at[j]]
                _, _, rows, a, b, points = lines(part, at[i : j + 1] - base)
                long = points >= least_chars
                found, ends = digests(part, a[long], b[long]), np.searchsorted(rows[long], np.arange(j - i + 1))
                for d in range(j - i):
                    own = sorted(set(found[ends[d] : ends[d + 1]]))
                    held.append((ids[i + d], h[i + d], g[i + d], own))
                    size += len(own)
                    if size >= BLOCK or len(held) >= BLOCK:
                        yield _block(number, held)
                        number, held, size = number + 1, [], 0
        if held:
            yield _block(number, held)

    named = _keyed(docs.select("doc_id", "text"))
    return named.select("doc_id", "h", "g", "text").mapInArrow(run, _BLOCKS)


# The index -----------------------------------------------------------------------------


def largest(hi: np.ndarray, lo: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `most` largest distinct ids of each distinct digest, the largest first."""
    order = np.lexsort((~ids, lo, hi))
    hi, lo, ids = hi[order], lo[order], ids[order]
    if not len(hi):
        return hi, lo, ids
    new = np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
    once = new | np.concatenate([[True], ids[1:] != ids[:-1]])
    hi, lo, ids, new = hi[once], lo[once], ids[once], new[once]
    place = np.arange(len(hi)) - np.maximum.accumulate(np.where(new, np.arange(len(hi)), 0))
    return hi[place < most], lo[place < most], ids[place < most]


def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    odd = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & (2**64 - 1))
    return (textkit.mix(hi + textkit.mix(lo ^ odd)) % np.uint64(size)).astype(np.int64)


def _fingerprints(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return (textkit.mix(lo + textkit.mix(~hi)) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """A minimal perfect hash of distinct digests, with arrays by slot."""

    def __init__(self, levels: np.ndarray, bits: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray, owners: np.ndarray, least: int):
        self.levels, self.bits, self.fingerprints, self.counts, self.owners, self.least = levels, bits, fingerprints, counts, owners, least
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])
        self.owned = np.concatenate([[0], np.cumsum(counts >= least)])

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray, ids: np.ndarray, least: int) -> Shard:
        """The index of digests with their largest ids, as `largest` gives them: a slot with `least` ids counts."""
        new = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, np.int64)
        number = np.diff(np.append(new, len(hi)))
        hi, lo, ids = hi[new], lo[new], ids[new]
        rest, levels, bits = np.arange(len(hi)), [], []
        while len(rest):
            size = 64 * -(-GAMMA * len(rest) // 64)
            place = _place(hi[rest], lo[rest], len(levels), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            level = np.zeros(size, np.uint8)
            level[place[alone]] = 1
            bits.append(np.packbits(level, bitorder="little").view(np.uint64))
            levels.append(size)
            rest = rest[~alone]
        empty = cls(np.array(levels, np.int64), np.concatenate([np.zeros(0, np.uint64), *bits]), np.zeros(len(hi), np.uint32), np.zeros(len(hi), np.uint8), np.zeros(0, np.int64), least)
        slot = empty.slots(hi, lo)
        fingerprints, counts, owners = np.zeros(len(hi), np.uint32), np.zeros(len(hi), np.uint8), np.zeros(len(hi), np.int64)
        fingerprints[slot], counts[slot], owners[slot] = _fingerprints(hi, lo), np.minimum(number, 255), ids
        return cls(empty.levels, empty.bits, fingerprints, counts, owners[counts >= least], least)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1, or any slot, for digests that are not in the index."""
        out, rest, base = np.full(len(hi), -1), np.arange(len(hi)), 0
        for level, size in enumerate(self.levels.tolist()):
            place = base + _place(hi[rest], lo[rest], level, size)
            word, below = self.bits[place >> 6], (place & 63).astype(np.uint64)
            there = (word >> below) & np.uint64(1) == 1
            before = word & ((np.uint64(1) << below) - np.uint64(1))
            out[rest[there]] = (self.ranks[place >> 6] + np.bitwise_count(before))[there]
            rest, base = rest[~there], base + size
        return out

    def owner(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which digests count, and the largest id of those that do.

        Exact for digests that the index was built from; of others one in 2**32 may pass
        for one of them.
        """
        slot = self.slots(hi, lo)
        known = slot >= 0
        known[known] = self.fingerprints[slot[known]] == _fingerprints(hi[known], lo[known])
        known[known] = self.counts[slot[known]] >= self.least
        return known, self.owners[self.owned[slot[known]]]

    def stored(self, number: int) -> pa.Table:
        arrays = (self.bits, self.fingerprints, self.counts, self.owners)
        return pa.table([pa.array([number]), pa.array([self.levels.tolist()], pa.list_(pa.int64())), *(pa.array([a.tobytes()]) for a in arrays)], [c.split()[0] for c in _INDEX.split(", ")])

    @classmethod
    def read(cls, table: pa.Table, least: int) -> Shard:
        types = (("bits", np.uint64), ("fingerprints", np.uint32), ("counts", np.uint8), ("owners", np.int64))
        return cls(np.array(table["levels"][0].as_py(), np.int64), *(np.frombuffer(table[c][0].as_py(), t) for c, t in types), least)


def _as_table(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.asarray(table[c]).view(np.uint64) for c in ("hi", "lo"))


def index(held: DataFrame, shards: int, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """One row a shard of all distinct digests of the blocks `held`. Counts are told up to `least` (255 at most)."""
    if not 1 <= least <= 255:
        raise ValueError("least must be within 1 and 255")

    def gather(batches):
        hi, lo, ids = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def sent():
            for a in range(0, len(hi), 100_000):
                s = slice(a, a + 100_000)
                yield pa.record_batch([pa.array((hi[s] % np.uint64(shards)).astype(np.int64)), *(pa.array(x[s].view(np.int64)) for x in (hi, lo, ids))], ["shard", "hi", "lo", "id"])

        for batch in batches:
            for number, sizes, joined in zip(*(batch.column(c).to_pylist() for c in ("ids", "sizes", "digests"))):
                a, b = _halves(joined)
                hi, lo, ids = largest(np.concatenate([hi, a]), np.concatenate([lo, b]), np.concatenate([ids, np.repeat(np.array(number, np.int64), sizes)]), least)
                if len(hi) > GATHERED:
                    yield from sent()
                    hi, lo, ids = hi[:0], lo[:0], ids[:0]
        yield from sent()

    def build(key, table):
        return Shard.of(*largest(*_as_table(table), np.asarray(table["id"]), least), least).stored(key[0].as_py())

    rows = held.select("ids", "sizes", "digests").mapInArrow(gather, "shard long, hi long, lo long, id long")
    return rows.groupBy("shard").applyInArrow(build, _INDEX)


def probed(held: DataFrame, found: DataFrame, shards: int, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """block, digest, owner: the digests of each block that enough documents have, and the largest id with each."""

    def ask(batches):
        for batch in batches:
            for block, joined in zip(batch.column("block").to_pylist(), batch.column("digests").to_pylist()):
                hi, lo, _ = largest(*_halves(joined), np.zeros(len(joined) // 16, np.int64), 1)
                for a in range(0, len(hi), 100_000):
                    s = slice(a, a + 100_000)
                    shard = (hi[s] % np.uint64(shards)).astype(np.int64)
                    yield pa.record_batch([pa.array(shard), pa.array(np.full(len(shard), block)), *(pa.array(x[s].view(np.int64)) for x in (hi, lo))], ["shard", "block", "hi", "lo"])

    def answer(asked, shard):
        if not (asked.num_rows and shard.num_rows):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.int64())], ["block", "digest", "owner"])
        hi, lo = _as_table(asked)
        known, owner = Shard.read(shard, least).owner(hi, lo)
        joined = np.stack([hi[known], lo[known]], 1).tobytes()
        return pa.table([asked["block"].filter(pa.array(known)), pa.array([joined[i : i + 16] for i in range(0, len(joined), 16)], pa.binary()), pa.array(owner)], ["block", "digest", "owner"])

    rows = held.select("block", "digests").mapInArrow(ask, "shard long, block long, hi long, lo long")
    return rows.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(answer, "block long, digest binary, owner long")


def decisions(docs: DataFrame, least_chars: int = LEAST_CHARS, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, h, g, drop: for each content that loses lines, the digests of these (16 bytes each, joined)."""
    held = stored(blocks(docs, least_chars))
    n = held.agg(F.sum(F.octet_length("digests").cast("long"))).first()[0] or 0
    shards = max(1, math.ceil(n / 16 / SHARD))
    answers = probed(held, stored(index(held, shards, least)), shards, least)

    def decide(block, answers):
        owner = dict(zip(answers["digest"].to_pylist(), answers["owner"].to_pylist()))
        out = []
        for ids, h, g, sizes, joined in zip(*(block[c].to_pylist() for c in ("ids", "h", "g", "sizes", "digests"))) if owner else ():
            at = 0
            for i, a, b, size in zip(ids, h, g, sizes):
                own = (joined[x : x + 16] for x in range(at, at + 16 * size, 16))
                if drop := b"".join(d for d in own if owner.get(d, i) != i):
                    out.append((i, a, b, drop))
                at += 16 * size
        columns = zip(*out) if out else ([], [], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["doc_id", "h", "g", "drop"])

    rows = held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(decide, "doc_id long, h long, g int, drop binary")
    return rows.groupBy("doc_id", "h", "g").agg(F.first("drop").alias("drop"))  # equal rows lose the same


# Documents -----------------------------------------------------------------------------


def cut(texts: list[bytes], drops: list[bytes | None], least_chars: int = LEAST_CHARS) -> list[tuple[bytes, int, int]]:
    """What is left of each text, its number of lines before, and how many of them went."""
    out = [(t, t.count(b"\n") + 1, 0) for t in texts]
    some = [i for i, d in enumerate(drops) if d]
    data, at = textkit.packed(pa.array([texts[i] for i in some], pa.large_binary()))
    for i, j in textkit.pieces(at):
        part = data[at[i] : at[j]]
        starts, ends, rows, a, b, points = lines(part, at[i : j + 1] - at[i])
        ranges, long = np.searchsorted(rows, np.arange(j - i + 1)), points >= least_chars
        found = iter(digests(part, a[long], b[long]))
        for d in range(j - i):
            text, drop, base = texts[some[i + d]], drops[some[i + d]], starts[ranges[d]]
            gone = {drop[x : x + 16] for x in range(0, len(drop), 16)}
            own = slice(ranges[d], ranges[d + 1])
            kept = [text[s:e] for s, e, l in zip((starts[own] - base).tolist(), (ends[own] - base).tolist(), long[own].tolist()) if not (l and next(found) in gone)]
            n = int(ranges[d + 1] - ranges[d])
            out[some[i + d]] = b"\n".join(kept), n, n - len(kept)
    return out


def _met(docs: DataFrame, least_chars: int, least: int, names: tuple[str, str, str], drop: str) -> DataFrame:
    """docs with the columns `names` and, where lines go, `drop`."""
    made = decisions(docs.select("doc_id", "text"), least_chars, least)
    made = made.select(*(F.col(c).alias(f"{n}_") for c, n in zip(("doc_id", "h", "g"), names)), F.col("drop").alias(drop))
    rows = _keyed(docs, names)
    return rows.join(made, [rows[n] == made[f"{n}_"] for n in names], "left").drop(*(f"{n}_" for n in names))


def dropped(docs: DataFrame, least_chars: int = LEAST_CHARS, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs.

    Keys (stripped lines, A-Z in lower case) of at least `least_chars` code points in at
    least `least` documents lose all their lines but for those in the document with the
    largest id. Rows with one id are one document; those with a null id are one whose id
    is the smallest. Repeated rows each give a row. A null or empty text is one empty
    line; a text that loses all lines is empty. Very long texts are read whole, other
    columns not; an empty table gives an empty one.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            kept, n, gone = zip(*cut(texts, batch.column("drop").to_pylist(), least_chars))
            shas = [hashlib.sha256(t).hexdigest() for t in kept]
            yield pa.record_batch([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = _met(rows, least_chars, least, ("key", "h", "g"), "drop").select(F.col("doc_id").alias("id"), "text", "drop")
    return met.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """docs with the lines gone from their texts, all other columns as they are; a null text stays null. See `dropped`."""
    names = tuple(fresh(n, docs) for n in ("key__", "h__", "g__"))
    drop = fresh("drop__", docs)
    columns = docs.columns

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            kept = [t for t, _, _ in cut(texts, batch.column(drop).to_pylist(), least_chars)]
            left = pa.array([k.decode() for k in kept], batch.schema.field("text").type, mask=np.asarray(batch.column("text").is_null()))
            yield pa.record_batch([left if c == "text" else batch.column(c) for c in columns], columns)

    met = _met(docs, least_chars, least, names, drop).select(*columns, drop)
    return met.mapInArrow(run, docs.schema)
