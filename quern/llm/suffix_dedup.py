"""Removal of byte strings that an earlier document has, by a distributed suffix sort.

A string of LENGTH bytes is found by the smallest hash among its GRAM-byte grams, its
anchor: equal strings have it at the same offset. Suffixes are therefore sorted at
anchors only, with the bytes before them as payload, and only where two documents share
the anchor's gram:

1. Documents are dealt into blocks and written as a bucketed table. Every block gives the
   digests of its grams as rows; a window over each digest tells which are shared.
2. Every block sorts its suffixes at shared anchors into runs, one for each range it sends
   to, and front-codes them: a suffix carries what it doesn't share with its predecessor.
   Ranges are cut at sampled splitters and, where there are many, dealt on by gram.
3. Runs are merged with loser trees. Contenders carry the prefix they share with the last
   winner, and a comparison starts behind it. With many blocks this takes several levels:
   a level merges the runs of some FANOUT neighbours and cuts the result for the next, so
   that the runs exchanged grow with the text and not with its square. In the last level
   the prefixes that neighbours share tell which strings around an anchor are equal.
4. Blocks gather the covered stretches of their documents.

Equal suffixes of one block are sent once, with the smallest id; the block itself covers
the others. So does each merge before the last with those of several blocks. A gram that very many documents share is dealt by whole strings instead,
so that no range grows with it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .common import arrow_map, bucketed, fresh, release

LENGTH, GRAM = 50, 20
#: Bytes of text in a block, about.
BLOCK = 4 << 20
#: Buckets of the table of blocks at most (Spark's own bound); a bucket may hold several blocks.
MOST_BUCKETS = 100_000
#: A gram that more documents share is dealt by whole strings.
HOT = 4096
#: Grams from which splitters are chosen, and splitters at most; both only balance.
SAMPLE, SPLITTERS = 65_536, 4096
#: Runs that one level merges, and ranges that it cuts a run into, at most about.
FANOUT = 512
#: Bits of a gram's digest. A clash only makes a suffix travel needlessly: at 100 TB of text
#: one in fifty.
_BITS = 48
_WIDE = 56  # bytes of a padded suffix, whole words


def anchors(data: np.ndarray, at: np.ndarray):
    """Position, first and last window, row and gram hash of every anchor of packed texts."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none.astype(np.uint64)
    up, down = textkit.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    grams = textkit.mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    bits = np.uint64(max(20, n.bit_length()))
    least = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    width, windows = 1, LENGTH - GRAM + 1
    while 2 * width <= windows:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if windows > width:
        least = np.minimum(least[: width - windows], least[windows - width :])
    stop = np.repeat(at[1:], np.diff(at))
    start = np.flatnonzero(np.arange(len(least)) + LENGTH <= stop[: len(least)])
    if not len(start):
        return none, none, none, none, none.astype(np.uint64)
    place = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    p = place[first]
    return p, start[first], start[np.append(first[1:], len(start)) - 1], np.searchsorted(at, p, "right") - 1, grams[p]


class Block:
    """The rows of one block in order of id and text, with their anchors."""

    def __init__(self, table: pa.Table, of_block: str = "block"):
        ids = pc.fill_null(table["doc_id"], (1 << 63) - 1).to_pylist()
        texts = pc.fill_null(table["text"].cast(pa.large_binary()), b"").to_pylist()
        self.number = table[of_block][0].as_py()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in self.order], np.int64)
        self.bytes = b"".join(texts[i] for i in self.order)
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(texts[i]) for i in self.order])]).astype(np.int64)

    def anchors(self):
        parts = []
        for i, j in textkit.pieces(self.at):
            base = self.at[i]
            p, lo, hi, row, h = anchors(self.data[base : self.at[j]], self.at[i : j + 1] - base)
            parts.append((p + base, lo + base, hi + base, row + i, h))
        return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]


def _digests(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _BITS)).astype(np.int64)


def _grams(table: pa.Table) -> pa.Table:
    """The distinct digests of a block's grams, and in how many documents each is (1, or more)."""
    block = Block(table)
    _, _, _, row, h = block.anchors()
    code = _digests(h)
    order = np.argsort(code, kind="stable")
    code, ids = code[order], block.ids[row[order]]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    alone = np.minimum.reduceat(ids, first) == np.maximum.reduceat(ids, first) if len(first) else first
    many = np.where(alone, 1, np.diff(np.append(first, len(code))))
    return pa.table({"code": code[first], "block": np.full(len(first), block.number, np.int32), "many": many.astype(np.int32)})


def _splitters(docs: DataFrame, count: int, parts: int) -> list[bytes]:
    """Grams that cut the order of suffixes in `parts` about equal ranges, from SAMPLE grams.

    They are taken from about SAMPLE / 32 documents and reach the driver; they balance the
    ranges and have no influence on what is found.
    """
    every = max(1, count * 32 // SAMPLE)
    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)

    def run(batch):
        data, at = textkit.packed(batch.column("text"))
        found = []
        for i, j in textkit.pieces(at):
            p, _, _, row, _ = anchors(data[at[i] : at[j]], at[i : j + 1] - at[i])
            n = np.bincount(row, minlength=j - i)
            nth = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
            chosen = p[nth % np.repeat(np.maximum(1, n // 32), n) == 0] + at[i]
            found += [data[k : k + GRAM].tobytes() for k in chosen.tolist()]
        return pa.record_batch([pa.array(found, pa.binary())], ["gram"]) if found else None

    sample = sorted(r[0] for r in arrow_map(some, run, "gram binary").limit(2 * SAMPLE).collect())
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []


def _zip(column: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(column).tobytes())


def _unzip(columns: pa.ChunkedArray) -> list[bytes]:
    return [zstandard.ZstdDecompressor().decompress(x) for x in columns.to_pylist()]


_PACKED = ("lcp", "size", "tails", "before", "lefts", "ids", "blocks", "rows", "places")
_RUN = "part int, range long, " + ", ".join(f"{c} binary" for c in _PACKED)
_COVER = "block int, rows binary, first binary, last binary"


def _common(strings: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes that each padded row shares with the one before."""
    out = np.zeros(len(strings), np.int64)
    for i in range(1, len(strings), 65_536):
        j = min(len(strings), i + 65_536)
        differ = strings[i:j] != strings[i - 1 : j - 1]
        shared = np.where(differ.any(1), differ.argmax(1), strings.shape[1])
        out[i:j] = np.minimum(shared, np.minimum(sizes[i:j], sizes[i - 1 : j - 1]))
    return out


def _gathered(data: np.ndarray, start: np.ndarray, sizes: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Rows of `width` bytes: data[start], data[start + step] ..., zeros behind `sizes` of them."""
    out = np.zeros((len(start), width), np.uint8)
    for k in range(width):
        own = np.flatnonzero(sizes > k)
        if not len(own):
            break
        out[own, k] = data[start[own] + k * step]
    return out


class _Suffixes:
    """Suffixes of one block at chosen places, sorted; each row is right, left, document.

    right: the bytes from a place on; left: those before it, nearest first.
    """

    def __init__(self, block: Block, place: np.ndarray, first: np.ndarray, last: np.ndarray, row: np.ndarray):
        size, before = last + LENGTH - place, place - first
        key = np.empty((len(place), 2 * LENGTH + 10), np.uint8)
        key[:, :LENGTH] = _gathered(block.data, place, size, LENGTH)
        key[:, LENGTH] = size
        key[:, LENGTH + 1 : 2 * LENGTH + 1] = _gathered(block.data, place - 1, before, LENGTH, -1)
        key[:, 2 * LENGTH + 1] = before
        ids = block.ids[row]
        key[:, 2 * LENGTH + 2 :] = (ids.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
        order = np.argsort(key.view(f"S{key.shape[1]}").ravel(), kind="stable")
        key = key[order]
        self.place, self.row, self.first, self.last, self.ids = place[order], row[order], first[order], last[order], ids[order]
        self.size, self.before = size[order], before[order]
        # equal strings: the smallest id stands for them, the others are covered by it
        new = np.ones(len(key), bool)
        new[1:] = (key[1:, : 2 * LENGTH + 2] != key[:-1, : 2 * LENGTH + 2]).any(1)
        least = self.ids[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else self.ids
        stays = self.ids == least
        self.covered = self.row[~stays], self.first[~stays], self.last[~stays]
        self.right, self.left = key[stays, :LENGTH], key[stays, LENGTH + 1 : 2 * LENGTH + 1]
        for name in ("place", "row", "ids", "size", "before"):
            setattr(self, name, getattr(self, name)[stays])

    def runs(self, block: Block, ranges: np.ndarray, fanout: int) -> list[tuple]:
        """One front-coded run for each of `ranges`, for the first of the merges of `fanout` blocks."""
        lcp = _common(self.right, self.size)
        starts = np.cumsum(self.before) - self.before
        lefts = self.left[np.arange(LENGTH) < self.before[:, None]]
        blocks = np.full(len(self.row), block.number, np.int32)
        return _coded(block.number // fanout, ranges, self.right, lcp, self.size, self.before, lefts, starts, self.ids, blocks, self.row, self.place - block.at[self.row])


def _coded(part, ranges, right, lcp, size, before, lefts, starts, ids, blocks, rows, places) -> list[tuple]:
    """Sorted suffixes dealt by range into runs, front-coded: common prefixes, then what each adds.

    lcp: bytes shared with the one before in the whole order; within a range, a suffix
    shares with its predecessor the least of those in between.
    """
    by, out = np.argsort(ranges, kind="stable"), []
    cuts = np.flatnonzero(np.concatenate([[True], ranges[by][1:] != ranges[by][:-1]])) if len(by) else by
    for a, b in zip(cuts, np.append(cuts[1:], len(by))):
        own = by[a:b]
        same = np.zeros(len(own), np.int64)
        if len(own) > 1:
            same[1:] = np.minimum.reduceat(lcp[: own[-1] + 1], own[:-1] + 1)
        column = np.arange(LENGTH)
        tails = right[own][:, :LENGTH][(column >= same[:, None]) & (column < size[own][:, None])]
        n = before[own]
        left = lefts[np.arange(n.sum()) + np.repeat(starts[own] - (np.cumsum(n) - n), n)]
        columns = (same.astype(np.uint8), size[own].astype(np.uint8), tails, n.astype(np.uint8), left)
        columns += (ids[own].astype("<i8"), blocks[own].astype("<i4"), rows[own].astype("<i4"), places[own].astype("<i4"))
        out.append((part, int(ranges[own[0]]), *map(_zip, columns)))
    return out


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names)


def _run_table(rows: list[tuple]) -> pa.Table:
    return _table(rows, ["part", "range", *_PACKED], [pa.int32(), pa.int64(), *[pa.binary()] * len(_PACKED)])


def _spread(strings: np.ndarray, ranges: int) -> np.ndarray:
    """A range for each whole string, by its bytes."""
    h = np.zeros(len(strings), np.uint64)
    for k in range(strings.shape[1]):
        h = h * np.uint64(0x100000001B3) + strings[:, k]
    return (textkit.mix(h) % np.uint64(ranges)).astype(np.int64)


def _suffix_runs(layout: "_Layout"):
    """Front-coded runs of the block's suffixes at shared anchors; what the block itself covers.

    Rows of runs have a range. Each block has a range below zero for its own covered
    windows, which use the columns rows, places (first) and ids (last).
    """
    width = layout.widths[0]

    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if table.num_rows and shared.num_rows:
            block = Block(table)
            p, lo, hi, row, h = block.anchors()
            code = _digests(h)
            known = np.asarray(shared["code"])
            order = np.argsort(known)
            known, is_hot = known[order], np.asarray(shared["hot"])[order]
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            found = known[at] == code
            hot, plain = np.flatnonzero(found & is_hot[at]), np.flatnonzero(found & ~is_hot[at])
            del h, code, known, at, found
            suffixes = _Suffixes(block, p[plain], lo[plain], hi[plain], row[plain])
            out = suffixes.runs(block, layout.by_order(suffixes.right) // width, layout.fanout)
            covered = [suffixes.covered]
            windows = hi[hot] - lo[hot] + 1
            start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows - lo[hot], windows)
            owner = np.repeat(row[hot], windows)
            del suffixes, p, lo, hi, row
            suffixes = _Suffixes(block, start, start, start, owner)
            out += suffixes.runs(block, layout.by_string(suffixes.right) // width, layout.fanout)
            covered.append(suffixes.covered)
            r, first, last = (np.concatenate(x) for x in zip(*covered))
            if len(r):
                base = block.at[r]
                own = {"ids": last - base, "rows": r, "places": first - base}
                out.append((block.number // layout.fanout, -1 - block.number, *(own[c].astype("<i4").tobytes() if c in own else b"" for c in _PACKED)))
        return _run_table(out)

    return run


def merged(words: list[list[int]], sizes: list[int], lcps: list[int], bounds: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """The order of sorted runs' strings and what each shares with the one before.

    words[k][i]: the k-th eight bytes of string i as a number; bounds: each run's strings.
    A loser tree: each contender knows how much it shares with the last winner (`known`),
    the one that shares more is the smaller, and only equals are compared, behind that.
    """
    n = 1 << max(0, (len(bounds) - 1).bit_length())
    now = [a if a < b else -1 for a, b in bounds] + [-1] * (n - len(bounds))
    ends = [b for _, b in bounds] + [0] * (n - len(bounds))
    known, losers = [0] * n, [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        i, j = now[a], now[b]
        if j < 0:
            return a, b
        if i < 0:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        k, most = known[a] >> 3, min(sizes[i], sizes[j])
        while k < len(words) and words[k][i] == words[k][j]:
            k += 1
        if k == len(words):
            same, less = most, sizes[i] <= sizes[j]
        else:
            x, y = words[k][i], words[k][j]
            same, less = (k << 3) + ((64 - (x ^ y).bit_length()) >> 3), x < y
            if same >= most:
                same, less = most, sizes[i] <= sizes[j]
        if less:
            known[b] = same
            return a, b
        known[a] = same
        return b, a

    winners = list(range(n)) * 2
    for node in range(n - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node] if 2 * node < n else 2 * node - n, winners[2 * node + 1] if 2 * node + 1 < n else 2 * node + 1 - n)
    top = winners[1] if n > 1 else 0
    order, shared = [], []
    while (i := now[top]) >= 0:
        order.append(i)
        shared.append(known[top])
        i += 1
        if i < ends[top]:
            now[top], known[top] = i, lcps[i]
        else:
            now[top] = -1
        node = (top + n) >> 1
        while node:
            top, losers[node] = play(top, losers[node])
            node >>= 1
    return order, shared


class _Merged:
    """The suffixes of several runs in order, with what each shares with the one before."""

    def __init__(self, table: pa.Table):
        raw = {c: _unzip(table[c]) for c in _PACKED}
        right, bounds = [], []
        for lcp, size, tails in zip(raw["lcp"], raw["size"], raw.pop("tails")):
            at, last, begin = 0, b"", len(right)
            for k, n in zip(lcp, size):
                last = last[:k] + tails[at : at + n - k]
                at += n - k
                right.append(last)
            bounds.append((begin, len(right)))
        padded = np.frombuffer(b"".join(r.ljust(_WIDE, b"\0") for r in right), np.uint8).reshape(-1, _WIDE)
        sizes = np.array([len(r) for r in right])
        del right
        lcps = np.frombuffer(b"".join(raw["lcp"]), np.uint8).tolist()
        order, shared = merged([w.tolist() for w in padded.view(">u8").astype(np.uint64).T], sizes.tolist(), lcps, bounds)
        order = np.array(order, np.int64)
        joined = lambda name, kind: np.frombuffer(b"".join(raw[name]), kind)[order]
        self.shared, self.right, self.size = np.array(shared, np.int64), padded[order], sizes[order]
        self.ids, self.blocks, self.rows = joined("ids", "<i8"), joined("blocks", "<i4"), joined("rows", "<i4")
        self.places, self.before = joined("places", "<i4").astype(np.int64), joined("before", np.uint8).astype(np.int64)
        lengths = np.frombuffer(b"".join(raw["before"]), np.uint8).astype(np.int64)
        self.lefts, self.starts = np.frombuffer(b"".join(raw["lefts"]), np.uint8), (np.cumsum(lengths) - lengths)[order]


class _Layout:
    """Where suffixes go: `count` ranges by order, as many by whole string, and the levels of the merge.

    Range r of a level's runs is range r // width of the last level. Ranges of whole strings
    begin at `base`, where a new one begins in every level.
    """

    def __init__(self, blocks: int, fanout: int, splitters: list[bytes]):
        self.bounds = np.array(splitters, f"S{GRAM}")
        self.deal = max(1, math.ceil(blocks / (len(splitters) + 1)))
        self.count = (len(splitters) + 1) * self.deal
        self.levels = max(1, math.ceil(math.log(blocks) / math.log(fanout)))
        self.fanout = max(2, math.ceil(blocks ** (1 / self.levels)))
        self.widths = [self.fanout ** (self.levels - 1 - k) for k in range(self.levels)]
        self.base = math.ceil(self.count / self.widths[0]) * self.widths[0]

    def by_order(self, right: np.ndarray) -> np.ndarray:
        """By the splitters, and within these by the gram."""
        grams = np.ascontiguousarray(right[:, :GRAM])
        coarse = np.searchsorted(self.bounds, grams.view(f"S{GRAM}").ravel(), "right")
        return coarse * self.deal + _spread(grams, self.deal) if self.deal > 1 else coarse

    def by_string(self, right: np.ndarray) -> np.ndarray:
        return self.base + _spread(right[:, :LENGTH], self.count)


def _alike(m: _Merged) -> np.ndarray:
    """A number for each merged suffix, equal for those with the same bytes before and from their anchors."""
    right = np.cumsum((m.shared < m.size) | (m.size != np.roll(m.size, 1)) | (np.arange(len(m.size)) == 0))
    hashes = m.before.astype(np.uint64)
    for j in range(int(m.before.max(initial=0))):
        has = m.before > j
        hashes[has] = hashes[has] * np.uint64(0x100000001B3) + m.lefts[m.starts[has] + j] + np.uint64(1)
    return textkit.mix(right.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + textkit.mix(hashes))


def _told(m: _Merged, part: int) -> tuple[np.ndarray, list[tuple]]:
    """Which suffixes go on to the next level, and what is covered already: rows of runs with a range below zero.

    Of equal strings those of the smallest id stand for all: whatever another document
    shares with one of the others it shares with them. So a string in every block leaves
    a merge once, however many runs it came in with.
    """
    alike = _alike(m)
    by = np.argsort(alike, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], alike[by][1:] != alike[by][:-1]])) if len(by) else by
    least = np.empty(len(by), np.int64)
    if len(by):
        least[by] = np.repeat(np.minimum.reduceat(m.ids[by], first), np.diff(np.append(first, len(by))))
    gone, out = np.flatnonzero(m.ids > least), []
    gone = gone[np.argsort(m.blocks[gone], kind="stable")]
    for own in np.split(gone, np.flatnonzero(np.diff(m.blocks[gone])) + 1) if len(gone) else ():
        start = m.places[own] - m.before[own]
        columns = {"ids": m.places[own] + m.size[own] - LENGTH, "rows": m.rows[own], "places": start}
        out.append((part, -1 - int(m.blocks[own[0]]), *(columns[c].astype("<i4").tobytes() if c in columns else b"" for c in _PACKED)))
    return np.flatnonzero(m.ids <= least), out


def _merged_level(layout: _Layout, level: int):
    """One run of several neighbours', cut anew for the next level, and what these cover of each other."""
    above, width = layout.widths[level - 1], layout.widths[level]

    def run(key, table):
        part, at = (k.as_py() for k in key)
        part //= layout.fanout
        if at < 0:  # what blocks cover by themselves
            return table.set_column(0, "part", pa.array([part] * table.num_rows, pa.int32()))
        m = _Merged(table)
        stays, told = _told(m, part)
        # What a suffix shares with the last one that stays is the least of those in between.
        shared = np.minimum.reduceat(m.shared[: stays[-1] + 1], np.append(0, stays[:-1] + 1)) if len(stays) else stays
        right = m.right[stays]
        ranges = layout.by_order(right) if at * above < layout.base else layout.by_string(right)
        rest = (x[stays] for x in (m.size, m.before))
        return _run_table(_coded(part, ranges // width, right, shared, *rest, m.lefts, m.starts[stays], m.ids[stays], m.blocks[stays], m.rows[stays], m.places[stays]) + told)

    return run


def _merged_range(table: pa.Table) -> pa.Table:
    """Windows of the range's suffixes that an earlier document has, by block."""
    at = table["range"][0].as_py()
    if at < 0:  # what a block covers by itself
        block = pa.array([-1 - at] * table.num_rows, pa.int32())
        return pa.table([block, table["rows"], table["places"], table["ids"]], ["block", "rows", "first", "last"])
    m = _Merged(table)
    shared, ids, rows, places, before, blocks, sizes = m.shared, m.ids, m.rows, m.places, m.before, m.blocks, m.size
    # the bytes before each anchor, nearest first
    lefts, starts = m.lefts, m.starts
    found = []
    hashes = np.zeros(len(ids), np.uint64)
    for j in range(int(before.max(initial=0)) + 1):
        if j:
            has = before >= j
            hashes[has] = hashes[has] * np.uint64(0x100000001B3) + lefts[starts[has] + j - 1] + np.uint64(1)
        within = np.flatnonzero((before >= j) & (sizes >= LENGTH - j))
        if not len(within):
            continue
        group = np.cumsum(shared < LENGTH - j)[within]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, len(group)))
        several = np.repeat(size > 1, size)
        within, group = within[several], group[several]
        if not len(within):
            continue
        key = textkit.mix(group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + textkit.mix(hashes[within] + np.uint64(1)))
        by = np.argsort(key)
        first = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        least = np.empty(len(by), np.int64)
        least[by] = np.repeat(np.minimum.reduceat(ids[within][by], first), np.diff(np.append(first, len(by))))
        hit = within[ids[within] > least]
        found.append((blocks[hit], rows[hit], places[hit] - j))
    out = []
    if found:
        b, r, s = (np.concatenate(x).astype(np.int64) for x in zip(*found))
        by = np.lexsort((s, r, b))
        b, r, s = b[by], r[by], s[by]
        cut = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (r[1:] != r[:-1]) | (s[1:] > s[:-1] + 1)]))[: len(b)]
        last = np.append(cut[1:], len(b))[: len(cut)] - 1
        b, r, s, e = b[cut], r[cut], s[cut], s[last]
        for number in np.unique(b):
            own = b == number
            out.append((int(number), r[own].astype("<i4").tobytes(), s[own].astype("<i4").tobytes(), e[own].astype("<i4").tobytes()))
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], ["block", "rows", "first", "last"])


def _removed(block: Block, covers: pa.Table) -> np.ndarray:
    """Which bytes of the block's texts are covered."""
    depth = np.zeros(len(block.data) + 1, np.int32)
    for rows, first, last in zip(*(covers[c].to_pylist() for c in ("rows", "first", "last"))):
        base = block.at[np.frombuffer(rows, "<i4")]
        np.add.at(depth, base + np.frombuffer(first, "<i4"), 1)
        np.add.at(depth, base + np.frombuffer(last, "<i4") + LENGTH, -1)
    return np.cumsum(depth[:-1]) > 0


def _digest_rows(table: pa.Table, covers: pa.Table) -> pa.Table:
    block = Block(table) if table.num_rows else None
    out: list[tuple] = []
    if block is not None:
        gone = _removed(block, covers)
        rises = gone.copy()
        rises[1:] &= ~gone[:-1]
        starts = block.at[:-1][block.at[:-1] < len(gone)]
        rises[starts] = gone[starts]
        counts = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, rises)]
        kept, left = block.data[~gone].tobytes(), block.at - counts[0][block.at]
        ids = table["doc_id"].to_pylist()
        for k, i in enumerate(block.order):
            a, b = block.at[k], block.at[k + 1]
            out.append((ids[i], int(b - a), int(counts[0][b] - counts[0][a]), int(counts[1][b] - counts[1][a]), hashlib.sha256(kept[left[k] : left[k + 1]]).hexdigest()))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _text_rows(names: list[str], of_block: str):
    def run(table: pa.Table, covers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.select(names)
        block = Block(table, of_block)
        gone = _removed(block, covers)
        counts = np.concatenate([[0], np.cumsum(gone)])
        kept, left = block.data[~gone].tobytes(), block.at - counts[block.at]
        texts: list[str | None] = [None] * table.num_rows
        for k, i in enumerate(block.order):
            if table["text"][i].is_valid:
                texts[i] = kept[left[k] : left[k + 1]].decode("utf-8", "ignore")
        at = table.schema.get_field_index("text")
        return table.set_column(at, "text", pa.array(texts, table.schema.field(at).type)).select(names)

    return run


def _covered(docs: DataFrame, hot: int, fanout: int, size: int) -> tuple[DataFrame, str, DataFrame]:
    """docs as a table bucketed by block, the name of its column of blocks, and the covered windows of each block."""
    spark, name = docs.sparkSession, fresh("block", docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, parts, math.ceil(total / size))
    # the partition spreads rows that repeat very often
    block = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int")
    table = bucketed(docs.withColumn(name, block), name, min(blocks, MOST_BUCKETS))
    release(spark)
    narrow = _narrow(table, name)
    grams = narrow.groupBy("block").applyInArrow(_grams, "code long, block int, many int")
    shared = grams.withColumn("total", F.sum("many").over(Window.partitionBy("code"))).filter("total > 1").select("block", "code", (F.col("total") > hot).alias("hot"))
    layout = _Layout(blocks, fanout, _splitters(narrow, count, min(blocks, SPLITTERS)))
    runs = narrow.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_suffix_runs(layout), _RUN)
    for level in range(1, layout.levels):
        runs = runs.groupBy("part", "range").applyInArrow(_merged_level(layout, level), _RUN)
    return table, name, runs.groupBy("range").applyInArrow(_merged_range, _COVER)


def _narrow(table: DataFrame, name: str) -> DataFrame:
    return table.select(F.col(name).alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def removed(docs: DataFrame, hot: int = HOT, fanout: int = FANOUT, size: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs.

    A null text counts as empty. Rows with one id are parts of one document: they never
    cover each other. A null id counts as larger than any other. Very long texts are read
    whole, other columns not at all. The result does not depend on `hot`, `fanout` (runs
    merged at once) and `size` (bytes of a block).
    """
    table, name, covers = _covered(docs.select("doc_id", "text"), hot, fanout, size)
    return _narrow(table, name).groupBy("block").cogroup(covers.groupBy("block")).applyInArrow(_digest_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, hot: int = HOT, fanout: int = FANOUT, size: int = BLOCK) -> DataFrame:
    """The rows of docs with covered bytes removed from `text`; other columns unchanged.

    A character that loses some of its bytes goes; null texts stay null. Ids and options as
    for `removed`; input columns may have any name.
    """
    table, name, covers = _covered(docs, hot, fanout, size)
    return table.groupBy(name).cogroup(covers.groupBy("block")).applyInArrow(_text_rows(docs.columns, name), docs.schema)
