"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the tokens of a window and ignore the others, so a seed still
matches after a substitution at an ignored position. Seeds of the documents join those
of the benchmark, and the overlap around each hit is verified token by token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import Bitmap, arrays, arrow_map, fresh, stored

#: Positions of a window that count (fixed values; six tokens each).
MASKS = ("111010011", "1101100101", "1100101011", "10110010011")
#: Tokens of an overlap at least (an item with fewer must be whole), and the share that must agree.
LEAST_TOKENS, SIMILARITY = 13, 0.8
#: Tokens of context kept before the first and behind the last of neighbouring hits. Where
#: an item that overlaps goes on beyond them, the whole text is read again.
REACH = 64
#: Items that share a seed from which on it is common: its items and stretches meet in
#: blocks of so many each, compared as arrays, and only pairs that overlap become rows.
COMMON, BLOCK = 32, 2048
#: Tokens compared at once in such a block.
_CELLS = 1 << 21

_OFFSETS = [np.flatnonzero([c == "1" for c in m]) for m in MASKS]
_ODD = [np.uint64(pow(0xD1B54A32D192ED03, 2 * i + 1, 1 << 64)) for i in range(16)]


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts, packed."""
    return textkit.packed(pc.utf8_lower(column.cast(pa.large_string())))


def word_tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters, digits, non-ASCII) and where each row starts."""
    kinds = textkit.CLASSES[data]
    starts, ends, rows = textkit.runs(np.where(kinds == textkit.WORD, kinds, 0), at)
    return textkit.run_hashes(data, starts, ends), np.searchsorted(rows, np.arange(len(at)))


def seeds(tokens: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mask the window starts that stay within a row, and the seeds there."""
    found, n = [], len(tokens)
    stop = np.repeat(at[1:], np.diff(at))
    for k, (mask, offsets) in enumerate(zip(MASKS, _OFFSETS)):
        m = n - len(mask) + 1
        if m <= 0:
            found.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
            continue
        start = np.flatnonzero(np.arange(m) + len(mask) <= stop[:m])
        h = np.full(len(start), k + 1, np.uint64)
        for i, o in enumerate(offsets):
            h += tokens[start + o] * _ODD[i]
        found.append((start, textkit.mix(h)))
    return found


def _content(tokens: str):
    """128 bits that stand for an array of tokens."""
    return F.concat_ws(":", F.xxhash64(tokens), F.xxhash64(F.lit(1), tokens))


def _by_seed(seed: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct seeds, where the positions of each begin, and the positions."""
    order = np.lexsort((pos, seed))
    seed, pos = seed[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]])) if len(seed) else np.zeros(0, np.int64)
    return seed[first], first, pos


class _Lists:
    """Gathers (seeds, positions of each seed) row by row, as columns of lists."""

    def __init__(self):
        self.seeds, self.rows, self.starts, self.at, self.n = [], [0], [], [], 0

    def add(self, seed: np.ndarray, pos: np.ndarray) -> None:
        seeds, first, pos = _by_seed(seed, pos)
        self.seeds.append(seeds.view(np.int64))
        self.rows.append(self.rows[-1] + len(seeds))
        self.starts.append(first + self.n)
        self.at.append(pos.astype(np.int32))
        self.n += len(pos)

    def columns(self) -> list[pa.Array]:
        inner = pa.ListArray.from_arrays(pa.array(np.append(np.concatenate(self.starts), self.n).astype(np.int32)), pa.array(np.concatenate(self.at)))
        rows = pa.array(self.rows, pa.int32())
        return [pa.ListArray.from_arrays(rows, pa.array(np.concatenate(self.seeds))), pa.ListArray.from_arrays(rows, inner)]


def item_tokens(items: DataFrame) -> DataFrame:
    """item_id, item (hashes of its words), itag (stands for these) of every item."""

    def run(batch):
        data, at = packed(batch.column("text"))
        tokens, rows = word_tokens(data, at)
        lists = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(tokens.view(np.int64)))
        return pa.record_batch([batch.column("item_id"), lists], ["item_id", "item"])

    return arrow_map(items, run, "item_id long, item array<long>").withColumn("itag", _content("item"))


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """itag, seed, pos (all its window starts) of each item (itag, item)."""

    def run(batch):
        column, tags, lists = batch.column("item"), [], _Lists()
        for i in range(batch.num_rows):
            tokens = np.asarray(column[i].values).view(np.uint64)
            start, seed = (np.concatenate(x) for x in zip(*seeds(tokens, np.array([0, len(tokens)]))))
            if len(start):
                tags.append(batch.column("itag")[i].as_py())
                lists.add(seed, start)
        return pa.record_batch([pa.array(tags, pa.string()), *lists.columns()], ["itag", "seeds", "at"]) if tags else None

    rows = arrow_map(items.select("itag", "item"), run, "itag string, seeds array<long>, at array<array<int>>")
    return rows.select("itag", F.explode(F.arrays_zip("seeds", "at")).alias("s")).select("itag", F.col("s.seeds").alias("seed"), F.col("s.at").alias("pos"))


def hit_regions(docs: DataFrame, known: Bitmap) -> DataFrame:
    """doc_id, h, start, more, tokens, seeds, at of the stretches of documents around seeds that may be known.

    h: a hash of the text; more: whether it goes on behind the stretch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)  # 16 MB at most

    def run(batch):
        data, at = packed(batch.column("text"))
        ids, hashes = np.asarray(batch.column("doc_id")), np.asarray(batch.column("h"))
        out, lists = [], _Lists()
        for i, j in textkit.pieces(at):
            tokens, rows = word_tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
            kept = []
            for start, seed in seeds(tokens, rows):
                hit = shared.value.may_have(seed)
                kept.append((start[hit], seed[hit]))
            start, seed = (np.concatenate(x) for x in zip(*kept))
            if not len(start):
                continue
            order = np.lexsort((seed, start))
            start, seed = start[order], seed[order]
            row = np.searchsorted(rows, start, "right") - 1
            cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] - start[:-1] > 2 * REACH)]))
            for a, b in zip(cut, np.append(cut[1:], len(start))):
                lo, hi = max(rows[row[a]], start[a] - REACH), min(rows[row[a] + 1], start[b - 1] + len(MASKS[-1]) + REACH)
                out.append((int(ids[i + row[a]]), int(hashes[i + row[a]]), int(lo - rows[row[a]]), bool(hi < rows[row[a] + 1]), tokens[lo:hi].view(np.int64)))
                lists.add(seed[a:b], start[a:b] - lo)
        if not out:
            return None
        doc, h, lo, more, words = zip(*out)
        tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, words)]), pa.int32()), pa.array(np.concatenate(words)))
        return pa.record_batch([pa.array(doc, pa.int64()), pa.array(h, pa.int64()), pa.array(lo, pa.int32()), pa.array(more), tokens, *lists.columns()], ["doc_id", "h", "start", "more", "tokens", "seeds", "at"])

    return arrow_map(_known(docs), run, "doc_id long, h long, start int, more boolean, tokens array<long>, seeds array<long>, at array<array<int>>")


def _known(docs: DataFrame) -> DataFrame:
    """doc_id, text and its hash h of the rows that have both."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.withColumn("h", F.xxhash64("text"))


def _shifts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The distinct differences of the positions `at` and `pos` of each row."""
    at, pos, out = batch.column("at"), batch.column("pos"), []
    for i in range(batch.num_rows):
        a, p = np.asarray(at[i].values), np.asarray(pos[i].values)
        if len(a) == 1 or len(p) == 1:
            out.append(a - p)
            continue
        low = int(a.min()) - int(p.max())
        marks = np.zeros(int(a.max()) - int(p.min()) - low + 1, bool)
        for x in a if len(a) < len(p) else p:
            marks[(x - p if len(a) < len(p) else a - x) - low] = True
        out.append((np.flatnonzero(marks) + low).astype(np.int32))
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(np.concatenate(out).astype(np.int32)))
    return pa.record_batch([batch.column("tag"), batch.column("itag"), lists], ["tag", "itag", "shifts"])


def _longest(sums: np.ndarray, equal: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int]:
    """Of the stretches from one of `starts` to one of `ends` whose sum is not negative the longest, then the one with most equal tokens."""
    highest = np.maximum.accumulate(sums[ends][::-1])
    last = len(ends) - 1 - np.searchsorted(highest, sums[starts])
    starts, stops = starts[last >= 0], ends[last[last >= 0]]
    n = stops - starts
    if not len(n) or n.max() <= 0:
        return 0, 0
    k = np.lexsort((equal[stops] - equal[starts], n))[-1]
    return int(starts[k]), int(stops[k])


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, similarity: float = SIMILARITY, least: int = LEAST_TOKENS) -> tuple[int, int, int]:
    """First item token, length and agreeing tokens of the longest overlap of `doc` and `item`.

    Token i of the item faces token i + shift of the document. Of the stretches with a
    share of `similarity` agreeing tokens the longest that begins and ends with such a
    token is taken, or where that has fewer than `least` tokens, the longest of all.
    """
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi <= lo:
        return 0, 0, 0
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    equal = np.concatenate([[0], np.cumsum(same)])
    sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - similarity, -similarity) + 1e-9)])
    agreeing, places = np.flatnonzero(same), np.arange(len(sums))
    begin, end = _longest(sums, equal, agreeing, agreeing + 1) if len(agreeing) else (0, 0)
    if end - begin < min(least, len(item)):
        begin, end = _longest(sums, equal, places, places)
    return lo + begin, end - begin, int(equal[end] - equal[begin])


def _some_overlap(same: np.ndarray, lo: np.ndarray, hi: np.ndarray, need: np.ndarray, similarity: float) -> np.ndarray:
    """Rows with `need` tokens or more in a row, within columns lo to hi, of which a share of `similarity` agrees."""
    n, width = same.shape
    sums = np.zeros((n, width + 1))
    np.cumsum(np.where(same, 1 - similarity, -similarity) + 1e-9, axis=1, out=sums[:, 1:])
    column = np.arange(width + 1)
    least = np.minimum.accumulate(np.where(column >= lo[:, None], sums, np.inf), axis=1)
    sums = np.where(column <= hi[:, None], sums, -np.inf)
    found = np.zeros(n, bool)
    for k in np.unique(need[need <= width]):
        own = need == k
        found[own] = (sums[own, k:] >= least[own, : width + 1 - k]).any(1)
    return found


def _block_pairs(similarity: float, least: int):
    """Pairs of the stretches and items of one common seed that overlap on a diagonal of it, with these diagonals."""

    def run(stretches, items):
        out = []
        if stretches.num_rows and items.num_rows:
            (at, flat), (own_at, own) = arrays(items, "item"), arrays(items, "pos")
            sizes, flat = np.diff(at), flat.view(np.uint64)
            width = int(sizes.max())
            table = np.zeros((items.num_rows, width), np.uint64)
            table[np.arange(width) < sizes[:, None]] = flat
            which = np.repeat(np.arange(items.num_rows), np.diff(own_at))
            tags, itags = stretches["tag"].to_pylist(), items["itag"].to_pylist()
            step = max(1, _CELLS // max(width, 1))
            (word_at, words), (seed_at, seeds_) = arrays(stretches, "tokens"), arrays(stretches, "at")
            for row in range(stretches.num_rows):
                doc = words[word_at[row] : word_at[row + 1]].view(np.uint64)
                found: dict[int, set[int]] = {}
                for place in seeds_[seed_at[row] : seed_at[row + 1]].tolist():
                    for k in range(0, len(which), step):
                        item, shift = which[k : k + step], place - own[k : k + step].astype(np.int64)
                        lo, hi = np.maximum(0, -shift), np.minimum(sizes[item], len(doc) - shift)
                        facing = doc[np.clip(np.arange(width) + shift[:, None], 0, len(doc) - 1)]
                        ok = _some_overlap(facing == table[item], lo, hi, np.minimum(least, sizes[item]), similarity)
                        for i, s in zip(item[ok].tolist(), shift[ok].tolist()):
                            found.setdefault(i, set()).add(s)
                out += [(tags[row], itags[i], sorted(s)) for i, s in found.items()]
        columns = zip(*out) if out else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.list_(pa.int32())))], ["tag", "itag", "shifts"])

    return run


def candidates(stretches: DataFrame, wanted: DataFrame, faces: DataFrame, least: int = LEAST_TOKENS, similarity: float = SIMILARITY) -> DataFrame:
    """tag, itag, shifts: stretches and items that share a seed, with the diagonals on which they do.

    Seeds of at most COMMON items join as rows. Those of more never pair their items and
    stretches as rows: blocks of both are compared, and pairs that do not overlap on such a
    diagonal are left out there.
    """
    hits = stretches.select("tag", F.explode(F.arrays_zip("seeds", "at")).alias("s")).select("tag", F.col("s.seeds").alias("seed"), F.col("s.at").alias("at"))
    common = stored(wanted.groupBy("seed").agg(F.count("*").alias("items")).filter(F.col("items") > COMMON))
    none = common.isEmpty()
    rare = wanted if none else wanted.join(common, "seed", "left_anti")
    found = arrow_map(hits.join(rare, "seed").select("tag", "itag", "at", "pos"), _shifts, "tag string, itag string, shifts array<int>")
    if not none:
        asked = stored(hits.join(common, "seed"))
        sized = stored(asked.groupBy("seed").agg(F.ceil(F.first("items") / BLOCK).cast("int").alias("rows"), F.ceil(F.count("*") / BLOCK).cast("int").alias("columns")))

        def dealt(df: DataFrame, name: str, own: str, n: str, other: str, m: str) -> DataFrame:
            block = F.pmod(F.xxhash64(name), F.col(n)).cast("int")
            return df.join(sized, "seed").withColumns({own: block, other: F.explode(F.sequence(F.lit(0), F.col(m) - 1))})

        left = dealt(asked.select("tag", "seed", "at").join(stretches.select("tag", "tokens"), "tag"), "tag", "j", "columns", "i", "rows")
        right = dealt(wanted.join(common.select("seed"), "seed").join(faces, "itag"), "itag", "i", "rows", "j", "columns")
        left, right = left.select("seed", "i", "j", "tag", "at", "tokens"), right.select("seed", "i", "j", "itag", "pos", "item")
        met = left.groupBy("seed", "i", "j").cogroup(right.groupBy("seed", "i", "j")).applyInArrow(_block_pairs(similarity, least), "tag string, itag string, shifts array<int>")
        found = found.unionByName(met)
    return found.select("tag", "itag", F.explode("shifts").alias("shift")).groupBy("tag", "itag").agg(F.collect_set("shift").alias("shifts"))


def _best(doc: np.ndarray, item: np.ndarray, shifts: list[int], similarity: float, least: int) -> tuple[tuple, list[int]]:
    """The best verified overlap (n, equal, document's token, item's token), () without one, and the shifts that have any."""
    best, good = (), []
    for shift in shifts:
        begin, n, equal = overlap(doc, item, shift, similarity, least)
        if n >= min(least, len(item)) and equal >= similarity * n:
            best = max(best, (n, equal, begin + shift, begin))
            good.append(shift)
    return best, good


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_TOKENS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, n_tokens, n_equal, doc_token, item_token: the longest verified overlap of each pair.

    Only pairs that overlap are returned; of equally long ones the overlap with most equal
    tokens, then the one latest in the document. Overlaps keep their alignment: an insertion
    starts another one. Items shorter than the shortest mask (9 words), null texts and null
    ids match nothing; rows that repeat an id count as parts of one document or item. Very
    long texts are read whole; a stretch of them is one row as long as hits follow each
    other. No other columns are read.

    Equal stretches and equal items are verified once, however many documents have them,
    each pair of a stretch and an item in one row with all alignments that share a seed.
    Where an item goes on beyond a stretch, the overlap is measured in the whole text.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    tokens = stored(item_tokens(items))
    faces = tokens.groupBy("itag").agg(F.first("item").alias("item"))
    wanted = stored(benchmark_seeds(faces))
    regions = stored(hit_regions(docs, Bitmap(wanted.select("seed").distinct(), "seed")).withColumn("tag", _content("tokens")))
    stretches = stored(regions.groupBy("tag").agg(F.first(F.struct("tokens", "seeds", "at")).alias("s")).select("tag", "s.*"))
    pairs = candidates(stretches, wanted, faces, least, similarity)
    faced = pairs.join(faces, "itag").join(stretches.select("tag", "tokens"), "tag")

    def verify(batch):
        docs_, items_, shifts, found = batch.column("tokens"), batch.column("item"), batch.column("shifts"), []
        for i in range(batch.num_rows):
            doc, item = np.asarray(docs_[i].values), np.asarray(items_[i].values)
            best, good = _best(doc, item, shifts[i].values.to_pylist(), similarity, least)
            if best:
                found.append((i, *best, good, len(doc), len(item)))
        if not found:
            return None
        i, *numbers, good, size, items_size = zip(*found)
        columns = [pa.array(x, pa.int32()) for x in (*numbers, size, items_size)]
        return pa.record_batch([batch.column("tag").take(pa.array(i)), batch.column("itag").take(pa.array(i)), pa.array(good, pa.list_(pa.int32())), *columns], ["tag", "itag", "shifts", "n", "equal", "doc_at", "item_at", "size", "item_size"])

    same = stored(arrow_map(faced.select("tag", "itag", "shifts", "tokens", "item"), verify, "tag string, itag string, shifts array<int>, n int, equal int, doc_at int, item_at int, size int, item_size int"))
    rows = stored(same.join(regions.select("tag", "doc_id", "h", "start", "more"), "tag").select("doc_id", "h", "itag", "start", "more", "shifts", "n", "equal", (F.col("start") + F.col("doc_at")).alias("doc_token"), F.col("item_at").alias("item_token"), "size", "item_size"))
    beyond = F.exists("shifts", lambda s: ((s < 0) & (F.col("start") > 0)) | ((s + F.col("item_size") > F.col("size")) & F.col("more")))
    long = rows.filter(beyond).select("doc_id", "h", "itag", F.explode("shifts").alias("s"), "start").groupBy("doc_id", "h", "itag").agg(F.collect_set(F.col("s") + F.col("start")).alias("shifts"))
    measures = ["doc_id", "itag", "n", "equal", "doc_token", "item_token"]
    measured = rows.select(measures).unionByName(_in_whole_texts(docs, stored(long), faces, least, similarity).select(measures))
    best = F.max(F.struct("n", "equal", "doc_token", "item_token")).alias("b")
    named = measured.join(tokens.select("itag", "item_id").distinct(), "itag").groupBy("doc_id", "item_id").agg(best)
    return named.select("doc_id", "item_id", F.col("b.n").alias("n_tokens"), F.col("b.equal").alias("n_equal"), "b.doc_token", "b.item_token")


def _in_whole_texts(docs: DataFrame, long: DataFrame, faces: DataFrame, least: int, similarity: float) -> DataFrame:
    """doc_id, itag, n, equal, doc_token, item_token of pairs (doc_id, h, itag, shifts) in whole texts.

    A bitmap keeps other documents from being moved; the join behind it decides.
    """
    schema = "doc_id long, itag string, n int, equal int, doc_token int, item_token int"
    if long.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    key = F.xxhash64("doc_id", "h").alias("key")
    shared = docs.sparkSession.sparkContext.broadcast(Bitmap(long.select(key).distinct(), "key"))  # 16 MB at most

    def some(batch):
        return batch.filter(pa.array(shared.value.may_have(np.asarray(batch.column("key")).view(np.uint64)))).select(["doc_id", "h", "text"])

    def measure(batch):
        data, at = packed(batch.column("text"))
        words, rows = word_tokens(data, at)
        found = []
        for i, (item, shifts) in enumerate(zip(batch.column("item"), batch.column("shifts").to_pylist())):
            best, _ = _best(words[rows[i] : rows[i + 1]], np.asarray(item.values).view(np.uint64), shifts, similarity, least)
            if best:
                found.append((i, *best))
        if not found:
            return None
        i, *numbers = zip(*found)
        return pa.record_batch([batch.column(c).take(pa.array(i)) for c in ("doc_id", "itag")] + [pa.array(x, pa.int32()) for x in numbers], [c.split()[0] for c in schema.split(", ")])

    texts = arrow_map(_known(docs).withColumn("key", F.xxhash64("doc_id", "h")), some, "doc_id long, h long, text string").dropDuplicates(["doc_id", "h"])
    return arrow_map(texts.join(long, ["doc_id", "h"]).join(faces, "itag").select("doc_id", "itag", "text", "item", "shifts"), measure, schema)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that overlap no benchmark item, all columns unchanged.

    Whatever the columns are called; rows with a null id or text stay. Of an id with
    several rows all go where one overlaps.
    """
    name = fresh("dirty", docs)
    dirty = overlaps(docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dirty, docs["doc_id"] == dirty[name], "left_anti")
