"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch of texts, each distinct one once, are concatenated and indexed by a
suffix array. Every piece of the vocabulary is binary-searched for its range of
occurrences; the occurrences are edges, which are sorted by position and relaxed from left
to right. A prefix's encoding ends in the one edge that is compatible with the encoding
before it: no merge across the two would have come first. That gives the byte-pair
encoding itself, id for id.

Pieces never reach over a space into the next word, so words are encoded by themselves;
runs of spaces have pieces of their own. Nothing is kept from one batch to the next.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import textkit
from .common import arrow_map

SPACE = "▁"
#: Characters of distinct words that one suffix array indexes, about.
CHUNK = 1 << 18
#: Bytes of text that are encoded together, about (a longer single text is by itself).
PIECE = 8 << 20
#: Longer words are encoded in segments that overlap, side by side.
LONG, SEGMENT, OVERLAP = 2048, 1024, 128
_DEPTH = 12  # of the spines: how often a piece may be split on one side
_WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_NEVER = np.iinfo(np.int32).max

_loaded: dict[str, "Vocabulary"] = {}
_outputs: dict[str, list[bytes]] = {}


def merges(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Byte-pair merges of a few symbols, best rank and leftmost first; also the last merge."""
    items, after, before = list(symbols), [*range(1, len(symbols)), -1], list(range(-1, len(symbols) - 1))
    heap = [(rank[a + b], i, a + b) for i, (a, b) in enumerate(zip(items, items[1:])) if a + b in rank]
    heapq.heapify(heap)
    last = None
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i] if items[i] else -1
        if j < 0 or items[i] + items[j] != joined:
            continue
        last = items[i], items[j]
        items[i], items[j], after[i] = joined, "", after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and items[a] + items[b] in rank:
                heapq.heappush(heap, (rank[items[a] + items[b]], a, items[a] + items[b]))
    return [x for x in items if x], last


class Vocabulary:
    """The pieces of a model: text, rank, how each is merged, and which pairs merge."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.size = self.unknown = size  # one id more stands for a character without a piece
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in plain}
        self.ids = {t: i for i, t in text.items()}
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.rank = {text[i]: place[model.get_score(i)] for i in plain}
        self.runs: dict[int, list[int]] = {}
        # how each piece of a word comes about
        time = np.zeros(size + 1, np.int32)
        halves = np.full((2, size + 1), -1, np.int32)
        words = sorted((i for i in plain if not text[i].startswith(SPACE * 2)), key=lambda i: len(text[i]))
        used = []
        for i in words:
            if len(text[i]) > 1:
                whole, last = merges(list(text[i]), self.rank)
                if len(whole) != 1:
                    continue  # no text is ever encoded with it
                halves[:, i] = [self.ids[x] for x in last]
                time[i] = max(self.rank[text[i]], time[halves[0, i]], time[halves[1, i]])
            used.append(i)
        self.made, self.gone, self.spine = self._spines(time, halves)
        self.pieces = np.array(used)
        self.lengths = np.ones(size + 1, np.int64)
        self.lengths[self.pieces] = [len(text[i]) for i in used]
        found = {}
        for i in used:
            t = text[i]
            for k in range(1, len(t)):
                a, b = self.ids.get(t[:k]), self.ids.get(t[k:])
                if a is not None and b is not None:
                    found[a * (size + 1) + b] = self.rank[t]
        self.pairs = np.array(sorted(found), np.int64)
        self.pair_rank = np.array([found[c] for c in self.pairs.tolist()], np.int32)
        alphabet = sorted({c for i in used for c in text[i]})
        self.letters = np.zeros(0x110000, np.int32)
        self.letters[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        longest = int(self.lengths.max())
        self.spelled = np.zeros((len(used), longest), np.int32)
        for k, i in enumerate(used):
            self.spelled[k, : len(text[i])] = self.letters[[ord(c) for c in text[i]]]
        self.known_pairs = np.full(1 << 20, -1, np.int64)
        self.known = np.zeros(1 << 20, bool)

    @staticmethod
    def _spines(time, halves):
        """For each piece its parts at the right (0) and left (1) edge, from whole to letter:
        the part, when it is made and when it goes into the next larger one."""
        n = halves.shape[1]
        spine = np.full((2, n, _DEPTH), -1, np.int32)
        gone = np.full((2, n, _DEPTH), _NEVER, np.int32)
        for side in (0, 1):
            part = np.arange(n, dtype=np.int32)
            for d in range(_DEPTH):
                spine[side, :, d] = part
                inner = np.where(part >= 0, halves[1 - side][part], -1)
                if d + 1 < _DEPTH:
                    gone[side, :, d + 1] = np.where(part >= 0, time[part], 0)
                part = inner.astype(np.int32)
            if (part >= 0).any():
                raise ValueError(f"pieces of this model are merged on one side more than {_DEPTH} times")
        made = np.where(spine >= 0, time[spine], _NEVER)
        return made, gone, spine

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of a's text and b's text together is a, b."""
        code = a * np.int64(self.size + 1) + b
        slot = (textkit.mix(code.astype(np.uint64)) & np.uint64(len(self.known) - 1)).astype(np.int64)
        miss = self.known_pairs[slot] != code
        out = self.known[slot]
        if miss.any():
            fresh, back = np.unique(code[miss], return_inverse=True)
            answer = self._never_merge(fresh // (self.size + 1), fresh % (self.size + 1))
            out[miss] = answer[back]
            self.known_pairs[slot[miss]] = code[miss]
            # where two pairs of this call share a slot, the last one stays
            self.known[slot[miss]] = out[miss]
        return out

    def _never_merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        valid = np.ones(len(a), bool)
        for i in range(_DEPTH):
            x, fx, px = (s[0, a, i] for s in (self.spine, self.made, self.gone))
            if not (x >= 0).any():
                break
            for j in range(_DEPTH):
                y, fy, py = (s[1, b, j] for s in (self.spine, self.made, self.gone))
                meet = np.flatnonzero(valid & (x >= 0) & (y >= 0) & (fx <= py) & (fy < px))
                if not len(meet):
                    if not (y >= 0).any():
                        break
                    continue
                code = x[meet].astype(np.int64) * (self.size + 1) + y[meet]
                at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
                r = self.pair_rank[at]
                valid[meet[(self.pairs[at] == code) & (r < px[meet]) & (r <= py[meet])]] = False
        return valid

    def spaces(self, n: int) -> list[int]:
        """The encoding of n spaces, which no word follows."""
        if n not in self.runs:
            self.runs[n] = [self.ids[x] for x in merges([SPACE] * n, self.rank)[0]]
        return self.runs[n]

    # The steps of the matching -------------------------------------------------------

    def _index(self, codes: np.ndarray):
        """A suffix array (to the longest piece) and each suffix's packed letters, level by level."""
        n, longest = len(codes), self.spelled.shape[1]
        bits = max(1, int(codes.max(initial=0)).bit_length())
        per = min(longest, 63 // bits)
        wide = np.concatenate([codes, np.zeros(longest + per, codes.dtype)]).astype(np.int64)
        packed = np.zeros(n + longest, np.int64)
        for k in range(per):
            packed = (packed << bits) | wide[k : k + n + longest]
        order = np.argsort(packed[:n])
        depth = per
        while depth < longest:
            key = packed[order] if depth == per else key[order]
            rank = np.zeros(n + longest, np.int64)
            rank[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
            key = rank[:n] * (n + 1) + rank[depth : depth + n]
            order = np.argsort(key)
            depth *= 2
        return order, packed, bits, per

    def _occurrences(self, codes: np.ndarray, spelled: np.ndarray, lengths: np.ndarray):
        """For each piece its range in the suffix array, by binary search."""
        order, packed, bits, per = self._index(codes)
        lo, hi = np.zeros(len(spelled), np.int64), np.full(len(spelled), len(codes), np.int64)
        for d in range(0, spelled.shape[1], per):
            own = np.flatnonzero((lengths > d) & (hi > lo))
            if not len(own):
                break
            part = spelled[own, d : d + per].astype(np.int64)
            have = np.minimum(lengths[own] - d, part.shape[1])
            low = np.zeros(len(own), np.int64)
            for k in range(part.shape[1]):
                low = (low << bits) | part[:, k]
            low <<= np.int64(bits * (per - part.shape[1]))
            high = low + (np.int64(1) << (bits * (per - have)).astype(np.int64))
            if d == 0:
                level = packed[order]
                lo[own], hi[own] = np.searchsorted(level, low), np.searchsorted(level, high)
                continue
            ends = []
            for bound in (low, high):
                a, b = lo[own].copy(), hi[own].copy()
                while (a < b).any():
                    mid = (a + b) >> 1
                    less = (a < b) & (packed[order[np.minimum(mid, len(order) - 1)] + d] < bound)
                    a, b = np.where(less, mid + 1, a), np.where(less | (a >= b), b, mid)
                ends.append(a)
            lo[own], hi[own] = ends
        return order, lo, hi

    def encode_words(self, words: list[str], raw: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of words: letters without inner spaces, at most one space in front.

        raw: a character without a piece gives `unknown`, else the ids of its bytes.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("\n".join(words).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
        codes = self.letters[points]
        n = len(codes)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        present = np.flatnonzero(np.bincount(codes, minlength=1))
        present = present[present > 0]
        dense = np.zeros(self.spelled.max() + 1, np.int32)
        dense[present] = np.arange(1, len(present) + 1)
        all_lengths = self.lengths[self.pieces]
        fit = ((dense[self.spelled] > 0) | (self.spelled == 0)).all(1)
        pieces, lengths = self.pieces[fit], all_lengths[fit]
        order, lo, hi = self._occurrences(dense[codes], dense[self.spelled[fit]], lengths)
        count = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(pieces)), count)
        at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        end, piece = at + lengths[which], pieces[which]
        odd = np.ones(n, bool)  # characters that are no piece by themselves
        odd[at[lengths[which] == 1]] = False
        odd[starts + sizes] = False
        odd = np.flatnonzero(odd)
        end, piece = np.concatenate([end, odd + 1]), np.concatenate([piece, np.full(len(odd), self.unknown)])
        # edges by how far into its word each ends
        depth = end - starts[np.searchsorted(starts, end - 1, "right") - 1]
        bits = n.bit_length()
        if 2 * bits + 16 <= 63:
            key = np.sort((depth << (bits + 16)) | (end << 16) | piece)
            depth, end, piece = key >> (bits + 16), (key >> 16) & ((1 << bits) - 1), key & 0xFFFF
        else:
            by = np.lexsort((end, depth))
            depth, end, piece = depth[by], end[by], piece[by]
        last = np.full(n + 1, -1, np.int64)
        last[starts] = -2
        begin = end - self.lengths[piece]
        steps = np.searchsorted(depth, np.arange(1, int(depth.max(initial=0)) + 2))
        for a, b in zip(steps, steps[1:]):
            before, now = last[begin[a:b]], piece[a:b]
            good = (before == -2) | (before == self.unknown) | (now == self.unknown)
            check = np.flatnonzero(~good & (before >= 0))
            good[check] = self.compatible(before[check], now[check])
            last[end[a:b][good]] = now[good]
        return self._walk(last, starts, sizes, points, raw)

    def encode_long(self, word: str) -> np.ndarray:
        """The ids of one long word, from segments that are encoded side by side.

        Neighbouring segments overlap. Where both encodings have the same token at the same
        place they are joined there: all neighbours of the whole are then compatible, and
        only one sequence of tokens is. Segments that share no token in their overlap begin
        a little later, in the last resort the word is encoded in one go.
        """
        begins = range(0, len(word) - OVERLAP, SEGMENT)
        tried: dict[int, list[np.ndarray]] = {}

        def chains(shift: int) -> list[np.ndarray]:
            if shift not in tried:
                parts, per = [word[a + (shift if a else 0) : a + SEGMENT + OVERLAP] for a in begins], CHUNK // (SEGMENT + OVERLAP)
                tried[shift] = []
                for i in range(0, len(parts), per):
                    at, ids = self.encode_words(parts[i : i + per], raw=True)
                    tried[shift] += [ids[x:y] for x, y in zip(at, at[1:])]
            return tried[shift]

        def placed(start: int, ids: np.ndarray) -> np.ndarray:
            ends = start + np.cumsum(self.lengths[ids])
            return (ends - self.lengths[ids]) * (self.size + 1) + ids

        now, out = placed(0, chains(0)[0]), []
        for k in range(1, len(begins)):
            for shift in range(self.spelled.shape[1]):
                then = placed(begins[k] + shift, chains(shift)[k])
                common = np.intersect1d(now, then, assume_unique=True)
                if len(common):
                    break
            else:
                return self._expanded(self.encode_words([word], raw=True)[1], word)
            out.append(now[now <= common[0]])
            now = then[then > common[0]]
        return self._expanded(np.concatenate([*out, now]) % (self.size + 1), word)

    def _expanded(self, ids: np.ndarray, word: str) -> np.ndarray:
        """`ids` with the bytes of the characters that are unknown."""
        odd = np.flatnonzero(ids == self.unknown)
        if not len(odd):
            return ids.astype(np.int32)
        at, parts, done = np.cumsum(self.lengths[ids]) - self.lengths[ids], [], 0
        for k in odd.tolist():
            parts += [ids[done:k], np.array([self.bytes[b] for b in word[int(at[k])].encode("utf-8", "surrogatepass")])]
            done = k + 1
        return np.concatenate([*parts, ids[done:]]).astype(np.int32)

    def _walk(self, last, starts, sizes, points, raw):
        """From each word's end back to its start."""
        here, alive = starts + sizes, np.flatnonzero(sizes > 0)
        found, strange = [], []
        while len(alive):
            token = last[here[alive]]
            if (token < 0).any():
                raise ValueError("a word has no encoding: the vocabulary is not closed under merges")
            found.append((alive, token))
            odd = token == self.unknown
            strange += alive[odd].tolist()
            here[alive] -= self.lengths[token]
            alive = alive[here[alive] > starts[alive]]
        count = np.zeros(len(starts), np.int64)
        for words, _ in found:
            count[words] += 1
        ends = np.cumsum(count)
        ids = np.empty(ends[-1] if len(ends) else 0, np.int64)
        for step, (words, token) in enumerate(found):
            ids[ends[words] - 1 - step] = token
        starts_out, ids = np.concatenate([[0], ends]), ids.astype(np.int32)
        if not strange or raw:
            return starts_out, ids
        parts, sizes_out, done = [], np.diff(starts_out), 0
        for w in sorted(set(strange)):
            at, expanded = int(starts[w]), []
            for t in ids[starts_out[w] : starts_out[w + 1]].tolist():
                if t == self.unknown:
                    expanded += [self.bytes[b] for b in chr(points[at]).encode("utf-8", "surrogatepass")]
                else:
                    expanded.append(t)
                at += int(self.lengths[t])
            parts += [ids[done : starts_out[w]], np.array(expanded, np.int32)]
            done, sizes_out[w] = starts_out[w + 1], len(expanded)
        return np.concatenate([[0], np.cumsum(sizes_out)]), np.concatenate([*parts, ids[done:]])


def outputs(name: str) -> list[bytes]:
    """The bytes that each id stands for; none for control ids."""
    if name not in _outputs:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))

        def of(i: int) -> bytes:
            if model.is_byte(i):
                return bytes([int(model.id_to_piece(i)[3:5], 16)])
            silent = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
            return b"" if silent else model.id_to_piece(i).replace(SPACE, " ").encode()

        _outputs[name] = [of(i) for i in range(model.get_piece_size())]
    return _outputs[name]


def vocabulary(name: str) -> Vocabulary:
    if name not in _loaded:
        import public_tokenizers

        _loaded[name] = Vocabulary(public_tokenizers.path(name))
    return _loaded[name]


class Encoder:
    """Encodes batches of texts, each by itself: what is kept of one goes before the next."""

    def __init__(self, name: str):
        self.vocabulary = vocabulary(name)
        self._forget()

    def _forget(self):
        self.place: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _add(self, words: list[str], at: np.ndarray, ids: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.ends = np.concatenate([self.ends, at[1:] + self.ends[-1]])
        self.flat = np.concatenate([self.flat, ids])

    def _learn(self, words: list[str]) -> None:
        """Words as they come, spaces in front included; each must be new."""
        v, double = self.vocabulary, SPACE * 2
        special = [w for w in words if w.startswith(double) or w == SPACE or w == "\n"]
        plain = words if not special else sorted(set(words).difference(special))
        long = [w for w in plain if len(w) > LONG]
        if long:
            found = [v.encode_long(w) for w in long]
            self._add(long, np.cumsum([0, *map(len, found)]), np.concatenate(found))
            plain = [w for w in plain if len(w) <= LONG]
        bounds = np.cumsum([len(w) for w in plain]) // CHUNK
        for part in np.split(np.arange(len(plain)), np.flatnonzero(np.diff(bounds)) + 1):
            if len(part):
                chosen = plain[part[0] : part[-1] + 1]
                self._add(chosen, *v.encode_words(chosen))
        cores = {SPACE + w.lstrip(SPACE) for w in special if w.startswith(double)} - {SPACE}
        if missing := sorted(cores.difference(self.place)):
            self._learn(missing)
        encoded = []
        for w in special:
            core = w.lstrip(SPACE)
            n = len(w) - len(core)
            if core == "\n":
                ids = [v.bytes[10]]
            elif not core:
                ids = v.spaces(n)
            else:
                k = self.place[SPACE + core]
                ids = self.flat[self.ends[k] : self.ends[k + 1]].tolist()
                ids = [*v.spaces(n), *ids[1:]] if ids[0] == v.ids[SPACE] else [*v.spaces(n - 1), *ids]
            encoded.append(ids)
        if special:
            self._add(special, np.concatenate([[0], np.cumsum([len(x) for x in encoded])]), np.array(list(chain.from_iterable(encoded)), np.int32))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the texts."""
        local: dict[str, int] = defaultdict(count().__next__)  # words are numbered as they come, none is kept twice
        found = []
        for t in texts:
            words = _WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else []
            found.append(np.fromiter(map(local.__getitem__, words), np.int32, len(words)))
        self._forget()
        self._learn(sorted(local))
        at = np.fromiter(map(self.place.__getitem__, local), np.int64, len(local))
        which = at[np.concatenate(found)] if found else at
        counts = np.concatenate([[0], np.cumsum([len(w) for w in found])])
        sizes = np.diff(self.ends)[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(total[-1]) - np.repeat(total[:-1] - self.ends[:-1][which], sizes)]
        return total[counts], ids


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of PIECE bytes of text or more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= PIECE:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _decoded(column: pa.Array, name: str) -> pa.Array:
    table, texts = outputs(name), []
    flat, at = np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))])
    for k in range(len(column)):
        if not column[k].is_valid:
            texts.append(None)
            continue
        raw = b"".join([table[i] if 0 <= i < len(table) else b"" for i in flat[at[k] : at[k + 1]].tolist()])
        texts.append(raw.removeprefix(b" ").decode("utf-8", "replace"))
    return pa.array(texts, pa.string())


def _others(docs: DataFrame, *names: str) -> list[str]:
    return [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]


def encoded(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", out: str = "ids", back: str | None = None) -> DataFrame:
    """docs with a column `out` of piece ids (array of int), as the model's library gives them.

    Whole texts, without begin or end, however long these or their words are. A null text
    has no ids (an empty array), as an empty one. Other columns are passed through; those
    called `out` or `back` in any case are replaced. back: a further column with the text
    that the ids decode to, without a second pass.
    """
    added = [out, back] if back else [out]
    names = _others(docs, *added)
    schema = docs.select(names).schema.add(out, ArrayType(IntegerType()))
    if back:
        schema = schema.add(back, "string")

    def run(batches):
        encoder = Encoder(tokenizer)
        for batch in _gathered(batches):
            text, at = batch.column("text"), textkit.packed(batch.column("text"))[1]
            offsets, ids = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
            for i, j in textkit.pieces(at, PIECE):
                a, b = encoder.encode([t or "" for t in text.slice(i, j - i).to_pylist()])
                offsets.append(a[1:] + offsets[-1][-1])
                ids.append(b)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets), pa.int32()), pa.array(np.concatenate(ids)))
            columns = [*batch.columns, lists, _decoded(lists, tokenizer)] if back else [*batch.columns, lists]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return docs.select(names).mapInArrow(run, schema)


def decoded(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with a column `out`: the text of the piece ids, without the space put in front.

    Ids that are no pieces give nothing; bytes that are no UTF-8 become U+FFFD. Null ids
    give null. Other columns are passed through; one called `out` in any case is replaced.
    """
    names = _others(docs, out)
    schema = docs.select(names).schema.add(out, "string")

    def run(batch):
        return pa.RecordBatch.from_arrays([*batch.columns, _decoded(batch.column(ids), tokenizer)], names=[*names, out])

    return arrow_map(docs.select(names), run, schema)


def round_trips(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_hash, round_trip of every row of docs.

    round_trip: the decoded ids are the text (with U+2581 as a space, which the model
    does not tell apart). Repeated and null ids give a row each; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = encoded(rows, tokenizer, back="decoded")
    same = F.col("decoded") == F.translate("text", SPACE, " ")
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip"))
