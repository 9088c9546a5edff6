"""Line dedup against SQL and plain Python, and its index against a dictionary."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import line_dedup
from quern.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive(rows, least=3):
    """(id, what is left, lines, dropped) of each (id, text)."""
    key = lambda line: line.strip(SPACE).translate(UPPER)
    where = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                where[key(line)].add(-(1 << 63) if i is None else i)
    out = []
    for i, t in rows:
        all_, own = (t or "").split("\n"), -(1 << 63) if i is None else i
        kept = [line for line in all_ if not (len(w := where.get(key(line), ())) >= least and max(w) != own)]
        out.append((i, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return out


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = naive(rows)
    assert Counter(map(tuple, line_dedup.dropped(df).collect())) == Counter((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, gone in want)
    left = line_dedup.deduplicated(df)
    assert left.schema == df.schema
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter((i, None if old is None else t) for (i, t, _, _), (_, old) in zip(want, rows))


def test_query(spark):
    from tests.compare import connection, difference

    assert difference(QUERIES["op13_line_dedup"](spark, SF), connection(SF), ORACLES["op13_line_dedup"]) == ""


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert line_dedup.dropped(no_docs).collect() == [] and line_dedup.deduplicated(no_docs).collect() == []


@pytest.fixture(scope="module")
def crafted(spark):
    a, b, c = "a line of twenty chars", "ünïcödé lines of twenty", "x" * 19
    texts = [
        f"{a}\n{b}", f"  {a.upper()}\t\r\n{c}", f"\n{a}\n\n{a}\v", f"{b}", f"{c}\n{c}", f"{b} \n", "", None, "\n\n", f"{a}\x00", f"{a}\x00", f"{a}\x00\n{a}", b.replace("ü", "Ü"),
        "é" * 20, "é" * 20 + "\n" + "é" * 19, "é" * 20, "\n".join([a, b, c, "é" * 20] * 3), "\x1f" + a, "\x1f" + a, "\x1f" + a, a + " ", a + " ", " " + a,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2])] * 3 + [(7, a), (None, a), (None, f"{b}\n{a}"), (None, f"only\n{'null ids hold this line'}")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS key", "'x' AS drop", "3 AS key__", "4 AS DROP__").repartition(5)


@pytest.mark.parametrize("sizes", [(1 << 18, 1 << 20, 1 << 21), (1, 1, 1), (3, 2, 4)])
def test_sizes_of_blocks_and_shards_change_nothing(crafted, monkeypatch, sizes):
    for name, size in zip(("BLOCK", "SHARD", "GATHERED"), sizes):
        monkeypatch.setattr(line_dedup, name, size)
    check(crafted)


def test_a_line_in_very_many_documents(spark):
    line = "license: this very line is everywhere"
    rows = spark.range(0, 6000, 1, 16).selectExpr("id AS doc_id", f"concat('{line}', '\\n', 'line of its own, number ', id, '\\n', IF(id % 2 = 0, '{line.upper()}', '')) AS text")
    out = line_dedup.dropped(rows).collect()
    assert sum(r["n_dropped"] for r in out) == 6000 + 3000 - 1 and [r["n_dropped"] for r in out if r["doc_id"] == 5999] == [0]


def test_two_documents_are_too_few(spark):
    line = "this line is twenty and more"
    df = spark.createDataFrame([(1, line), (1, line + "\n" + line), (2, line), (None, None)], "doc_id long, text string")
    assert sum(r["n_dropped"] for r in line_dedup.dropped(df).collect()) == 0
    assert sum(r["n_dropped"] for r in line_dedup.dropped(df, least=2).collect()) == 3


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    hi, lo = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, n).astype(np.uint64)
    if n > 2:
        hi[1], lo[2] = hi[0], lo[0]  # equal halves
    count = rng.integers(1, 5, n)
    ids = [rng.choice(1000, c, replace=False) for c in count]
    flat = line_dedup.largest(np.repeat(hi, count), np.repeat(lo, count), np.concatenate([np.zeros(0, np.int64), *ids]), 3)
    shard = line_dedup.Shard.read(line_dedup.Shard.of(*flat, 3).stored(7), 3)
    assert sorted(shard.slots(hi, lo)) == list(range(n))
    known, owner = shard.owner(hi, lo)
    assert known.tolist() == (count >= 3).tolist() and owner.tolist() == [int(max(i)) for i in ids if len(i) >= 3]
    strange, _ = shard.owner(~hi, lo)
    assert not strange.any()
    if n == 5000:
        assert len(shard.bits) * 64 < 4.5 * n and len(shard.owners) == (count >= 3).sum()


def test_largest_keeps_distinct_ids():
    hi = np.array([1, 1, 1, 1, 1, 2], np.uint64)
    got = line_dedup.largest(hi, hi, np.array([5, 9, 5, -3, 7, 0]), 3)
    assert got[2].tolist() == [9, 7, 5, 0] and got[0].tolist() == [1, 1, 1, 2]


def test_lines():
    data = " a b \n\n\tc".encode()
    texts = [b"", data, b"\n", "é ".encode()]
    packed = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    starts, ends, rows, a, b, points = line_dedup.lines(packed, at)
    whole = b"".join(texts)
    assert [whole[s:e] for s, e in zip(starts, ends)] == [line for t in texts for line in t.split(b"\n")]
    assert rows.tolist() == [0, 1, 1, 1, 2, 2, 3] and [whole[s:e].decode() for s, e in zip(a, b)] == ["", "a b", "", "c", "", "", "é"] and points.tolist() == [0, 3, 0, 1, 0, 0, 1]


def test_cut_of_packed_columns():
    texts = [b"keep\n" + b"d" * 25 + b"\nkeep", b"", b"e" * 30]
    gone = line_dedup.digests(np.frombuffer(b"d" * 25 + b"e" * 30, np.uint8), np.array([0, 25]), np.array([25, 55]))
    assert line_dedup.cut(texts, [gone[0], None, gone[1]]) == [(b"keep\nkeep", 3, 1), (b"", 1, 0), (b"", 1, 1)]
    assert pa.types.is_list(line_dedup._block(1, [(1, 2, 3, gone)]).schema.field("ids").type)
