"""Each dealt operator against brute force, a library or held-out rows, and on odd rows."""

import hashlib
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quern.llm import components, decontaminate, language_id, linear, quality_classifier, quality_rules, sentencepieces, simhash, suffix_dedup, textkit, token_counts, toxicity, url_filters
from quern.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1 Quality rules ---------------------------------------------------------------------


def naive_statistics(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = text.split("\n")
    twice = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(inside)


def test_statistics(spark, docs, odd_docs):
    for df in (docs, odd_docs.filter("doc_id != 4 OR doc_id IS NULL")):
        got = Counter((r[0], *r[1:6]) for r in quality_rules.statistics(df).collect())
        assert got == Counter((d, *naive_statistics(t or "")) for d, t in texts(df))


def test_decision_list_finds_planted_rule():
    rng = np.random.default_rng(1)
    data = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (data["a"] > 0.8) & (data["b"] < 0.5)
    rules = quality_rules.learn(data, bad)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= quality_rules.covered(r, data, 3000)
    assert (hit == bad).mean() > 0.99
    assert quality_rules.learn({"a": np.zeros(0)}, np.zeros(0, bool)) == []


def test_judged(spark, odd_docs, no_docs, odd_labels, labels):
    rows = quality_rules.judged(odd_docs, odd_labels).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] != 4)
    assert [r["base_failed"] for r in rows if r["doc_id"] == 4] == [True]  # all of it repeats
    assert quality_rules.judged(no_docs, labels).count() == 0
    assert quality_rules.judged(odd_docs, odd_labels.limit(0)).count() == len(rows)


def test_rules_keep_good_documents(spark):
    sf = SF.replace("0.001", "0.01")
    got = QUERIES["op1_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("NOT base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.02 * n[(1, True)]
    assert n.get((0, True), 0) <= 0.2 * n[(0, False)]


# 2 SentencePiece ---------------------------------------------------------------------


def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_library(docs, odd_docs):
    model = library()
    for df in (docs, odd_docs):
        for r in sentencepieces.encoded(df.select("doc_id", "text")).collect():
            assert r["ids"] == model.encode(r["text"] or ""), r["text"][:80]


def test_hard_pieces():
    model, encoder = library(), sentencepieces.Encoder("piece_bpe_32k.model")
    hard = ["  two", "a" * 50, " " * 333, "▁x ▁▁y", "\n\n a\n", "ab\tcd", "ééé", "😀😀", "the" * 40, "\x00", "1234567890" * 5, "한국어 नमस्ते", " \n ", "x" + " " * 31 + "y"]
    at, ids = encoder.encode(hard)
    for i, t in enumerate(hard):
        assert ids[at[i] : at[i + 1]].tolist() == model.encode(t), t
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeéßxyz.,▁ \n1"), 12)) for _ in range(2000)]
    at, ids = encoder.encode(words)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(words))] == model.encode(words)


def test_round_trip(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        rows = sentencepieces.round_trips(df).collect()
        assert len(rows) == df.count() and all(r["round_trip"] for r in rows)
    assert sentencepieces.round_trips(no_docs).count() == 0
    kept = sentencepieces.encoded(odd_docs)
    assert kept.columns == [c for c in odd_docs.columns if c != "ids"] + ["ids"]


# 3 URL filters -----------------------------------------------------------------------


def test_urls(spark):
    urls = [
        ("http://A.Org/x?y", "a.org", "/x", "org/", "allow"), ("https://www.example.org/es/1", "www.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"), ("http://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"),
        ("http://b.com/de/1", "b.com", "/de/1", "com/de/", "block"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("x://h", "h", "", None, "allow"), ("x://h.org", "h.org", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = sorted((r[0], r[1], r[2], r[3], r[4]) for r in url_filters.judged(pages).collect())
    assert got == [(i, *u[1:]) for i, u in enumerate(urls)]
    assert url_filters.judged(pages.limit(0)).count() == 0


def test_reputation_blocks_bad_hosts_only(spark):
    rows = [("bad.site.net", 1)] * 60 + [("bad.site.net", 0)] * 5 + [(f"h{i % 40}.ok.net", int(i % 21 == 0)) for i in range(2000)] + [("new.ok.net", None), ("one.ok.net", 1)]
    got = {r["host"]: r["blocked"] for r in url_filters.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.site.net"] and not got["one.ok.net"] and sum(got.values()) == 1 and "new.ok.net" not in got


def test_url_sql(spark):
    from tests.compare import connection, difference

    assert difference(QUERIES["op3_url_filters"](spark, SF), connection(SF), ORACLES["op3_url_filters"]) == ""


# 4 Decontamination -------------------------------------------------------------------


def planted(spark):
    words = [f"w{i}" for i in range(60)]
    item = " ".join(words[:40])
    off = " ".join("X" if i % 7 == 3 else w.upper() for i, w in enumerate(words[:40]))
    short = " ".join(words[10:20])
    other = " ".join(f"v{i}" for i in range(300))
    rows = [(1, f"{other} {item} {other}"), (2, f"{other}\n{off}"), (3, other), (4, f"{other} {short}"), (5, None), (6, ""), (7, item), (7, item), (None, item), (8, other + " " + " ".join(words[20:40]))]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item), (10, None), (None, item), (11, "too short")], "item_id long, text string")


def test_overlaps(spark):
    docs, items = planted(spark)
    got = {(r["doc_id"], r["item_id"]): (r["n_tokens"], r["n_equal"]) for r in decontaminate.overlaps(docs, items).collect()}
    assert got.keys() == {(1, 9), (2, 9), (7, 9), (8, 9)}
    assert got[(1, 9)] == (40, 40) and got[(8, 9)] == (20, 20) and got[(2, 9)][1] >= 30
    assert sorted(str(r["doc_id"]) for r in decontaminate.clean(docs, items).collect()) == ["3", "4", "5", "6", "None"]
    assert decontaminate.overlaps(docs.limit(0), items).count() == 0 and decontaminate.overlaps(docs, items.limit(0)).count() == 0


def test_overlaps_on_documents(spark, docs, benchmark, odd_docs):
    split = re.compile(r"\w+")
    grams = {tuple(w[i : i + 13]) for r in benchmark.collect() for w in [split.findall(r["text"].lower())] for i in range(len(w) - 12)}
    want = {d for d, t in texts(docs) for w in [split.findall((t or "").lower())] if any(tuple(w[i : i + 13]) in grams for i in range(len(w) - 12))}
    got = {r["doc_id"] for r in decontaminate.overlaps(docs, benchmark).collect()}
    assert want <= got and len(got - want) <= 1
    assert decontaminate.overlaps(odd_docs, benchmark).count() == 0


def test_overlap_is_the_longest_stretch():
    item = np.arange(16)
    assert decontaminate.overlap(np.where(item == 12, -1, item), item, 0) == (0, 16, 15)
    assert decontaminate.overlap(np.where(item == 11, -1, item)[:12], item[:12], 0) == (0, 12, 11)
    assert decontaminate.overlap(item[:11], item[:12], 0)[1] < 12
    rng = np.random.default_rng(4)
    for _ in range(400):
        n, shift = int(rng.integers(1, 50)), int(rng.integers(-3, 4))
        item = np.arange(n)
        doc = np.concatenate([np.full(max(shift, 0), -2), np.where(rng.random(n) < rng.uniform(0, 0.5), -1, item)[max(-shift, 0) :], np.full(int(rng.integers(0, 4)), -3)])
        same = [0 <= i + shift < len(doc) and doc[i + shift] == i for i in range(n)]
        faced = [i for i in range(n) if 0 <= i + shift < len(doc)]
        lengths = [b - a for a in faced for b in range(a + 1, faced[-1] + 2) if 5 * sum(same[a:b]) >= 4 * (b - a)]
        begin, m, equal = decontaminate.overlap(doc, item, shift)
        need = min(decontaminate.LEAST_TOKENS, n)
        assert (m >= need) == (max(lengths, default=0) >= need)
        assert equal == sum(same[begin : begin + m]) and 5 * equal >= 4 * m


def test_overlaps_with_a_substitution_near_the_end(spark):
    other = " ".join(f"v{i}" for i in range(100))
    item, short = [f"w{i}" for i in range(16)], [f"s{i}" for i in range(12)]
    docs = [(1, " ".join([other, *item[:12], "X", *item[13:], other])), (2, " ".join([other, *short[:11], "X", other])), (3, " ".join([other, *short[:9], "X", "X", "X", other]))]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(8, " ".join(item)), (9, " ".join(short))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_tokens"], r["n_equal"]) for r in decontaminate.overlaps(docs, items).collect()}
    assert got == {(1, 8): (16, 15), (2, 9): (12, 11)}
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [3]


# 5, 7 Classifiers --------------------------------------------------------------------


@pytest.mark.parametrize("name, label, least", [("op5_quality_classifier", "quality", 0.9), ("op7_toxicity", "toxic", 0.9)])
def test_classifier_held_out(spark, name, label, least):
    sf = SF.replace("0.001", "0.01")
    scored = QUERIES[name](spark, sf)
    assert scored.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    rows = scored.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] == r[label] for r in rows]) >= least
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_classifier_odd_rows(module, odd_docs, no_docs, odd_labels):
    for labels in (odd_labels, odd_labels.limit(0)):
        rows = module.classify(odd_docs, labels).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert module.classify(no_docs, odd_labels).count() == 0


def test_dual_descent_separates():
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 2, 400)
    rows = [np.unique(np.append(rng.integers(10, 200, 8), y)) for y in labels]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    features = np.concatenate(rows)
    p, q = (np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == k]), minlength=256).astype(float) for k in (1, 0))
    ratios = linear.log_ratios(p, q, (labels == 1).sum(), (labels == 0).sum())
    model = linear.fit(starts, features, labels, np.arange(400) % 5 == 0, ratios)
    keys = np.repeat(np.arange(400), np.diff(starts)) << 8 | features
    assert ((model.scores(model.margins(keys, 8, 400)) >= 0.5) == labels).all()


# 6 Language identification -----------------------------------------------------------


def test_languages(spark, odd_docs, no_docs):
    sf = SF.replace("0.001", "0.01")
    got = QUERIES["op6_language_id"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97
    model = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd_docs, model).collect()}
    assert rows[1] == rows[2] == rows[3] == rows[8] == "und" and rows[4] in model.languages
    assert language_id.identify(no_docs, model).count() == 0
    empty = language_id.fit(no_docs)
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, empty).collect()} == {"und"}


def test_mixed_text_spans(spark):
    rows = [(i, "the cat and the dog are in the house with them", "en") for i in range(40)] + [(100 + i, "der Hund und die Katze sind nicht in dem Haus", "de") for i in range(40)] + [(200 + i, "кошка и собака живут в доме", "ru") for i in range(40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = "the dog and the cat are in the house. der Hund und die Katze sind nicht in dem Haus. собака и кошка"
    (row,) = language_id.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, spans=True).collect()
    raw = text.encode()
    assert [s["lang"] for s in row["spans"]] == ["en", "de", "ru"]
    assert raw[row["spans"][1]["start"] : row["spans"][1]["end"]].decode() == "der Hund und die Katze sind nicht in dem Haus"


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    at = np.array([0, 5, 5, 9, 10])
    scores = rng.normal(size=(10, 3)).astype(np.float32)
    labels = language_id.viterbi(scores, at, 0.7)
    for a, b in zip(at, at[1:]):
        worth = lambda path: sum(scores[a + i, k] for i, k in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:]))  # noqa: B023, E731
        best = max(product(range(3), repeat=b - a), key=worth)
        assert worth(tuple(labels[a:b])) == pytest.approx(worth(best))


# 8 Suffix-array dedup ----------------------------------------------------------------


def naive_removed(rows):
    first, out = {}, []
    order = sorted(rows, key=lambda r: (1 << 63) - 1 if r[0] is None else r[0])
    for d, t in order:
        raw, key = (t or "").encode(), (1 << 63) - 1 if d is None else d
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 49):
            if first.setdefault(raw[s : s + 50], key) < key:
                gone[s : s + 50] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if raw else b""
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if raw else 0
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def crafted(spark):
    rng = np.random.default_rng(9)
    word = lambda n: " ".join("".join(rng.choice(list("abcdef"), 4)) for _ in range(n))
    line = "This line of text is in very many documents, you see."
    shared, rows = word(40), []
    for i in range(60):
        rows.append((i, word(10) + (line if i % 2 else "") + (shared[i : 120 + i] if i % 3 == 0 else "") + word(12)))
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, rows[5][1][:-1] + "é"), (63, "ab" * 400), (64, "ab" * 300), (65, "\0" * 120), (66, "\0" * 70 + "x"), (67, line[:49]), (68, line), (68, line), (None, line), (None, line)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("hot", [2, 10, suffix_dedup.HOT])
def test_removed(spark, hot):
    df = crafted(spark)
    got = Counter(tuple(r) for r in suffix_dedup.removed(df, hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == naive_removed(texts(df))


def test_removed_from_documents(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        got = Counter(tuple(r) for r in suffix_dedup.removed(df).collect())
        assert got == naive_removed(texts(df))
    assert suffix_dedup.removed(no_docs).count() == 0
    kept = suffix_dedup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_loser_tree():
    rng = np.random.default_rng(4)
    runs = [sorted(bytes(rng.choice([97, 98], rng.integers(1, 20)).tolist()) for _ in range(rng.integers(0, 30))) for _ in range(7)]
    flat = [s for r in runs for s in r]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    padded = np.frombuffer(b"".join(s.ljust(24, b"\0") for s in flat), np.uint8).reshape(-1, 24)
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    lcps = [0 if i in bounds else shared(flat[i - 1], flat[i]) for i in range(len(flat))]
    order, known = suffix_dedup.merged([w.tolist() for w in padded.view(">u8").astype(np.uint64).T], [len(s) for s in flat], lcps, list(zip(bounds, bounds[1:])))
    out = [flat[i] for i in order]
    assert out == sorted(flat) and known == [0] + [shared(a, b) for a, b in zip(out, out[1:])]


# 9 Token counts ----------------------------------------------------------------------


def test_token_counts(spark, docs, odd_docs, no_docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda t: len(model.encode(t or "", add_special_tokens=False).ids)
    hard = spark.createDataFrame([(1, "a<|endoftext|>b <|endoftext|>"), (2, "ʻokina ǆ Ωmega 漢字  \u00a0x"), (3, "it's I'LL\r\n\r\n 12")], "doc_id long, text string")
    cache = f"file://{tmp_path}/cache"
    for df in (docs, odd_docs, hard):
        got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.counted(df, cache=cache).collect())
        assert got == Counter((d, len((t or "").encode()), n := count(t), n > 512) for d, t in texts(df))
    rows = spark.read.parquet(cache).count()
    assert rows == len({t or "" for df in (docs, odd_docs, hard) for _, t in texts(df)})
    token_counts.counted(docs, cache=cache).count()
    assert spark.read.parquet(cache).count() == rows  # nothing was encoded again
    assert token_counts.counted(no_docs).count() == 0


# 10 SimHash --------------------------------------------------------------------------


def naive_groups(rows):
    prints = []
    for d, t in rows:
        words = WORD.findall((t or "").translate(A_TO_Z))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and find(i) != find(j):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def test_groups(docs, odd_docs, no_docs):
    for df in (docs, odd_docs.filter("doc_id != 4 OR doc_id IS NULL")):
        assert Counter(tuple(r) for r in simhash.grouped(df).collect()) == naive_groups(texts(df))
    assert simhash.grouped(no_docs).count() == 0


@pytest.mark.parametrize("cell", [3, simhash.CELL])
def test_links_connect_all_neighbours(spark, cell):
    """A dense cloud: one key holds many fingerprints, dealt in cells of three or in one."""
    rng = np.random.default_rng(8)
    base = int(rng.integers(0, 1 << 62))
    near = {base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(150)}
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in [*near, *(int(x) for x in rng.integers(0, 1 << 62, 50))]]
    got = components.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), cell), "a", "b").collect()
    root = {r["node"]: r["root"] for r in got}
    bits = np.array(signed).view(np.uint64)
    names = np.array([root.get(f, f) for f in signed])
    label = np.arange(len(bits))
    for _ in range(len(bits)):
        linked = np.bitwise_count(bits[:, None] ^ bits) <= 4
        new = np.where(linked, label[None, :], len(bits)).min(1)
        if (new == label).all():
            break
        label = new
    assert len(set(zip(label, names))) == len(set(label)) == len(set(names))


def test_components_of_a_chain(spark):
    rows = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 200), (300, 300), (None, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}


def test_representatives(spark, odd_docs):
    kept = simhash.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 5 in ids and 1 in ids and 2 not in ids and 3 not in ids


# Text kit ----------------------------------------------------------------------------


def test_run_hashes_depend_on_bytes_only():
    data = np.frombuffer(b"abc abc xabc", np.uint8)
    a, b, c, d = textkit.run_hashes(data, np.array([0, 4, 9, 8]), np.array([3, 7, 12, 12]))
    assert a == b == c != d
