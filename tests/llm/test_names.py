"""Columns with names that the operators use themselves, in any case, and what they leave behind."""

import pytest
from pyspark.sql import functions as F

from quern.llm import common, decontaminate, fill_in_middle, language_id, line_dedup, quality_classifier, quality_rules, sentencepieces, simhash, suffix_dedup, token_counts, toxicity, url_filters

NAMES = ("id", "rows", "ROWS_", "block", "Block_", "dirty", "row", "k", "y", "fp", "key", "kind", "cell", "root", "component_id", "score", "predicted", "kept", "digest", "tag", "seeds", "n_words", "base_failed", "host", "bad", "lang_pred", "__id", "__block", "__dirty", "IDS", "decoded")


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.limit(60).withColumns({n: F.lit(7).cast("int") for n in NAMES})


def test_rows_pass_through(clashing, labels, benchmark):
    names = clashing.columns
    for out in (quality_classifier.kept(clashing, labels), simhash.representatives(clashing), suffix_dedup.deduplicated(clashing), decontaminate.clean(clashing, benchmark), line_dedup.deduplicated(clashing)):
        assert out.columns == names
        rows = out.collect()
        assert rows and all(r[n] == 7 for r in rows for n in NAMES)


def test_pieces_replace_their_own_names_only(clashing):
    out = sentencepieces.encoded(clashing, back="decoded")
    assert out.columns == [c for c in clashing.columns if c not in ("IDS", "decoded")] + ["ids", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") and r["rows"] == 7 for r in out.collect())
    assert sentencepieces.decoded(out.withColumnRenamed("decoded", "DECODED")).columns == out.columns


def test_other_columns_are_not_read(clashing, labels, docs, benchmark):
    few = clashing.select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    for f in (
        lambda d: quality_rules.judged(d, labels), lambda d: decontaminate.overlaps(d, benchmark), lambda d: quality_classifier.classify(d, labels), lambda d: toxicity.classify(d, labels),
        lambda d: language_id.identify(d, model), suffix_dedup.removed, token_counts.counted, simhash.grouped, sentencepieces.round_trips, fill_in_middle.digests, line_dedup.dropped,
    ):
        assert sorted(map(repr, f(clashing).collect())) == sorted(map(repr, f(few).collect()))
    pages = docs.limit(20).selectExpr("doc_id AS page_id", "concat('http://', lang, '.org/', doc_id) AS url", "text AS html")
    odd = pages.withColumns({n: F.lit(7) for n in NAMES})
    assert sorted(url_filters.judged(odd).collect()) == sorted(url_filters.judged(pages).collect())


def test_discard(spark, docs):
    since = common.mark()
    kept = common.stored(suffix_dedup.deduplicated(docs.limit(30)))
    before = spark.catalog.listTables()
    common.discard(spark, since, but=1)
    assert len(before) - len(spark.catalog.listTables()) == 1 and len(kept.collect()) == 30
    common.discard(spark, since)
    with pytest.raises(Exception, match="(?i)not exist|not_exist"):
        kept.collect()


def test_no_settings_are_changed_by_operators(spark, docs, labels):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "777")
    simhash.grouped(docs.limit(5)).count()
    toxicity.classify(docs.limit(5), labels).count()
    assert spark.conf.get(name) == "777"
    spark.conf.set(name, before)
