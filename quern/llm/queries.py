"""The dealt operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_in_middle, language_id, line_dedup, quality_classifier, quality_rules, sentencepieces, simhash, suffix_dedup, token_counts, toxicity, url_filters, whitening
from .common import documents, fold, labels, prepare, stored


def _scored(df: DataFrame) -> DataFrame:
    return df.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(documents(spark, sf_dir), labels(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trips(documents(spark, sf_dir))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(quality_classifier.classify(documents(spark, sf_dir), labels(spark, sf_dir)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.fit(docs)).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir)))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(documents(spark, sf_dir))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dropped(documents(spark, sf_dir))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that quality rules test, and the base rule on them; SQL can express these."""
    stats = quality_rules.statistics(documents(spark, sf_dir))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.base_failed().alias("base_failed"))


def url_filters_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 on outcomes that the quality classifier gives, fitted on the labelled documents, for every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    outcomes = stored(url_filters.outcomes_by_quality(pages, documents(spark, sf_dir), labels(spark, sf_dir)))
    return url_filters.judged(pages, outcomes)


def _prepared(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_url_filters": op3_url_filters,
    "op4_decontamination": op4_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_line_dedup": op13_line_dedup,
    "quality_statistics": quality_statistics,
    "url_filters_by_quality": url_filters_by_quality,
}
QUERIES = {name: _prepared(query) for name, query in QUERIES.items()}

_LONG = url_filters.LONG_SUFFIX


def _rule_cases(pick: int) -> str:
    """The rules in DuckDB SQL, longest first; pick 0: the verdict, 1: the rule's text."""
    cases = []
    for what, h, p in sorted(url_filters.RULES, key=lambda r: (-len(r[1] + r[2]), r)):
        cases.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(what, h + p)[pick]}'")
    return f"CASE {' '.join(cases)} END"


def _strength(counts: str) -> str:
    noise = "above * (1 - above)"
    rho = f"sum((bad - n * above) ** 2 - n * {noise}) / nullif(sum(n * (n - 1) * {noise}), 0)"
    return f"(SELECT CASE WHEN coalesce({rho}, 0) <= 0 THEN {url_filters.STRONGEST} ELSE least({url_filters.STRONGEST}, greatest({url_filters.WEAKEST}, (1 - {rho}) / ({rho}))) END FROM {counts})"


_URL_FILTERS = rf"""WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path, regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&[a-z]+;', '&', 'g') AS txt FROM pages),
    rows_ AS (SELECT page_id, host, path, CAST((length(txt) - length(translate(txt, '#*$%&|!', ''))) * 100 > length(txt) * 3 AS INT) AS bad FROM parts),
    named AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name FROM rows_ WHERE bad IS NOT NULL),
    hosts AS (SELECT host, CASE WHEN regexp_matches(name, '{url_filters.ADDRESS}') THEN name ELSE regexp_extract(name, '(?:^|\.)([^.]*\.{_LONG}|[^.]*\.[^.]*|[^.]*)$', 1) END AS domain,
        CASE WHEN regexp_matches(name, '{url_filters.ADDRESS}') THEN name ELSE regexp_extract(name, '(?:^|\.)({_LONG}|[^.]*)$', 1) END AS suffix,
        count(*) AS n, sum(bad) AS bad FROM named GROUP BY ALL),
    domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
    s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT sum(bad) / sum(n) FROM hosts) AS above FROM domains GROUP BY suffix),
    s1 AS (SELECT suffix, (bad + m * above) / (n + m) AS share FROM s0, (SELECT {_strength("s0")} AS m)),
    d0 AS (SELECT domain, n, bad, share AS above FROM domains JOIN s1 USING (suffix)),
    d1 AS (SELECT domain, (bad + m * above) / (n + m) AS share FROM d0, (SELECT {_strength("d0")} AS m)),
    h0 AS (SELECT host, n, bad, share AS above FROM hosts JOIN d1 USING (domain)),
    h1 AS (SELECT host, n, bad, n + m AS weight, (bad + m * above) / (n + m) AS share FROM h0, (SELECT {_strength("h0")} AS m)),
    judged AS (SELECT host, n, bad, share - {url_filters.Z} * sqrt(share * (1 - share) / (weight + 1)) > {url_filters.MOST} AS blocked FROM h1)
    SELECT page_id, host, path, {_rule_cases(1)} AS rule, coalesce({_rule_cases(0)}, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict,
        CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(judged.bad, 0) AS BIGINT) AS n_bad FROM rows_ LEFT JOIN judged USING (host)"""

_STATISTICS = r"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    listed AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
    spans AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM listed WHERE len(w) > 2),
    named AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM spans),
    inside AS (SELECT r, count(DISTINCT i + k) AS n FROM named, range(3) AS ks(k) WHERE n > 1 GROUP BY r),
    lines AS (SELECT r, l, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r, l),
    twice AS (SELECT r, sum(n - 1) AS n FROM lines GROUP BY r),
    counted AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(twice.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(inside.n, 0) AS BIGINT) AS n_repeat_words
        FROM listed LEFT JOIN twice USING (r) LEFT JOIN inside USING (r))
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted"""

_FILL_IN_MIDDLE = """WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
    drawn AS (SELECT *, CAST('0x' || d[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || d[9:16] AS BIGINT) % (n + 1) AS c2, CAST('0x' || d[17:24] AS BIGINT) % 100 AS c3, CAST('0x' || d[25:32] AS BIGINT) % 100 AS c4 FROM docs),
    cut AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b, CASE WHEN n = 0 OR regexp_matches(t, '<[PSM]>') OR c3 >= 90 THEN 'plain' WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
    parts AS (SELECT *, '<P>' || substring(t, 1, a) AS p, '<M>' || substring(t, a + 1, b - a) AS m, '<S>' || substring(t, b + 1, n - b) AS s FROM cut)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""

_LINE_DEDUP = r"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    cut AS (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM docs),
    keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM cut),
    common AS (SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
    judged AS (SELECT r, keyed.doc_id, line, i, owner IS NOT NULL AND owner <> keyed.doc_id AS gone FROM keyed LEFT JOIN common USING (k))
    SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY r, doc_id"""

#: The other operators learn a model or work on bytes; tests/llm has their brute force.
ORACLES: dict[str, str] = {"op3_url_filters": _URL_FILTERS, "op12_fill_in_middle": _FILL_IN_MIDDLE, "op13_line_dedup": _LINE_DEDUP, "quality_statistics": _STATISTICS}
