"""URL filters: fixed rules, then empirical-Bayes host reputation.

Labelled page outcomes are shrunk through beta-binomial priors: a suffix towards all
pages, a registered domain towards its suffix, a host towards its domain. A host is
blocked when the lower bound of its posterior share of bad pages is too high.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality_classifier, scoring
from .common import joined, stored

#: (verdict, host, path): fixed values; the longest rule that fits wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Second-level labels under which countries register domains (fixed values). A public
#: suffix is one of them before a country's two letters, any other is the last label.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
LONG_SUFFIX = rf"(?:{'|'.join(SECOND_LEVEL)})\.[a-z][a-z]"
#: Hosts that are addresses have no domain or suffix but themselves.
ADDRESS = r"^[0-9.]+$"
#: A host is blocked when its share of bad pages exceeds MOST with the confidence of Z.
MOST, Z = 0.3, 1.645
#: Prior strengths (in pages) stay within these bounds.
WEAKEST, STRONGEST = 1.0, 1000.0


def lowered(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for a url without `://`."""
    url = F.coalesce(url, F.lit(""))
    split = "://([^/?#]*)([^?#]*)"
    return lowered(F.regexp_extract(url, split, 1)), F.regexp_extract(url, split, 2)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host (a port is ignored)."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    suffix = F.regexp_extract(name, rf"(?:^|\.)({LONG_SUFFIX}|[^.]*)$", 1)
    domain = F.regexp_extract(name, rf"(?:^|\.)([^.]*\.{LONG_SUFFIX}|[^.]*\.[^.]*|[^.]*)$", 1)
    address = name.rlike(ADDRESS)
    return F.when(address, name).otherwise(domain), F.when(address, name).otherwise(suffix)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (text) and its verdict, null where none fits."""
    rule, verdict = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = rule.when(fits, h + p), verdict.when(fits, what)
    return rule, verdict


def _strength(counts: DataFrame, share: str) -> float:
    """Beta-binomial prior strength by moments: from how far rates spread about `share`."""
    noise = F.col(share) * (1 - F.col(share))
    row = counts.agg(
        F.sum((F.col("bad") - F.col("n") * F.col(share)) ** 2 - F.col("n") * noise).alias("excess"),
        F.sum(F.col("n") * (F.col("n") - 1) * noise).alias("scale"),
    ).first()
    rho = (row["excess"] or 0.0) / row["scale"] if row["scale"] else 0.0
    return STRONGEST if rho <= 0 else min(STRONGEST, max(WEAKEST, (1 - rho) / rho))


def reputation(outcomes: DataFrame, most: float = MOST, z: float = Z) -> DataFrame:
    """host, n, n_bad, bound, blocked of every host in `outcomes` (host, bad 0/1).

    Null outcomes are not labels. Counts are added up by host before anything else, so a
    host with any number of pages is one row afterwards.
    """
    hosts = outcomes.filter(F.col("bad").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = stored(hosts.withColumns({"domain": domain, "suffix": suffix}))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = (total["bad"] or 0) / total["n"] if total["n"] else 0.0
    add = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*add)
    suffixes = domains.groupBy("suffix").agg(*add).withColumn("above", F.lit(overall))

    def shrunk(counts: DataFrame, name: str) -> DataFrame:
        m = _strength(counts, "above")
        return counts.withColumn(name, (F.col("bad") + m * F.col("above")) / (F.col("n") + m)).withColumn("m", F.lit(m))

    suffixes = shrunk(suffixes, "share").select("suffix", F.col("share").alias("above"))
    domains = shrunk(domains.join(suffixes, "suffix"), "share").select("domain", F.col("share").alias("above"))
    scored = shrunk(hosts.join(domains, "domain"), "share")
    weight = F.col("n") + F.col("m")
    bound = F.col("share") - z * F.sqrt(F.col("share") * (1 - F.col("share")) / (weight + 1))
    return scored.select("host", "n", F.col("bad").alias("n_bad"), bound.alias("bound"), (bound > most).alias("blocked"))


def looks_bad(html: Column) -> Column:
    """A stand-in for labelled outcomes: 1 if over 3 % of a page's text are symbols of noise, else 0.

    Tags do not count as text; null for a null page.
    """
    text = F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), "&[a-z]+;", "&")
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|!", ""))
    return (symbols * 100 > F.length(text) * 3).cast("int")


def page_text(html: Column) -> Column:
    """A page's text: tags are taken out, entities become their last sign."""
    return F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "&[a-z]+;", "&")


def outcomes_by_quality(pages: DataFrame, docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """page_id, bad of every page with an id and html: outcomes for `judged` from labelled documents.

    The quality classifier learns from `docs` and their `labels` and scores the pages'
    texts; a page is bad below `least`, the classifier's own threshold.
    """
    texts = pages.filter("page_id IS NOT NULL AND html IS NOT NULL").select(F.col("page_id").cast("long").alias("doc_id"), page_text(F.col("html")).alias("text"))
    scored = scoring.score(texts, quality_classifier.fit(docs, labels), quality_classifier.word_keys, least)
    return scored.select(F.col("doc_id").alias("page_id"), (1 - F.col("predicted")).alias("bad"))


def judged(pages: DataFrame, outcomes: DataFrame | None = None, rules=RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, n, n_bad of every row of pages.

    outcomes: labelled outcomes (page_id, bad: 1 or 0; null is no label). A page with
    several has the one most of its rows carry, bad where they are even. Without this
    table looks_bad(html) stands in for it. A page that no rule fits gets its host's
    verdict; hosts without any labelled page are allowed. Null and malformed urls have
    the empty host, which is a host like others. Repeated and null page ids give a row
    each, urls are read whole, and columns other than page_id, url and html are not read.
    """
    host, path = url_parts(F.col("url"))
    columns = [F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")]
    if outcomes is None:
        rows = pages.select(*columns, looks_bad(F.col("html")).alias("bad"))
    else:
        known = outcomes.filter("bad IS NOT NULL").groupBy(F.col("page_id").cast("long").alias("page_id")).agg((F.avg("bad") >= 0.5).cast("int").alias("bad"))
        rows = pages.select(*columns).join(known, "page_id", "left")
    rows = stored(rows)
    hosts = stored(reputation(rows.select("host", "bad"), **options).select("host", "n", "n_bad", "blocked"))
    every = rows.select("host").distinct().join(hosts, "host", "left")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("blocked"), "block").otherwise("allow")
    none = F.lit(0).cast("long")
    return joined(rows, every, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), F.coalesce("n", none).alias("n"), F.coalesce("n_bad", none).alias("n_bad")
    )
