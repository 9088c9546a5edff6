"""Text queries: tokens, windows, sentences, chunks and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import embedder, texts
from ..operators import chunks
from ..sources.views import table
from .registry import query

_TOKENS = "list_filter(string_split(text, ' '), lambda t: t <> '')"


@query(f"SELECT doc_id, len({_TOKENS}) AS n FROM documents")
def txt_token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.token_count(F.col("text")).cast("long").alias("n"))


@query(f"""SELECT doc_id, array_to_string(list_slice(t, i + 1, i + 12), ' ') AS part FROM (SELECT doc_id, {_TOKENS} AS t FROM documents), LATERAL (SELECT unnest(range(0, len(t), 8)) AS i)""")
def txt_sliding_windows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(texts.sliding_windows(F.col("text"), 12, 4)).alias("part"))


@query(r"""SELECT doc_id, s AS sentence FROM (SELECT doc_id, regexp_replace(unnest(string_split(regexp_replace(text, '(^\.|[!?]|[^A-Za-z0-9]\.)\s+', '\1' || chr(1), 'g'), chr(1))), '^\s+|\s+$', '', 'g') AS s FROM documents) WHERE s <> ''""")
def txt_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(texts.sentences(F.col("text"))).alias("sentence"))


#: The hash of a word w, of bytes below 128.
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(w, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_WORDS = "regexp_extract_all(lower({}), '[a-z0-9_]+')"
_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(text, '(^\.|[!?]|[^A-Za-z0-9]\.)\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""


def _chunk_sql(p: str, config) -> str:
    """CTEs {p}_chunks (key, ordinal, start_token, end_token, text) of {p}_source (key, text)."""
    entry = f"list_transform(range(384), lambda a: coalesce(list_sum(list_transform({p}_sentences.hashes, lambda h: sin(((h + 31 * a) & 4294967295) / 1e6))), 0))"
    closes = f"(open > 0 AND (apart OR open + size > {config.most}) AND (open >= {config.least} OR len(ends) = 0))"
    return f"""{p}_split AS (SELECT key, {_SENTENCES} AS parts FROM {p}_source),
    {p}_one AS MATERIALIZED (SELECT key, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM {p}_split),
    {p}_words AS (SELECT DISTINCT w FROM (SELECT unnest({_WORDS.format("s")}) AS w FROM {p}_one)), {p}_hashed AS (SELECT w, {_FNV} AS h FROM {p}_words),
    {p}_hashes AS (SELECT key, i, list(h) AS hashes FROM (SELECT key, i, unnest({_WORDS.format("s")}) AS w FROM {p}_one) JOIN {p}_hashed USING (w) GROUP BY key, i),
    {p}_sentences AS MATERIALIZED (SELECT key, i, list_filter(string_split(s, ' '), lambda t: t <> '') AS tokens, coalesce(hashes, []) AS hashes FROM {p}_one LEFT JOIN {p}_hashes USING (key, i)),
    {p}_vectors AS (SELECT key, i, tokens, {entry} AS v FROM {p}_sentences),
    {p}_before AS (SELECT *, lag(v) OVER (PARTITION BY key ORDER BY i) AS u FROM {p}_vectors),
    {p}_parts AS MATERIALIZED (SELECT key, i, len(tokens) AS size, u IS NOT NULL AND coalesce(CASE WHEN list_dot_product(u, u) > 0 AND list_dot_product(v, v) > 0 THEN list_cosine_similarity(u, v) END, 0) < {config.similarity} AS apart FROM {p}_before),
    {p}_fold AS (SELECT DISTINCT key, 0::BIGINT AS i, []::BIGINT[] AS ends, 0::BIGINT AS begin, 0::BIGINT AS open FROM {p}_one UNION ALL
        SELECT f.key, q.i, CASE WHEN {closes} THEN list_append(ends, begin + open) ELSE ends END, CASE WHEN {closes} THEN begin + open ELSE begin END, CASE WHEN {closes} THEN size ELSE open + size END
        FROM {p}_fold f JOIN {p}_parts q ON q.key = f.key AND q.i = f.i + 1),
    {p}_last AS (SELECT * FROM {p}_fold QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1),
    {p}_ends AS (SELECT key, CASE WHEN open = 0 THEN ends WHEN open < {config.least} AND len(ends) > 0 THEN list_append(ends[:-2], begin + open) ELSE list_append(ends, begin + open) END AS ends FROM {p}_last),
    {p}_ranges AS (SELECT key, unnest(list_prepend(0, ends[:-2])) AS b, unnest(ends) AS e FROM {p}_ends WHERE len(ends) > 0),
    {p}_cut AS (SELECT key, unnest(range(b, e, {config.most})) AS b, e FROM {p}_ranges),
    {p}_all AS (SELECT key, flatten(list(tokens ORDER BY i)) AS tokens FROM {p}_sentences GROUP BY key),
    {p}_chunks AS (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY b) - 1 AS INT) AS ordinal, CAST(b AS INT) AS start_token, CAST(least(b + {config.most}, e) AS INT) AS end_token,
        array_to_string(tokens[b + 1:least(b + {config.most}, e)], ' ') AS text FROM {p}_cut JOIN {p}_all USING (key))"""


_CHUNKS = f"""WITH RECURSIVE p_source AS (SELECT doc_id AS key, coalesce(text, '') AS text FROM documents), {_chunk_sql("p", chunks.PARENT)},
    named AS MATERIALIZED (SELECT *, sha256(concat_ws(':', CAST(key AS VARCHAR), 'parent', CAST(ordinal AS VARCHAR))) AS chunk_id FROM p_chunks),
    c_source AS (SELECT chunk_id AS key, text FROM named), {_chunk_sql("c", chunks.CHILD)}
    SELECT key AS id, ordinal, start_token, end_token, text, 'parent' AS config, chunk_id FROM named UNION ALL
    SELECT named.key, c.ordinal, c.start_token, c.end_token, c.text, 'child', sha256(concat_ws(':', c.key, 'child', CAST(c.ordinal AS VARCHAR))) FROM c_chunks c JOIN named ON named.chunk_id = c.key"""


@query(_CHUNKS)
def txt_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return chunks.two_levels(rows)


@query(f"""WITH one AS (SELECT doc_id, unnest({_WORDS.format("text")}) AS w FROM documents), words AS (SELECT doc_id, w, count(*) AS k FROM one GROUP BY ALL),
    hashed AS (SELECT w, {_FNV} AS h FROM (SELECT DISTINCT w FROM words)), axes AS (SELECT unnest(range(384)) AS i),
    sums AS (SELECT doc_id, i, sum(k * sin(((h + 31 * i) & 4294967295) / 1e6)) AS x FROM words JOIN hashed USING (w), axes GROUP BY doc_id, i),
    vectors AS (SELECT doc_id, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS n FROM sums GROUP BY doc_id)
    SELECT doc_id, 384 AS dimensions, coalesce(list_transform(v, lambda x: round(x / n, 6) + 0), list_transform(range(384), lambda x: 0.0::DOUBLE)) AS vector FROM documents LEFT JOIN vectors USING (doc_id)""")
def txt_embed_hash(spark, sf_dir):
    """Whole vectors of whole texts; null texts have those of empty ones."""
    rows = table(spark, sf_dir, "documents").select("doc_id", embedder.embedding(F.coalesce("text", F.lit(""))).alias("vector"))
    return rows.select("doc_id", F.size("vector").alias("dimensions"), F.transform("vector", lambda x: F.round(x, 6) + F.lit(0.0)).alias("vector"))
