"""Token counts behind a digest cache.

The cache is a Parquet table (digest, version, n_tokens). Counting joins the digests of
the normalised contents to it, encodes only distinct contents that it lacks, and appends
their counts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import textkit
from .common import Bitmap, arrow_map, joined, shared_folder, stored

CACHE = StructType([StructField("digest", StringType()), StructField("version", StringType()), StructField("n_tokens", LongType())])

_loaded: dict[str, object] = {}


def version(name: str) -> str:
    """The digest of the tokenizer's file: another vocabulary never reads these counts."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _tokenizer(name: str):
    if name not in _loaded:
        import public_tokenizers

        path = public_tokenizers.path(name)
        if name.endswith(".json"):
            from tokenizers import Tokenizer

            _loaded[name] = Tokenizer.from_file(path)
        else:
            import sentencepiece

            _loaded[name] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[name]


def _ranks(name: str):
    """The same vocabulary as merge ranks, where it is published as such, else None."""
    key = f"ranks of {name}"
    if key not in _loaded:
        import base64
        import os

        import public_tokenizers

        path = public_tokenizers.path(name.removesuffix(".json") + ".tiktoken")
        _loaded[key] = None
        if name == "byte_bpe_50k.json" and os.path.exists(path):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in _tokenizer(name).get_added_tokens_decoder().items()}
            _loaded[key] = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _loaded[key]


def count_tokens(texts: list[str], name: str) -> list[int]:
    """Tokens of each text as the tokenizer's library gives them, nothing added.

    The rank files of the same vocabulary encode several times as fast. They are used
    for characters up to U+024F, on which every Unicode version agrees; other texts, and
    those that the faster code refuses (a million white-space characters on end), go to
    the tokenizer's own library.
    """
    tokenizer = _tokenizer(name)
    if not name.endswith(".json"):
        return [len(x) for x in tokenizer.encode(texts, num_threads=1)]
    ranks = _ranks(name)
    out = [0] * len(texts)
    rest = []
    for i, text in enumerate(texts):
        if ranks is not None and (text.isascii() or max(text) < "ɐ"):
            try:
                out[i] = len(ranks.encode(text, allowed_special="all"))
                continue
            except ValueError:  # its pattern's stack is used up
                pass
        rest.append(i)
    for i, x in zip(rest, tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
        out[i] = len(x.ids)
    return out


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at `path`; empty where nothing has been stored yet."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def _encoder(tokenizer: str, encoded=None):
    """counts(texts) of an Arrow column, in pieces of bounded bytes."""

    def counts(column: pa.Array) -> np.ndarray:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        at, out = textkit.packed(column)[1], []
        for i, j in textkit.pieces(at):
            out += count_tokens(column.slice(i, j - i).to_pylist(), tokenizer)
        if encoded is not None:
            encoded.add(len(out))
        return np.array(out, np.int64)

    return counts


def counted(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", cache: str | None = None, limit: int = 512, encoded=None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs.

    A null text counts as empty (0 tokens). Repeated rows and ids each give a row; other
    columns are not read. Very long texts are encoded whole. The cache's counts are trusted
    for their tokenizer version, whatever is in it twice; `cache` is a folder that all
    executors reach, by default a new one below spark.checkpoint.dir. Texts are read as they
    are: this tokenizer's own normalisation is part of its encoding, so contents are
    normalised only by null becoming empty. encoded: an accumulator that is told how many
    texts were encoded.

    Digests alone are shuffled to find the misses. Two bitmaps of bounded size route the
    contents: what certainly is no miss goes no further; what certainly is one, and in no
    other row, is encoded where it is read; all others meet by digest, are joined to the
    misses and encoded once each. So exactly the distinct misses are encoded, each once,
    however full the bitmaps are: full ones only send more contents to that join.
    """
    spark = docs.sparkSession
    path, tag = cache or f"{shared_folder(spark)}/token_counts", version(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(text.cast("binary"), 256).alias("digest")
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest))
    distinct = rows.groupBy("digest").agg(F.count("*").alias("n")).withColumn("key", F.xxhash64("digest"))
    cached = read_cache(spark, path).filter(F.col("version") == tag).select("digest").distinct().withColumn("cached", F.lit(True))
    empty = cached.isEmpty()
    known = stored(distinct.withColumn("cached", F.lit(False)) if empty else distinct.join(cached, "digest", "left").withColumn("cached", F.coalesce("cached", F.lit(False))))
    context, counts = spark.sparkContext, _encoder(tokenizer, encoded)
    missing = context.broadcast(None if empty else Bitmap(known.filter("NOT cached"), "key"))  # 16 MB at most
    shared = context.broadcast(Bitmap(known.filter("cached OR n > 1"), "key"))

    def encode_alone(batch):
        key = np.asarray(batch.column("key")).view(np.uint64)
        wanted = missing.value.may_have(key) if missing.value else np.ones(len(key), bool)
        batch, later = batch.filter(pa.array(wanted)), shared.value.may_have(key[wanted])
        n = np.zeros(batch.num_rows, np.int64)
        n[~later] = counts(batch.column("text").filter(pa.array(~later)))
        texts = pc.if_else(pa.array(later), batch.column("text"), pa.scalar(None, batch.column("text").type))
        return pa.record_batch([batch.column("digest"), pa.array(n, mask=later), texts], ["digest", "n_tokens", "text"])

    def encode(batch):
        n, open_ = batch.column("n_tokens"), batch.column("n_tokens").is_null()
        out = np.asarray(n.fill_null(0)).copy()
        out[np.asarray(open_)] = counts(batch.column("text").filter(open_))
        return pa.record_batch([batch.column("digest"), pa.array(out)], ["digest", "n_tokens"])

    contents = docs.select(digest, text.alias("text")).withColumn("key", F.xxhash64("digest"))
    found = arrow_map(contents, encode_alone, "digest string, n_tokens long, text string")
    once = found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"), F.first("text", ignorenulls=True).alias("text"))
    misses = once if empty else once.join(known.filter("NOT cached").select("digest"), "digest", "left_semi")
    arrow_map(misses, encode, "digest string, n_tokens long").select("digest", F.lit(tag).alias("version"), "n_tokens").write.mode("append").parquet(path)
    counts_ = read_cache(spark, path).filter(F.col("version") == tag).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return joined(rows, counts_, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
