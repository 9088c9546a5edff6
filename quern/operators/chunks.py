"""Semantic chunks of texts, on two levels."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embedder, texts
from ..functions.embedder import embed


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in tokens; a boundary lies where neighbours' similarity falls below `similarity`.

    segments: what is compared and packed. `sentences`, `windows` (of `window` tokens that
    share `overlap`), or `auto`: windows for texts that hardly have punctuation.
    """

    name: str
    window: int
    overlap: int
    least: int
    most: int
    similarity: float = 0.5
    segments: str = "auto"

    def __post_init__(self):
        if not (0 <= self.overlap < self.window and 0 < self.least <= self.most and 0 <= self.similarity <= 1):
            raise ValueError(f"chunk sizes do not fit together: {self}")
        if self.segments not in ("auto", "sentences", "windows"):
            raise ValueError(f"segments are auto, sentences or windows, not {self.segments}")


PARENT = ChunkConfig("parent", 200, 50, 128, 400)
CHILD = ChunkConfig("child", 30, 10, 10, 60)


def _cut(words: list[str], most: int) -> list[list[str]]:
    return [words[i : i + most] for i in range(0, len(words), most)]


def packed(segments: list[str], config: ChunkConfig, provider: Callable = embed) -> list[tuple[int, int, str]]:
    """(start, end, text) of the chunks of a text's sentences, in tokens.

    Sentences gather until a boundary or the largest size; a short tail joins the chunk
    before it, and what is still too long is cut.
    """
    tokens = [[t for t in s.split(" ") if t] for s in segments]
    groups: list[list[str]] = []
    if len(segments) > 1:
        vectors = [provider(s) for s in segments]
        size = [np.linalg.norm(v) for v in vectors]
        open_: list[str] = []
        for i, words in enumerate(tokens):
            scale = size[i - 1] * size[i] if i else 0
            apart = i > 0 and (float(vectors[i - 1] @ vectors[i]) / scale if scale else 0.0) < config.similarity
            full = len(open_) + len(words) > config.most
            if open_ and (apart or full) and (len(open_) >= config.least or not groups):
                groups.append(open_)
                open_ = []
            open_ = open_ + words
        if open_ and groups and len(open_) < config.least:
            groups[-1] = groups[-1] + open_
        elif open_:
            groups.append(open_)
    elif tokens:
        groups = [tokens[0]]
    out, at = [], 0
    for words in (part for g in groups for part in _cut(g, config.most)):
        out.append((at, at + len(words), " ".join(words)))
        at += len(words)
    return out


def _segments(rows: DataFrame, config: ChunkConfig) -> DataFrame:
    """The columns of each row but text, and the segments of its text."""
    text = F.coalesce("text", F.lit(""))
    windows, sentences = texts.sliding_windows(text, config.window, config.overlap), texts.sentences(text)
    segments = {"windows": windows, "sentences": sentences, "auto": F.when(texts.unstructured(text), windows).otherwise(sentences)}[config.segments]
    return rows.select(*(c for c in rows.columns if c != "text"), segments.alias("segments"))


def packed_sizes(parts: Column, config: ChunkConfig) -> Column:
    """Ends, in tokens, of the chunks of parts (size, apart), before long ones are cut: the rule of `packed` as a fold.

    apart: whether a boundary lies before the part.
    """
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("ends"), F.lit(0).alias("begin"), F.lit(0).alias("open"))

    def step(acc: Column, part: Column) -> Column:
        full = acc["open"] + part["size"] > config.most
        closes = (acc["open"] > 0) & (part["apart"] | full) & ((acc["open"] >= config.least) | (F.size(acc["ends"]) == 0))
        end = acc["begin"] + acc["open"]
        closed = F.struct(F.concat(acc["ends"], F.array(end)).alias("ends"), end.alias("begin"), part["size"].alias("open"))
        return F.when(closes, closed).otherwise(F.struct(acc["ends"].alias("ends"), acc["begin"].alias("begin"), (acc["open"] + part["size"]).alias("open")))

    def finish(acc: Column) -> Column:
        end = acc["begin"] + acc["open"]
        joins = (acc["open"] < config.least) & (F.size(acc["ends"]) > 0)
        before = F.when(joins, F.slice(acc["ends"], F.lit(1), F.size(acc["ends"]) - 1)).otherwise(acc["ends"])
        return F.when(acc["open"] == 0, acc["ends"]).otherwise(F.concat(before, F.array(end)))

    return F.aggregate(parts, start, step, finish)


def chunked(rows: DataFrame, config: ChunkConfig, provider: Callable | None = None) -> DataFrame:
    """id, ordinal, start_token, end_token, text of the chunks of each row (id, text).

    Column expressions throughout, but for vectors of a provider of one's own: these are
    computed, and the text packed, by Arrow batches.
    """
    if provider is not None:
        return _chunked_by(_segments(rows.select("id", "text"), config), config, provider, rows.schema["id"].dataType.simpleString())
    found = _ended(rows.select("id", "text"), config).select("id", "words", F.posexplode(_ranges(config)).alias("ordinal", "r"))
    return found.select("id", "ordinal", F.col("r.begin").alias("start_token"), F.col("r.end").alias("end_token"), _joined(F.col("words"), F.col("r")).alias("text"))


def _joined(words: Column, r: Column) -> Column:
    return F.array_join(F.slice(words, r["begin"] + 1, r["end"] - r["begin"]), " ")


def _ended(rows: DataFrame, config: ChunkConfig) -> DataFrame:
    """The columns of each row but text, the words of its text, and `packed_sizes` of its parts as `ends`."""
    own = [c for c in rows.columns if c != "text"]
    part = F.transform("segments", lambda s: F.struct(F.size(texts.tokens(s)).alias("size"), embedder.summed(s).alias("v")))
    parts = _segments(rows, config).select(*own, "segments", part.alias("p"))
    apart = lambda p, i: F.when(i > 0, embedder.summed_similarity(F.get("p", i - 1)["v"], p["v"]) < config.similarity).otherwise(False)
    parts = parts.select(*own, "segments", F.transform("p", lambda p, i: F.struct(p["size"].alias("size"), apart(p, i).alias("apart"))).alias("p"))
    return parts.select(*own, F.flatten(F.transform("segments", texts.tokens)).alias("words"), packed_sizes(F.col("p"), config).alias("ends"))


def _ranges(config: ChunkConfig) -> Column:
    """The chunks (begin, end) of a row of `_ended`, long ones cut.

    Not a column of its own: of an exploded column Spark infers that it isn't empty, and
    would compute all that is behind it for that filter, once a reference.
    """
    begun = F.transform("ends", lambda e, i: F.struct(F.when(i > 0, F.get("ends", i - 1)).otherwise(0).alias("begin"), e.alias("end")))
    cut = lambda r: F.transform(F.sequence(r["begin"], r["end"] - 1, F.lit(config.most)), lambda b: F.struct(b.alias("begin"), F.least(b + config.most, r["end"]).alias("end")))
    return F.flatten(F.transform(begun, cut))


def _chunked_by(parted: DataFrame, config: ChunkConfig, provider: Callable, kind: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(i, k, *c) for i, s in zip(frame["id"], frame["segments"]) for k, c in enumerate(packed(list(s), config, provider))]
            yield pd.DataFrame(out, columns=["id", "ordinal", "start_token", "end_token", "text"])

    return parted.mapInPandas(run, f"id {kind}, ordinal int, start_token int, end_token int, text string")


def register_functions(spark: SparkSession) -> None:
    """Makes `text_chunks(text, level)` a table function of SQL: LATERAL text_chunks(t.text, 'parent').

    Its rows are ordinal, start_token, end_token, text; level is parent or child. A null
    text has no chunks.
    """

    @F.udtf(returnType="ordinal int, start_token int, end_token int, text string")
    class TextChunks:
        def eval(self, text: str, level: str):
            config = {"parent": PARENT, "child": CHILD}[level]
            for k, chunk in enumerate(packed(split_sentences(text or ""), config)):
                yield k, *chunk

    spark.udtf.register("text_chunks", TextChunks)


#: `texts.sentences` in Python's notation.
_BREAK = re.compile(r"(?<=[.!?])(?<![A-Z]\.)(?<!\d\.)\s+", re.IGNORECASE | re.ASCII)


def split_sentences(text: str) -> list[str]:
    """The sentences of one text, as `functions.texts.sentences` gives them."""
    return [s for s in (part.strip(" \t\n\r\x0b\x0c") for part in _BREAK.split(text)) if s]


def parents(rows: DataFrame, provider: Callable | None = None) -> DataFrame:
    """The upper level of `two_levels`."""
    return chunked(rows, PARENT, provider).withColumn("config", F.lit("parent")).withColumn("chunk_id", F.sha2(F.concat_ws(":", "id", "config", "ordinal"), 256))


def two_levels(rows: DataFrame, provider: Callable | None = None) -> DataFrame:
    """Parent chunks, and the chunks of each parent (offsets within it), with stable ids.

    Each parent is made once and gives its own row and its children's, without an exchange;
    with a provider of one's own, parents are made anew to be joined to their children.
    """
    made = parents(rows, provider)
    if provider is None:
        ended = _ended(made.withColumn("whole", F.col("text")), CHILD)
        row = lambda ordinal, start, end, text, config, chunk_id: F.struct(ordinal.alias("ordinal"), start.alias("start_token"), end.alias("end_token"), text.alias("text"), config.alias("config"), chunk_id.alias("chunk_id"))
        child = lambda r, k: row(k, r["begin"], r["end"], _joined(F.col("words"), r), F.lit("child"), F.sha2(F.concat_ws(":", "chunk_id", F.lit("child"), k), 256))
        own = row(*(F.col(c) for c in ("ordinal", "start_token", "end_token", "whole", "config", "chunk_id")))
        return ended.select("id", F.inline(F.concat(F.array(own), F.transform(_ranges(CHILD), child))))
    children = chunked(made.select(F.col("chunk_id").alias("id"), "text"), CHILD, provider)
    owner = made.select(F.col("chunk_id").alias("parent_id"), F.col("id").alias("owner"))
    children = children.withColumnRenamed("id", "parent_id").join(owner, "parent_id")
    children = children.select(F.col("owner").alias("id"), "ordinal", "start_token", "end_token", "text", F.lit("child").alias("config"), F.sha2(F.concat_ws(":", "parent_id", F.lit("child"), "ordinal"), 256).alias("chunk_id"))
    return made.select(children.columns).unionByName(children)


def reindexed(chunks: DataFrame, rows: DataFrame, provider: Callable | None = None, make: Callable = two_levels) -> DataFrame:
    """`chunks` with those of the rows' ids replaced. make: what made the chunks, `two_levels` or `parents`."""
    return chunks.join(rows.select("id"), "id", "left_anti").unionByName(make(rows, provider))


def pending(chunks: DataFrame, entity: str = "id") -> DataFrame:
    """Chunks of each entity that have no embedding yet."""
    return chunks.filter("embedding IS NULL").select(entity, "chunk_id")


def faults(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """id, fault of what is wrong with an index of `rows`: missing, orphan, or a gap in the ordinals."""
    wanted = rows.filter(F.size(texts.tokens(F.coalesce("text", F.lit("")))) > 0).select("id").distinct()
    have = chunks.filter("config = 'parent'").groupBy("id").agg(F.count("*").alias("n"), F.max("ordinal").alias("last"), F.count_distinct("ordinal").alias("kinds"))
    both = wanted.withColumn("wanted", F.lit(True)).join(have, "id", "full_outer")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "orphan").when((F.col("last") + 1 != F.col("n")) | (F.col("kinds") != F.col("n")), "gap")
    return both.select("id", fault.alias("fault")).filter("fault IS NOT NULL")
