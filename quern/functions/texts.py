"""Sentences, windows, tokens, names and prompts as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value. Where a sentence ends: behind . ! or ?, but not behind an initial or a number's dot.
_BREAK = r"(?<=[.!?])(?<![A-Z]\.)(?<!\d\.)\s+"


def sentences(text: Column, strict_case: bool = False) -> Column:
    """Trimmed sentences. Unless strict_case, any letter before a dot counts as an initial."""
    parts = F.split(text, _BREAK if strict_case else f"(?i){_BREAK}")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def tokens(text: Column) -> Column:
    """What stands between single spaces, without empty parts."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def sliding_windows(text: Column, window: int, overlap: int) -> Column:
    """Windows of `window` tokens that share `overlap`; the last may be shorter."""
    if overlap >= window or window < 1 or overlap < 0:
        raise ValueError("0 <= overlap < window is required")
    starts = lambda words: F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(window - overlap))).otherwise(F.array().cast("array<int>"))
    part = lambda words, i: F.array_join(F.slice(words, i + 1, window), " ")
    return let(tokens(text), lambda words: F.transform(starts(words), lambda i: part(words, i)))


def unstructured(text: Column) -> Column:
    """Two sentences or more, of which under one in twenty ends in punctuation."""
    parts = sentences(text)
    marked = F.size(F.filter(parts, lambda s: s.rlike(r"[.!?]$")))
    return (F.size(parts) >= 2) & (marked < 0.05 * F.size(parts))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often and wherever `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def contains_ignoring_case(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def dotted_name(name: Column) -> Column:
    """(namespace, tool) of `namespace.tool`; null unless there is exactly one dot."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("namespace"), parts[1].alias("tool")))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def joined_url(base: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))


def prompt(intro: Column, tools: Column, context: Column) -> Column:
    """A prompt of an introduction, a list of tools and `key: value` lines of a map."""
    lines = F.transform(F.array_sort(F.map_entries(context)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat_ws("\n", intro, F.concat(F.lit("Tools: "), F.array_join(tools, ", ")), F.array_join(lines, "\n"))


def embedding_text(kind: Column, output: Column) -> Column:
    """The text that stands for an invocation: its transcript or its response, else ''."""
    heard = F.coalesce(F.get_json_object(output, "$.transcription"), F.get_json_object(output, "$.transcript"))
    return F.coalesce(F.when(kind == "stt", heard).when(kind == "llm", F.get_json_object(output, "$.response")), F.lit(""))


def media_text(title: Column, description: Column, url: Column) -> Column:
    """The text that stands for a media item: its title, description and url, line by line, trimmed."""
    return F.regexp_replace(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), F.coalesce(url, F.lit(""))), r"^\s+|\s+$", "")
