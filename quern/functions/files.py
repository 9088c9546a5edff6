"""File names, media types and attachments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by extension (fixed values).
MEDIA_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp",
    "svg": "image/svg+xml", "mp3": "audio/mpeg", "wav": "audio/wav", "m4a": "audio/mp4", "aac": "audio/aac",
    "flac": "audio/flac", "mp4": "video/mp4", "mov": "video/quicktime", "avi": "video/x-msvideo",
    "mkv": "video/x-matroska", "webm": "video/webm", "pdf": "application/pdf", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "txt": "text/plain", "csv": "text/csv", "html": "text/html", "htm": "text/html", "xml": "text/xml",
    "json": "application/json", "zip": "application/zip", "rar": "application/x-rar-compressed",
}
DEFAULT_TYPE = "application/octet-stream"


def extension(name: Column) -> Column:
    """Lower-cased text behind the last dot, '' without one."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))).otherwise("")


def media_type(ext: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    return F.coalesce(known[ext], F.lit(DEFAULT_TYPE))


def media_class(kind: Column) -> Column:
    """image, audio, video or other."""
    first = F.split_part(kind, F.lit("/"), F.lit(1))
    return F.when(first.isin("image", "audio", "video"), first).otherwise("other")


def attachments_of(items: Column, cls: str) -> Column:
    """Attachments (structs with content_type) of a media class."""
    return F.filter(items, lambda a: a["content_type"].startswith(f"{cls}/"))


def attachments_size(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda n, a: n + a["size_bytes"])


def slices(content: Column, size: int = 65_536) -> Column:
    """Binary content in slices of `size` bytes, in order."""
    count = F.greatest(F.ceil(F.octet_length(content) / size), F.lit(0)).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(content, i * size + 1, F.lit(size)))


def with_attachment(items: Column, item: Column) -> Column:
    """Attachments (structs with uuid) with `item` added; one with its uuid is replaced."""
    return F.array_append(without_attachment(items, item["uuid"]), item)


def without_attachment(items: Column, uuid: Column) -> Column:
    return F.filter(items, lambda a: a["uuid"] != uuid)


def attachment(items: Column, uuid: Column) -> Column:
    """The first attachment with a uuid, null without one."""
    return F.try_element_at(F.filter(items, lambda a: a["uuid"] == uuid), F.lit(1))
