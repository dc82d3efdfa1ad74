"""Names, types and references of assets, as plain functions for readers and as Columns for tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by file extension.
MIME = {
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "svg": "image/svg+xml",
    "webp": "image/webp",
    "avif": "image/avif",
    "ico": "image/x-icon",
    "mp4": "video/mp4",
    "webm": "video/webm",
    "mp3": "audio/mpeg",
    "wav": "audio/wav",
    "ogg": "audio/ogg",
    "pdf": "application/pdf",
    "html": "text/html",
    "htm": "text/html",
    "css": "text/css",
    "txt": "text/plain",
}
OTHER = "application/octet-stream"
#: File extensions by media type, and the types that may be stored.
EXTENSION = {
    "image/png": "png",
    "image/jpeg": "jpg",
    "image/gif": "gif",
    "image/svg+xml": "svg",
    "image/webp": "webp",
    "image/avif": "avif",
    "image/x-icon": "ico",
    "image/bmp": "bmp",
    "video/mp4": "mp4",
    "audio/mpeg": "mp3",
}
ALLOWED = ("image/png", "image/jpeg", "image/gif", "image/webp", "image/avif", "image/x-icon", "image/bmp")
LARGEST = 32 * 1024 * 1024


def guess_mime(name: str) -> str:
    return MIME.get(name.split("?")[0].lower().rsplit(".", 1)[-1], OTHER)


def _choose(key: Column, table: dict[str, str], default: str) -> Column:
    found = F.lit(default)
    for k, v in table.items():
        found = F.when(key == k, v).otherwise(found)
    return found


def mime_of(name: Column) -> Column:
    """Media type of a file name or URL, by its extension."""
    return _choose(F.substring_index(F.lower(F.substring_index(name, "?", 1)), ".", -1), MIME, OTHER)


def extension_of(mime: Column) -> Column:
    return _choose(mime, EXTENSION, "bin")


def data_uri(mime: Column, payload: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(payload), r"[\r\n]", ""))


def data_uri_mime(uri: Column) -> Column:
    """Media type of a base64 data URI; null for anything else."""
    found = F.regexp_extract(uri, r"^data:([^;,]*)(?:;[^;,]*)*;base64,", 1)
    return F.when(uri.rlike(r"^data:[^,]*;base64,"), F.when(found == "", OTHER).otherwise(found))


def data_uri_payload(uri: Column) -> Column:
    return F.when(uri.rlike(r"^data:[^,]*;base64,"), F.try_to_binary(F.regexp_extract(uri, r"^data:[^,]*,(.*)$", 1), F.lit("base64")))


def sanitize_filename(name: Column) -> Column:
    """Last part of a path, no control characters, 100 characters at most, no dots or blanks at the ends."""
    last = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"[\x00-\x1f\x7f-\x9f]", "")
    cut = F.regexp_replace(F.substring(last, 1, 100), r"^[. ]+|[. ]+$", "")
    return F.when(cut == "", "asset").otherwise(cut)


def asset_id(ref: Column) -> Column:
    """Id in asset://id/name; null for other references."""
    found = F.regexp_extract(ref, r"^asset://([^/]*)", 1)
    return F.when(ref.startswith("asset://"), found)


def allowed(mime: Column, size: Column) -> Column:
    return mime.isin(*ALLOWED) & (size > 0) & (size <= LARGEST)
