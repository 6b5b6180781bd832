"""Path, media-type, version and checksum functions over columns."""

from __future__ import annotations

import json
import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

# The metadata fields of a record that may name it or version it,
# in order of preference.
PATH_FIELDS = ("file_path", "file_name", "filename", "source", "url", "title")
VERSION_FIELDS = ("version", "revision", "modified_time", "last_modified", "mtime", "etag")
DEFAULT_TYPE = "application/octet-stream"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _suffix(name: Column) -> Column:
    """The last dotted suffix with its case; a leading dot alone opens none."""
    return F.regexp_extract(name, r"(?s)\A\.*[^.].*?(\.[^.]*)\z", 1)


def extension(path: Column) -> Column:
    return F.lower(_suffix(basename(path)))


def title(path: Column, given: Column | None = None) -> Column:
    named = basename(path)
    return named if given is None else F.coalesce(F.nullif(given, F.lit("")), named)


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A constant table as one literal; the optimizer folds the parse away."""
    literal = F.from_json(F.lit(json.dumps(table, sort_keys=True)), "map<string,string>")
    return F.try_element_at(literal, key)


def guess_type(path: Column, given: Column | None = None) -> Column:
    """The given media type, else one by extension, else a generic binary type.

    The extension table is the interpreter's built-in one, so a machine's own
    type files cannot change an answer between executors.
    """
    known = mimetypes.MimeTypes()
    name = basename(path)
    suffix = _suffix(name)
    alias = _lookup(known.suffix_map, F.lower(suffix))
    full = F.when(
        alias.isNotNull(), F.concat(F.left(name, F.length(name) - F.length(suffix)), alias)
    ).otherwise(name)
    outer = _suffix(full)
    packed = F.when(
        outer.isin(*known.encodings_map), F.left(full, F.length(full) - F.length(outer))
    ).otherwise(full)
    guessed = _lookup(known.types_map[True], F.lower(_suffix(packed)))
    chosen = F.coalesce(guessed, F.lit(DEFAULT_TYPE))
    return chosen if given is None else F.coalesce(F.nullif(given, F.lit("")), chosen)


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def etag(content: Column) -> Column:
    return F.md5(content)


def norm_etag(value: Column) -> Column:
    """An entity tag without outer space and quotes; null counts as empty."""
    return F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r'\A"+|"+\z', "")


def url_path(raw: Column) -> Column:
    """A relative path from a URL or file name: no scheme, no empty or ``..`` parts."""
    bare = F.regexp_replace(raw, r"\A[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    parts = F.split(F.translate(bare, "\\", "/"), "/")
    return F.array_join(F.filter(parts, lambda p: (p != "") & (p != "..")), "/")


def first_field(metadata: Column, fields: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(F.try_element_at(metadata, F.lit(f)), F.lit("")) for f in fields))


def record_version(metadata: Column, text: Column) -> Column:
    """``field:value`` of the first version field, else a short content hash."""
    named = [
        F.concat(F.lit(f"{f}:"), F.nullif(F.try_element_at(metadata, F.lit(f)), F.lit("")))
        for f in VERSION_FIELDS
    ]
    hashed = F.concat(F.lit("sha256:"), F.left(F.sha2(text, 256), F.lit(16)))
    return F.coalesce(*named, hashed)


def file_version(modified: Column, size: Column) -> Column:
    return F.concat_ws(":", F.lit("mtime"), F.unix_seconds(modified).cast("string"), size.cast("string"))


def delta_bytes(text: Column, existing_size: Column) -> Column:
    return F.octet_length(text).cast("long") - F.coalesce(existing_size, F.lit(0))


def iso8601(ts: Column) -> Column:
    """ISO text of a timestamp in UTC; microseconds appear only when not zero."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(utc, ".SSSSSS")
    return F.concat(whole, F.when(micros == ".000000", F.lit("")).otherwise(micros), F.lit("+00:00"))


def entry_id(tenant: Column, namespace: Column, path: Column) -> Column:
    """A stable id per primary key, so a revived path finds its pages again."""
    return F.upper(F.left(F.sha2(F.concat_ws("/", tenant, namespace, path), 256), F.lit(26)))
