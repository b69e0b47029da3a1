"""String, regular-expression, hash, date and map helpers (Columns in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_id(name: Column) -> Column:
    """Lower-cased, trimmed file name."""
    return F.lower(F.trim(name))


def stem(name: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def suffix(name: Column) -> Column:
    """Last suffix with its dot in lower case, empty when there is none."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def nonblank(text: Column) -> Column:
    """True when the text has at least one non-space character."""
    return F.coalesce(F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) > 0, F.lit(False))


def strip_markup(html: Column) -> Column:
    """Remove tags, decode the three basic entities and squeeze white space."""
    plain = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def links(html: Column) -> Column:
    """All href targets in document order."""
    return F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))


def text_hash(value: Column) -> Column:
    """SHA-256 of text or bytes as hexadecimal text."""
    return F.sha2(value, 256)


def config_hash(config: Column) -> Column:
    """SHA-256 of a map as JSON with its keys in sorted order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(config)))
    return F.sha2(F.to_json(ordered), 256)


def md5_pick(text: Column) -> Column:
    """First 32 bits of the MD5 as a BIGINT: the reproducible draw used for every seeded choice."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def parse_time(text: Column) -> Column:
    """ISO timestamp or null when it cannot be parsed."""
    return F.try_to_timestamp(F.replace(text, F.lit("T"), F.lit(" ")))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(ts.cast("timestamp"))


def gap_seconds(earlier: Column, later: Column) -> Column:
    """Seconds between two timestamps, with fractions."""
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def unknown_keys(config: Column, allowed: list[str]) -> Column:
    """Keys of a map that are not allowed, sorted."""
    return F.array_sort(F.array_except(F.map_keys(config), F.array(*[F.lit(a) for a in allowed])))


def json_path(text: Column, path: str) -> Column:
    """Value of a nested JSON path as text, null when absent."""
    return F.get_json_object(text, path)
