"""Scalar rules as Column expressions; all native, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands in portable content where a machine's own values stood.
PROVIDER_TOKEN = "__local_provider__"
WORKSPACE_TOKEN = "__local_workspace__"
ROLLOUT_ROOTS = ("sessions", "archived_sessions")


def trimmed(text: Column) -> Column:
    """Without white space (of all of Unicode) at both ends."""
    return F.regexp_replace(text, r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def content_id(data: Column) -> Column:
    """sha256:<hex> of the bytes (UTF-8 of a string)."""
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def canonical_json(text: Column) -> Column:
    """Keys sorted at every depth, no white space, nulls kept, array order kept; null for broken JSON."""
    return F.to_json(F.try_parse_json(text))


def is_sha256_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\Asha256:[0-9a-f]{64}\z"), F.lit(False))


def is_rfc3339(text: Column) -> Column:
    """A full date and time with offset; parts of one are not enough."""
    whole = text.rlike(r"\A\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\z")
    return F.coalesce(whole & F.try_to_timestamp(F.upper(text)).isNotNull(), F.lit(False))


def safe_relative_path(path: Column) -> Column:
    """Not empty, not absolute, no parent step or drive, and below one of the rollout roots."""
    parts = F.split(path, "/")
    return F.coalesce(
        (path != "")
        & ~path.startswith("/")
        & ~F.exists(parts, lambda p: (p == "..") | p.rlike(r"\A[A-Za-z]:"))
        & F.element_at(parts, 1).isin(*ROLLOUT_ROOTS),
        F.lit(False),
    )


def clean_provider(value: Column, lower: bool = False) -> Column:
    """Trimmed, 1 to 128 of [A-Za-z0-9_.-] and not a reserved token; else null."""
    name = F.lower(trimmed(value)) if lower else trimmed(value)
    return F.when(name.rlike(r"\A[A-Za-z0-9_.\-]{1,128}\z") & ~name.isin(PROVIDER_TOKEN, WORKSPACE_TOKEN), name)


def clean_display_name(value: Column) -> Column:
    """Trimmed, 1 to 128 characters without control characters; else null."""
    name = trimmed(value)
    return F.when((F.char_length(name) >= 1) & (F.char_length(name) <= 128) & ~name.rlike(r"\p{Cntrl}"), name)


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def json_string(v: Column, path: str) -> Column:
    """A string; other values are null."""
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def lenient_string(v: Column, path: str) -> Column:
    """A string that is not blank."""
    text = json_string(v, path)
    return F.when(trimmed(text) != "", text)


def lenient_integer(v: Column, path: str) -> Column:
    """An integer, or a string of one; a number with a fraction is none."""
    text = json_string(v, path)
    whole = F.when(_kind(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))
    return F.coalesce(whole, F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint")))


def lenient_bool(v: Column, path: str) -> Column:
    """A boolean, an integer (0 is false), or the words true and false, written like this."""
    kind, word = _kind(v, path), json_string(v, path)
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
        .when(kind == "BIGINT", F.try_variant_get(v, path, "bigint") != 0)
        .when(word == "true", True)
        .when(word == "false", False)
    )


def storage_mode(size: Column, threshold: int) -> Column:
    return F.when(size >= threshold, "chunked").otherwise("whole")


def effective_time_ms(updated_ms: Column, created_ms: Column, row_updated_ms: Column, row_updated: Column, row_created_ms: Column, row_created: Column) -> Column:
    """The first that is known; the row's second-based times count as milliseconds."""
    return F.coalesce(updated_ms, created_ms, row_updated_ms, row_updated * 1000, row_created_ms, row_created * 1000)


def unix_millis(ts: Column) -> Column:
    """Milliseconds of a timestamp, microseconds rounded half away from zero (not cut, as Spark's own function does)."""
    return (F.round(F.unix_micros(ts), -3) / 1000).cast("long")


def clean_description(value: Column) -> Column:
    return F.substring(trimmed(value), 1, 500)


def clean_tags(tags: Column) -> Column:
    """Trimmed to 64 characters, blanks dropped, distinct, sorted, the first 32."""
    cut = F.transform(tags, lambda t: F.substring(trimmed(t), 1, 64))
    return F.slice(F.array_sort(F.array_distinct(F.filter(cut, lambda t: t != ""))), 1, 32)


def format_bytes(size: Column) -> Column:
    """1024-based units to TiB, one decimal (a tie goes to the even digit) from KiB up."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(size >= 1024**power, F.concat(F.format_string("%.1f", F.bround(size / float(1024**power), 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    """Seconds under a minute, else minutes and seconds."""
    minutes = F.concat(F.floor(seconds / 60).cast("string"), F.lit(" m "), (seconds % 60).cast("string"), F.lit(" s"))
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" s"))).otherwise(minutes)


def short_head(value: Column) -> Column:
    return F.substring(F.regexp_replace(value, r"\Asha256:", ""), 1, 12)


def path_syntax(path: Column) -> Column:
    """Forward slashes; the verbatim prefixes of drives and network shares removed."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    rest = F.substring(p, 5, 1 << 30)
    return (
        F.when(p.startswith("//?/") & (F.upper(F.substring(rest, 1, 4)) == "UNC/"), F.concat(F.lit("//"), F.substring(rest, 5, 1 << 30)))
        .when(p.startswith("//?/") & (F.substring(rest, 2, 1) == ":"), rest)
        .otherwise(p)
    )


def path_key(path: Column) -> Column:
    """What two spellings of one folder share; drive and share paths ignore case."""
    p = F.rtrim(path_syntax(path), F.lit("/"))
    windows = p.startswith("//") | (F.substring(p, 2, 1) == ":")
    return F.when(windows, F.translate(p, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(p)


def suggest_name(path: Column) -> Column:
    """A folder name from the last segment of a path; `project` where nothing is left."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    leaf = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("project"))
    safe = F.regexp_replace(F.regexp_replace(leaf, r'[\p{Cntrl}<>:"/\\|?*]', "_"), r"\A[ .]+|[ .]+\z", "")
    return F.when(safe == "", "project").otherwise(safe)


def ancestors(key: Column, strict: bool = False) -> Column:
    """The prefixes of a path on component boundaries, shortest first, itself last unless strict."""
    parts = F.split(key, "/")
    depth = F.size(parts) - (1 if strict else 0)
    each = F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(depth >= 1, F.filter(each, lambda x: x != "")).otherwise(F.array().cast("array<string>"))
