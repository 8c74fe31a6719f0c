"""Removing and restoring machine-specific values in JSON lines, and semantic hashes.

Lines have file, thread_id, line_no, raw (binary) and ending. Whether a line is valid JSON
decides about warnings here, and Spark's parser accepts trailing text, so these operators use one
Arrow function over whole batches; everything else is native.
"""

from __future__ import annotations

import json
import math
import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ..functions.expr import PROVIDER_TOKEN, WORKSPACE_TOKEN, content_id
from .streamed import PART_BYTES, stream_digests, stream_parts

MAX_LINE = 16 << 20


#: Stands around a number in place of its form while a value is written; no text holds it.
_MARK = uuid.uuid4().hex


class _Number:
    """A number that Python would write in another form; it is written as a marked text, and marks and quotes taken off."""

    marked = re.compile(f'"{_MARK}([-0-9.e]+){_MARK}"')

    def __init__(self, text: str):
        self.text = text

    def token(self) -> str:
        return f"{_MARK}{self.text}{_MARK}"


def _dump(value) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False, default=_Number.token)
    return _Number.marked.sub(lambda m: m[1], text) if _MARK in text else text


def _float(text: str):
    """The double of a number as JSON writes it shortest: no plus in the exponent, none at all from 1e-5 to 1e16."""
    value = float(text)
    if value in (math.inf, -math.inf):
        raise ValueError("the number is out of range")
    plain = repr(value)
    if "e" not in plain:
        return value
    digits, exponent = plain.split("e")
    if int(exponent) == -5:
        sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
        return _Number(f"{sign}0.0000{digits.replace('.', '')}")
    return _Number(f"{digits}e{int(exponent)}")


def _integer(text: str):
    """Integers of 64 bits, signed or not; others, and -0, are doubles."""
    value = int(text)
    return value if -(1 << 63) <= value < 1 << 64 and text != "-0" else _float(text + ".0")


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


#: Fixed value: objects and arrays inside one another that a JSON value may have.
DEEPEST = 127
#: Numbers that need a closer look.
_SPECIAL = re.compile(r"-0|[0-9]{19}|[0-9][.eE]")


def _depth(value) -> int:
    deepest, todo = 0, [(value, 1)]
    while todo:
        v, at = todo.pop()
        if isinstance(v, (dict, list)):
            deepest = max(deepest, at)
            todo.extend((x, at + 1) for x in (v.values() if isinstance(v, dict) else v))
    return deepest


def _strict(text: str | None):
    """The value of a text that is one JSON value and nothing else; NaN, numbers beyond doubles, halves of surrogate pairs and more than DEEPEST levels are not."""
    try:
        if _SPECIAL.search(text):
            value = json.loads(text, parse_constant=_no_constant, parse_float=_float, parse_int=_integer)
        else:
            value = json.loads(text, parse_constant=_no_constant)
        if "\\u" in text:
            _dump(value).encode()
        if text.count("[") + text.count("{") > DEEPEST and _depth(value) > DEEPEST:
            return None, False
        return value, True
    except (TypeError, ValueError, RecursionError):
        return None, False


@F.pandas_udf(BooleanType())
def is_json(text):
    """Whether the whole text is one JSON value; null is not."""
    import pandas as pd

    return pd.Series([ok for _, ok in map(_strict, text)], dtype=bool)


@F.pandas_udf(StringType())
def canonical_json_strict(text):
    """Canonical form; null unless the whole text is one JSON value."""
    import pandas as pd

    return pd.Series([_dump(v) if ok else None for v, ok in map(_strict, text)], dtype=object)


def strip_keys(text: Column, keys: tuple[str, ...]) -> Column:
    """Canonical JSON without the keys (the archive's machine-specific ones), at every depth; null for broken JSON."""

    @F.pandas_udf(StringType())
    def strip(values):
        import pandas as pd

        def clean(v):
            if isinstance(v, dict):
                return {k: clean(x) for k, x in v.items() if k not in keys}
            return [clean(x) for x in v] if isinstance(v, list) else v

        return pd.Series([_dump(clean(v)) if ok else None for v, ok in map(_strict, values)], dtype=object)

    return strip(text)


def contains_key(text: Column, key: str) -> Column:
    """Whether any object of the value, at any depth, holds the key; false for broken JSON."""

    @F.pandas_udf(BooleanType())
    def contains(values):
        import pandas as pd

        def held(v):
            if isinstance(v, dict):
                return key in v or any(map(held, v.values()))
            return isinstance(v, list) and any(map(held, v))

        return pd.Series([ok and held(v) for v, ok in map(_strict, values)])

    return contains(text)


def _rewrite(lines: DataFrame, provider: str, workspace: str | None, check_id: bool) -> DataFrame:
    """provider and workspace name columns; a null value leaves the field alone."""

    def rewrite(batches):
        import pyarrow as pa

        names = ["file", "thread_id", "line_no", "raw", "ending", "warning"]

        def session(value: dict, thread, first: bool, provider, workspace) -> tuple[bytes | None, str | None]:
            if not isinstance(value.get("payload"), dict):
                return None, "broken_header" if first and check_id else "invalid_session_meta"
            payload = value["payload"]
            if first and check_id and payload.get("id") != thread:
                return None, "broken_header"
            if provider is not None:
                payload["model_provider"] = provider
            if first and workspace is not None:
                payload["cwd"] = workspace
            return _dump(value).encode(), None

        for batch in batches:
            raws, warnings = batch.column("raw").to_pylist(), [None] * batch.num_rows
            places = batch.column("line_no").to_pylist()
            for i, raw in enumerate(raws):
                raw = raws[i] = raw or b""
                first = places[i] == 0
                if len(raw) > MAX_LINE:
                    warnings[i] = "oversized_line"
                    continue
                try:
                    value, ok = _strict(raw.decode("utf-8"))
                except UnicodeDecodeError:
                    ok = False
                if not ok:
                    warnings[i] = "broken_header" if first else "invalid_json" if raw.strip() else None
                elif isinstance(value, dict) and value.get("type") == "session_meta":
                    of = (batch.column(c)[i].as_py() for c in ("__provider", "__workspace"))
                    new, warnings[i] = session(value, batch.column("thread_id")[i].as_py(), first, *of)
                    raws[i] = raw if new is None else new
                elif first and check_id:
                    warnings[i] = "broken_header"
            columns = [batch.column(c) for c in names[:3]] + [pa.array(raws, pa.binary()), batch.column("ending"), pa.array(warnings, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = lines.select(
        F.col("file").cast("string"), F.col("thread_id").cast("string"), F.col("line_no").cast("long"), F.col("raw").cast("binary"), F.col("ending").cast("string"),
        F.col(provider).cast("string").alias("__provider"), (F.col(workspace) if workspace else F.lit(None)).cast("string").alias("__workspace"),
    )
    return rows.mapInArrow(rewrite, "file string, thread_id string, line_no long, raw binary, ending string, warning string")


def normalize_lines(lines: DataFrame) -> DataFrame:
    """Session records in canonical form with fixed tokens for provider and (first line) workspace; all other lines byte by byte as they were.

    `warning`: broken_header fails the thread (see accepted_lines); invalid_json, invalid_session_meta and
    oversized_line keep the line.
    """
    return _rewrite(lines.withColumn("__p", F.lit(PROVIDER_TOKEN)).withColumn("__w", F.lit(WORKSPACE_TOKEN)), "__p", "__w", True)


def accepted_lines(normalized: DataFrame) -> DataFrame:
    """The lines of the threads whose header is sound; the others fail as a whole."""
    failed = normalized.filter("warning = 'broken_header'").select("file", "thread_id").distinct()
    return normalized.join(failed, normalized["file"].eqNullSafe(failed["file"]) & normalized["thread_id"].eqNullSafe(failed["thread_id"]), "left_anti")


def materialize_lines(lines: DataFrame, machines: DataFrame, on: str) -> DataFrame:
    """The inverse: this machine's provider and workspace (home_key.., provider, workspace) put back."""
    m = machines.select(on, F.col("provider").alias("__p"), F.col("workspace").alias("__w"))
    return _rewrite(lines.join(m, on), "__p", "__w", False).drop("warning")


def rewrite_provider(lines: DataFrame, provider: str) -> DataFrame:
    """Only the provider of every session record; embedded sessions may have other ids."""
    return _rewrite(lines.withColumn("__p", F.lit(provider)), "__p", None, False)


def joined_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per file its content again: all lines and endings in order. For files that fit a row; line_parts has no such limit."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", F.hex(F.concat("raw", F.encode("ending", "UTF-8"))).alias("h"))))
    data = F.unhex(F.array_join(F.transform(ordered, lambda x: x["h"]), ""))
    return lines.groupBy(*keys).agg(data.alias("content"))


def line_parts(lines: DataFrame, keys: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """joined_lines for files of any size, as parts of part_bytes and a closing row; see streamed.stream_parts."""
    return stream_parts(lines, keys, "line_no", F.concat("raw", F.encode("ending", "UTF-8")), part_bytes=part_bytes)


def content_of_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per file of any size its length and content id over all lines and endings in order."""
    return stream_digests(lines, keys, "line_no", F.concat("raw", F.encode("ending", "UTF-8"))).select(*keys, "byte_length", "content_id")


#: Keys of a thread's row that tell of a machine; the fourth is the name of the key of its home.
MACHINE_KEYS = ("model_provider", "rollout_path", "cwd")


def semantic_row(row: Column, home_key: str) -> Column:
    """A thread's row (map of strings) without machine keys (home_key is one of them), nulls, synthesised recency and defaults."""
    updated, updated_ms = F.try_element_at(row, F.lit("updated_at")), F.try_element_at(row, F.lit("updated_at_ms"))
    ms = F.coalesce(updated_ms, (updated.try_cast("bigint") * 1000).cast("string"))

    def keep(k, v):
        quiet = (
            k.isin(*MACHINE_KEYS, home_key)
            | v.isNull()
            | ((k == "recency_at") & ((v == "0") | v.eqNullSafe(updated)))
            | ((k == "recency_at_ms") & ((v == "0") | v.eqNullSafe(ms)))
            | ((k == "history_mode") & (v == "legacy"))
        )
        return ~F.coalesce(quiet, F.lit(False))

    return F.map_filter(row, keep)


def semantic_hash(row: Column, home_key: str, *fields: Column) -> Column:
    """Equal for threads that differ only in what semantic_row leaves out."""
    entries = F.array_sort(F.transform(F.map_entries(semantic_row(row, home_key)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    parts = [F.coalesce(f.cast("string"), F.lit("\0")) for f in fields]
    return content_id(F.concat_ws("\n", *parts, F.array_join(entries, "\n")))
