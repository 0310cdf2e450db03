"""JSON functions over text columns. Paths: ``$``, ``.field``, ``[i]``."""

from __future__ import annotations

import json as _json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = re.compile(r"\.([A-Za-z_][\w-]*)|\[(\d+)\]|\[?\"([^\"]+)\"\]?")


def _kind(doc: Column, path: str) -> Column:
    """The variant type at ``path``, in upper case; null where there is nothing."""
    return F.upper(F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), path, "variant")))


def is_json(doc: Column) -> Column:
    """Whether the text is JSON of any kind, with nothing after it; null for null. The parser overlooks what follows a value, but not in an array."""
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), doc, F.lit("]"))), "$", "array<variant>")
    return F.when(doc.isNotNull(), F.coalesce(F.size(alone) == 1, F.lit(False)))


def json_value(doc: Column, path: str) -> Column:
    """A scalar as text; null for objects, arrays, JSON null, no such path and bad JSON."""
    kind = _kind(doc, path)
    return F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID"), F.get_json_object(doc, path))


def json_query(doc: Column, path: str) -> Column:
    """An object or array as text, null for all else."""
    kind = _kind(doc, path)
    return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.get_json_object(doc, path))


def json_exists(doc: Column, path: str) -> Column:
    """Whether the path leads to anything, JSON null included; null for bad JSON."""
    parsed = F.try_parse_json(doc)
    return F.when(parsed.isNotNull(), F.try_variant_get(parsed, path, "variant").isNotNull())


def steps(path: str) -> list[str | int]:
    """The fields and indexes of a path."""
    if not path.startswith("$"):
        raise ValueError(f"a path starts with $: {path!r}")
    out: list[str | int] = []
    at = 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"bad path {path!r}")
        out.append(int(m[2]) if m[2] is not None else m[1] or m[3])
        at = m.end()
    return out


def modified(doc: str | None, path: str, value: str | None) -> str | None:
    """``doc`` with the value at ``path`` set (text; numbers, true, false and JSON keep their kind). None deletes. ``append $.a`` adds to an
    array. A missing last field is made; a missing way there, and bad JSON, change nothing."""
    if doc is None:
        return None
    append = path.startswith("append ")
    way = steps(path.removeprefix("append ").strip())
    try:
        root = _json.loads(doc)
    except ValueError:
        return doc
    new = None
    if value is not None:
        try:
            new = _json.loads(value)
        except ValueError:
            new = value
    if append:
        way = [*way, -1]
    if not way:
        return _json.dumps(new) if value is not None else doc
    at = root
    for s in way[:-1]:
        if isinstance(at, dict) and s in at or isinstance(at, list) and isinstance(s, int) and s < len(at):
            at = at[s]
        else:
            return doc
    last = way[-1]
    if append:
        if isinstance(at, list):
            at.append(new)
    elif isinstance(at, dict) and isinstance(last, str):
        if value is None:
            at.pop(last, None)
        else:
            at[last] = new
    elif isinstance(at, list) and isinstance(last, int) and last < len(at):
        if value is None:
            del at[last]
        else:
            at[last] = new
    return _json.dumps(root, separators=(",", ":"))


def json_modify(doc: Column, path: str, value: Column) -> Column:
    """See ``modified``. Spark has no built-in that edits JSON, so this runs over Arrow batches in Python."""

    @F.pandas_udf("string")
    def edit(docs: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([modified(d, path, None if pd.isna(v) else v) for d, v in zip(docs, values)], dtype=object)

    return edit(doc, value.cast("string"))


def openjson(df: DataFrame, doc: str, path: str = "$") -> DataFrame:
    """A row per member of the object or array at ``path``: ``df``'s columns, then key, value and type."""
    inner = F.try_variant_get(F.try_parse_json(F.col(doc)), path, "variant")
    node = df.withColumn("_node", inner)
    rows = node.lateralJoin(node.sparkSession.tvf.variant_explode(F.col("_node").outer()), how="inner")
    kind = F.lower(F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0))
    named = F.when(kind == "void", "null").when(kind.isin("bigint", "int", "smallint", "tinyint"), "int").when(kind.isin("double", "float", "decimal"), "float").otherwise(kind)
    key = F.coalesce(F.col("key"), F.col("pos").cast("string"))
    return rows.select(*df.columns, key.alias("key"), F.col("value").cast("string").alias("value"), named.alias("type"))


def openjson_with(df: DataFrame, doc: str, columns: dict[str, tuple[str, str]], path: str = "$") -> DataFrame:
    """A row per element of the array at ``path`` (or its object), with ``columns``: name to (type, path); null where missing."""
    inner = F.try_variant_get(F.try_parse_json(F.col(doc)), path, "variant")
    whole = F.upper(F.schema_of_variant(inner)).startswith("ARRAY")
    items = F.when(whole, F.try_variant_get(inner, "$", "array<variant>")).otherwise(F.array(inner))
    rows = df.select("*", F.explode(items).alias("_item"))
    return rows.select(*df.columns, *[F.try_variant_get(F.col("_item"), at, kind).alias(name) for name, (kind, at) in columns.items()])


def for_json(df: DataFrame, order: list[str]) -> DataFrame:
    """All rows as one JSON array of objects, ordered by ``order``. One row, for results that fit a task."""
    row = F.struct(*[F.col(c) for c in df.columns])
    key = F.struct(*[F.col(c) for c in order])
    sorted_rows = F.array_sort(F.collect_list(F.struct(key.alias("k"), row.alias("r"))))
    return df.agg(F.to_json(F.transform(sorted_rows, lambda x: x["r"])).alias("json"))
