"""JSON documents held as text: access, containment, equality, canonical text, tokens and posting lists."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(c: Column) -> Column:
    """The document as VARIANT; null if it isn't JSON."""
    return F.try_parse_json(c)


def canonical(c: Column) -> Column:
    """Compact text with sorted keys; null if it isn't JSON."""
    return F.to_json(parse(c))


def write_binary(df: DataFrame, column: str, path: str) -> None:
    """The table with the documents in VARIANT's binary form, in Parquet; ``canonical`` of what is read back is that of the text. Text that isn't JSON is null."""
    df.withColumn(column, parse(F.col(column))).write.parquet(path)


def get(c: Column, *path: str | int) -> Column:
    """``->``: the part at a path of keys and places, as JSON text; ``null`` where it is missing."""
    return F.coalesce(F.to_json(F.try_variant_get(parse(c), _path(path), "variant")), F.lit("null"))


def get_text(c: Column, *path: str | int) -> Column:
    """``->>``: strings bare, other parts as JSON text; the text ``null`` where it is missing or null."""
    return F.coalesce(F.get_json_object(c, _path(path)), F.lit("null"))


def _path(path: tuple[str | int, ...]) -> str:
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else f'["{p}"]' if "'" in p else f"['{p}']" for p in path)


def equal(a: Column, b: Column) -> Column:
    """Equal documents: the order of keys and 1 or 1.0 don't matter."""
    return _numbers(canonical(a)) == _numbers(canonical(b))


def _numbers(c: Column) -> Column:
    # a whole number written with a fraction of zeros, outside strings, where it ends a value
    return F.regexp_replace(c, r'([:\[,]-?\d+)\.0+(?=[,\]}])', "$1")


def _loads(text: str | None):
    if text is None:
        return _BAD
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return _BAD


class _BAD:
    """Stands for text that isn't JSON. A class, as it must stay the same object when functions are sent to workers."""


def _holds(part):
    return lambda v: _contains(v, part)


def _is(v: Column, *kinds: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike("^(" + "|".join(kinds) + r")\b"), F.lit(False))


def _contains(v: Column, part) -> Column:
    """Whether a VARIANT contains the part; the part is known when the query is planned, so this is one expression."""
    if isinstance(part, dict):
        out = _is(v, "OBJECT")
        for k, x in part.items():
            out = out & _contains(F.try_variant_get(v, _path((k,)), "variant"), x)
        return out
    if isinstance(part, list):
        items = F.try_variant_get(v, "$", "array<variant>")
        out = _is(v, "ARRAY")
        for x in part:
            out = out & F.coalesce(F.exists(items, _holds(x)), F.lit(False))
        return out
    if part is None:
        return F.coalesce(F.is_variant_null(v), F.lit(False))
    if isinstance(part, bool):
        return F.coalesce(_is(v, "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == part), F.lit(False))
    if isinstance(part, (int, float)):
        # whole numbers of up to 38 digits exactly, others as doubles
        whole = isinstance(part, int) and abs(part) < 10**38
        same = F.try_variant_get(v, "$", "decimal(38,0)") == F.lit(str(part)).cast("decimal(38,0)") if whole else F.lit(True)
        return F.coalesce(_is(v, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & (F.try_variant_get(v, "$", "double") == float(part)) & same, F.lit(False))
    return F.coalesce(_is(v, "STRING") & (F.try_variant_get(v, "$", "string") == part), F.lit(False))


def flat_contains(c: Column, part: dict) -> Column:
    """``@>`` for an object of strings, booleans and whole numbers, by built-in functions."""
    out = F.lit(True)
    for k, v in part.items():
        text = F.get_json_object(c, _path((k,)))
        out = out & F.coalesce(text.cast("double") == float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else text == (v if isinstance(v, str) else json.dumps(v)), F.lit(False))
    return out


def contains(df: DataFrame, column: str, part) -> DataFrame:
    """The rows whose document contains ``part``: scalars equal, arrays each element somewhere, objects each key, recursively. By VARIANT expressions; text that isn't JSON, or is nested deeper than the parser takes, contains nothing."""
    return df.filter(_contains(parse(F.col(column)), part))


def _scalar_token(v) -> tuple[str, str]:
    if v is None:
        return "n:", ""
    if isinstance(v, bool):
        return "b:", "true" if v else "false"
    if isinstance(v, int):
        return "i:", str(v)
    if isinstance(v, float):
        return ("i:", str(int(v))) if v.is_integer() else ("d:", repr(v))
    return "s:", v


def tokens_of(doc) -> list[str]:
    """Sorted distinct tokens: ``k:key``, ``k:key=scalar`` and typed scalars, at any depth."""
    out: set[str] = set()
    todo = [doc]
    while todo:
        d = todo.pop()
        if isinstance(d, dict):
            for k, v in d.items():
                out.add(f"k:{k}")
                if not isinstance(v, (dict, list)):
                    out.add(f"k:{k}={_scalar_token(v)[1]}")
                todo.append(v)
        elif isinstance(d, list):
            todo += d
        else:
            kind, text = _scalar_token(d)
            out.add(kind + text)
    return sorted(out)


def posting_lists(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(token, doc_id), distinct: an inverted index of the documents; text that isn't JSON, or is nested deeper than the parser takes, has no tokens. Tokens come from any depth, which no expression reaches, so documents go through Python in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens = [], []
            for i, d in zip(batch.column("id").to_pylist(), map(_loads, batch.column("doc").to_pylist()), strict=True):
                own = tokens_of(d) if d is not _BAD else []
                tokens += own
                ids += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(ids, pa.int64())], ["token", "doc_id"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("doc")).mapInArrow(run, "token string, doc_id long").distinct()


def lookup(index: DataFrame, token: str) -> DataFrame:
    return index.filter(F.col("token") == token).select("doc_id")


def lookup_all(index: DataFrame, tokens: list[str]) -> DataFrame:
    """Documents with all the tokens."""
    wanted = sorted(set(tokens))
    return index.filter(F.col("token").isin(wanted)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("doc_id")


def lookup_any(index: DataFrame, tokens: list[str]) -> DataFrame:
    return index.filter(F.col("token").isin(sorted(set(tokens)))).select("doc_id").distinct()


def indexed_contains(df: DataFrame, index: DataFrame, id_col: str, column: str, part) -> DataFrame:
    """``contains``, looking only at the documents that the index names: those with all of the part's tokens. The result is that of the full scan."""
    wanted = tokens_of(part)
    rows = df if not wanted else df.join(lookup_all(index, wanted).withColumnRenamed("doc_id", "found_"), F.col(id_col) == F.col("found_"), "left_semi")
    return contains(rows, column, part)
