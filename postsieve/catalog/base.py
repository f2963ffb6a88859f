"""Registration and the pieces of SQL text that several oracles share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A shared table; its schema is read from the file footers once."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# --- data derived from the tables -------------------------------------------------------------------


def heading(html: Column | str = "html") -> Column:
    return F.regexp_extract(html, "<h1>([^<]*)</h1>", 1)


def first_line(text: Column | str = "text") -> Column:
    return F.substring_index(text, "\n", 1)


def stamp_text(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- SQL text ----------------------------------------------------------------------------------------


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def contains_any_sql(expr: str, terms: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quoted(t)})" for t in terms) + ")"


def strip_sql(expr: str) -> str:
    chars = " || ".join(f"chr({ord(c)})" for c in SPACE)
    return f"trim({expr}, {chars})"


HEADING_SQL = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"
FIRST_LINE_SQL = "split_part(text, chr(10), 1)"


def netloc_sql(url: str) -> str:
    return (
        "replace(lower(regexp_extract("
        + url
        + r", '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)), 'www.', '')"
    )


def tags_out_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '<[^>]+>', ' ', 'g')"


def content_id_sql(title: str, company: str) -> str:
    def letters(expr: str, n: int) -> str:
        return f"substr(regexp_replace(lower({expr}), '[^a-z0-9]', '', 'g'), 1, {n})"

    return f"substr(md5({letters(title, 30)} || {letters(company, 20)}), 1, 12)"


def word_bounded_sql(expr: str, alternatives: Sequence[str]) -> str:
    """Unicode word bounds, which the oracle's own \\b does not have."""
    body = "|".join(alternatives)
    return rf"regexp_matches({expr}, '(?i)(?:^|[^\pL\pN_])(?:{body})(?:$|[^\pL\pN_])')"


def stamp_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


def thousands_sql(expr: str) -> str:
    return f"format('{{:,}}', CAST(trunc({expr}) AS BIGINT))"
