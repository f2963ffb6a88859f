"""Url functions. None of them uses ``parse_url``, which raises on odd urls under ANSI rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from .. import fixed_values as fixed
from .match import contains_any
from .text import as_column, before_first, text

# Up to the path, with at most one pair of brackets (an address literal).
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#\[\]]*(?:\[[^/?#\[\]]*\][^/?#\[\]]*)?)(?=[/?#]|$)"


def first_url(*candidates: Column | str) -> Column:
    """P6. The first candidate that is not empty."""
    return F.coalesce(*[F.nullif(as_column(c), F.lit("")) for c in candidates], F.lit(""))


def netloc(c: Column | str) -> Column:
    """P10. Between ``//`` and ``/?#``, with user and port; lower-cased, every ``www.`` removed.

    Empty when there is none, and when the brackets of an address literal do not pair: such a url
    cannot be parsed.
    """
    clean = F.translate(F.regexp_replace(text(c), r"^[\x00-\x20]+", ""), "\t\r\n", "")
    return F.replace(F.lower(F.regexp_extract(clean, _NETLOC, 1)), F.lit("www."), F.lit(""))


def domain_ok(c: Column | str, blocked: Sequence[str] = tuple(fixed.BLOCKED_DOMAINS)) -> Column:
    """F2. No blocked domain is a substring of the network location; an unparsable url passes."""
    return ~contains_any(netloc(c), blocked)


def without_query(c: Column | str) -> Column:
    return before_first(c, "?")


def query_value(c: Column | str, name: str) -> Column:
    """Decoded first non-empty value of a query parameter, null when there is none."""
    query = F.regexp_extract(text(c), r"^[^?#]*\?([^#]*)", 1)
    raw = F.nullif(F.regexp_extract(query, rf"(?:^|&)\Q{name}\E=([^&]+)", 1), F.lit(""))
    return F.try_url_decode(raw)


def canonical_url(
    c: Column | str,
    parameter: str = fixed.EXTERNAL_ID_PARAMETER,
    url_format: str = fixed.EXTERNAL_URL_FORMAT,
) -> Column:
    """P7. Without its query; rebuilt from the id parameter where that has a value."""
    value = query_value(c, parameter)
    return F.when(
        F.contains(text(c), F.lit(parameter + "=")) & value.isNotNull(),
        F.format_string(url_format, value),
    ).otherwise(without_query(c))


def external_id(c: Column | str, patterns: Sequence[str] = tuple(fixed.EXTERNAL_ID_PATTERNS)) -> Column:
    """P8. The first pattern that hits gives the id; null when none does."""
    hits = [F.nullif(F.regexp_extract(text(c), f"(?U){p}", 1), F.lit("")) for p in patterns]
    return reduce(lambda a, b: F.coalesce(a, b), hits)


def url_in_line(c: Column | str, line_pattern: str = fixed.LINE_URL_PATTERN) -> Column:
    """P22. The posting url inside a line, empty when there is none."""
    return F.regexp_extract(text(c), f"(?U){line_pattern}", 0)
