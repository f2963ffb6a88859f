"""Scorer responses: one JSON object inside free text, coerced to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fixed
from .text import as_column, text


def json_in_text(c: Column | str) -> Column:
    """P12. From the first ``{`` to the last ``}``, across lines; null when there is none."""
    return F.nullif(F.regexp_extract(text(c), r"(?s)\{.*\}", 0), F.lit(""))


_END = "end of text"


def strict_json(c: Column | str) -> Column:
    """The text as a variant; null unless the whole text is one JSON value.

    ``try_parse_json`` stops after the first value and ignores what follows. Here the value has to be
    the first of two elements, the second of which is a mark.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), as_column(c), F.lit(f', "{_END}"]')))
    bound = F.transform(
        F.array(pair),
        lambda v: F.when(
            F.try_variant_get(v, "$[1]", "string") == _END, F.try_variant_get(v, "$[0]", "variant")
        ),
    )
    return F.get(bound, F.lit(0))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def score_value(value: Column) -> Column:
    """P13. Numbers are cut to whole ones, whole-number texts parsed, booleans count 0 or 1.

    Null means the score cannot be coerced. ``value`` is the variant member, SQL null when missing.
    """
    kind = _kind(value)
    digits = _as(value, "string")
    whole = F.regexp_replace(F.regexp_replace(digits, r"^\s+|\s+$", ""), r"(?<=\d)_(?=\d)", "")
    number = F.when(kind.isin("BIGINT"), _as(value, "bigint")).when(
        kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"),
        _as(value, "double").try_cast("bigint"),
    )
    return (
        F.when(value.isNull(), F.lit(fixed.DEFAULT_SCORE))
        .when(kind == "BOOLEAN", F.when(_as(value, "boolean"), 1).otherwise(0))
        .when((kind == "STRING") & whole.rlike(r"^[+-]?\d+$"), whole.try_cast("int"))
        .otherwise(number.try_cast("int"))
    )


def category_value(value: Column) -> Column:
    """P14. Upper-cased; the default lane when missing; null when it is no string."""
    return F.when(value.isNull(), F.lit(fixed.DEFAULT_LANE)).when(
        _kind(value) == "STRING", F.upper(_as(value, "string"))
    )


def _truthy(value: Column) -> Column:
    kind = _kind(value)
    as_json = F.to_json(value)
    return (
        value.isNotNull()
        & (kind != "VOID")
        & ~as_json.isin('""', "0", "0.0", "-0.0", "false", "[]", "{}")
    )


def parsed_response(
    c: Column | str,
    method: str = fixed.SCORED_METHOD,
    fallback_method: str = fixed.FALLBACK_METHOD,
) -> Column:
    """X2, P12-P14. ``score, category, score_reason, score_method`` of one response text.

    Anything that cannot be read gives the default score and lane with the fallback method. A truthy
    reason that has no prefix (a number, say) counts as unreadable for scores of 4 and more.
    """
    parsed = strict_json(json_in_text(c))
    fields = F.transform(
        F.array(parsed),
        lambda v: F.struct(
            v.isNotNull().alias("found"),
            F.try_variant_get(v, "$.score", "variant").alias("score"),
            F.try_variant_get(v, "$.category", "variant").alias("category"),
            F.try_variant_get(v, "$.reason", "variant").alias("reason"),
        ),
    )
    coerced = F.transform(
        fields,
        lambda f: F.struct(
            F.when(f.found, score_value(f.score)).alias("score"),
            F.when(f.found, category_value(f.category)).alias("category"),
            F.when(f.reason.isNull(), F.lit(""))
            .when(_kind(f.reason) == "STRING", _as(f.reason, "string"))
            .when(_kind(f.reason) != "VOID", F.to_json(f.reason))
            .alias("reason"),
            (_truthy(f.reason) & ~(_kind(f.reason) == "STRING") & ~_kind(f.reason).startswith("ARRAY")).alias("odd"),
        ),
    )
    result = F.transform(
        coerced,
        lambda r: F.when(
            r.score.isNotNull() & r.category.isNotNull(),
            F.when(
                F.coalesce(r.odd, F.lit(False)) & (r.score >= 4),
                _outcome(F.lit(fixed.DEFAULT_SCORE), F.lit(fixed.DEFAULT_LANE), r.reason, fallback_method),
            ).otherwise(_outcome(r.score, r.category, r.reason, method)),
        ).otherwise(fallback_outcome(fallback_method)),
    )
    return F.get(result, F.lit(0))


def _outcome(score: Column, category: Column, reason: Column, method: str) -> Column:
    return F.struct(
        score.cast("int").alias("score"),
        category.cast("string").alias("category"),
        reason.cast("string").alias("score_reason"),
        F.lit(method).alias("score_method"),
    )


def fallback_outcome(fallback_method: str = fixed.FALLBACK_METHOD) -> Column:
    """X2. What a posting gets without a usable response."""
    return _outcome(
        F.lit(fixed.DEFAULT_SCORE), F.lit(fixed.DEFAULT_LANE), F.lit(None).cast("string"), fallback_method
    )
