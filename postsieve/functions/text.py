"""Text functions: whitespace, tags, truncation, splitting, ids, stamps, base64url."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .. import fixed_values as fixed

# What counts as whitespace: tab to carriage return, the four separators, space, next line, no-break
# space and the Unicode space separators.
SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used.

    Inside array functions the same subexpression is evaluated as often as it is written; a lambda
    variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text(c: Column | str) -> Column:
    """Null and missing count as the empty string."""
    return F.coalesce(as_column(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """P1. Spark's ``trim`` takes spaces only, so the whole whitespace set is given to ``btrim``."""
    return F.btrim(text(c), F.lit(SPACE))


def strip_tags(c: Column | str) -> Column:
    """P2. Each tag becomes one space; entities and script text stay."""
    return F.regexp_replace(text(c), "<[^>]+>", " ")


def truncate(c: Column | str, chars: int) -> Column:
    """P3. The first ``chars`` code points."""
    return F.substring(text(c), 1, chars)


def before_first(c: Column | str, separator: str) -> Column:
    return F.substring_index(text(c), separator, 1)


def company_and_title(c: Column | str) -> Column:
    """P5. ``Company: Title`` split at the first ``": "``; without it the company is empty."""
    value = text(c)
    at = F.instr(value, F.lit(": "))
    return F.struct(
        F.when(at > 0, F.substring(value, F.lit(1), at - 1)).otherwise("").alias("company"),
        F.when(at > 0, F.substring(value, at + 2, F.length(value))).otherwise(value).alias("title"),
    )


def lower_tags(c: Column | str) -> Column:
    """P11."""
    return F.transform(F.coalesce(as_column(c), F.array().cast("array<string>")), F.lower)


def default_text(c: Column | str, default: str) -> Column:
    """P17. Null and the empty string both give the default."""
    return F.coalesce(F.nullif(as_column(c), F.lit("")), F.lit(default))


def content_id(
    title: Column | str,
    company: Column | str,
    title_chars: int = fixed.ID_TITLE_CHARS,
    company_chars: int = fixed.ID_COMPANY_CHARS,
    id_chars: int = fixed.ID_CHARS,
) -> Column:
    """P9. Letters and digits of title and company, hashed."""

    def letters(c: Column | str, n: int) -> Column:
        return F.substring(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]", ""), 1, n)

    return F.substring(F.md5(F.concat(letters(title, title_chars), letters(company, company_chars))), 1, id_chars)


def score_bar(score: Column | str, dots: int = fixed.SCORE_DOTS) -> Column:
    """P15. Filled dots up to the score, hollow ones for the rest."""
    filled = F.least(F.coalesce(as_column(score), F.lit(0)), F.lit(dots)).cast("int")
    return F.concat(
        F.repeat(F.lit("●"), F.greatest(filled, F.lit(0))),
        F.repeat(F.lit("○"), F.greatest(F.lit(0), F.lit(dots) - filled)),
    )


def base64url_text(c: Column | str) -> Column:
    """P16. Null where the padding is wrong; foreign characters are ignored, invalid UTF-8 is replaced."""
    foreign = "[^A-Za-z0-9+/=]"
    standard = as_column(c)
    for old, new in (("-", "+"), ("_", "/"), ("\r", ""), ("\n", "")):
        standard = F.replace(standard, F.lit(old), F.lit(new))

    def parts(clean: Column) -> Column:
        body = F.substring_index(clean, "=", 1)
        pads = F.length(F.regexp_extract(F.substring(clean, F.length(body) + 1, F.length(clean)), "^=*", 0))
        return F.struct(body.alias("body"), pads.alias("pads"), (F.length(body) % 4).alias("rest"))

    def decoded(part: Column) -> Column:
        padded = (
            (part.rest == 0) | ((part.rest == 2) & (part.pads >= 2)) | ((part.rest == 3) & (part.pads >= 1))
        )
        full = F.concat(part.body, F.repeat(F.lit("="), (F.lit(4) - part.rest) % 4))
        return F.when(padded, F.make_valid_utf8(F.try_to_binary(full, F.lit("base64")).cast("string")))

    def strict(t: Column) -> Column:
        whole = (F.length(t) % 4 == 0) & ~F.contains(t, F.lit(" ")) & ~F.contains(t, F.lit("\t"))
        return F.when(whole, F.make_valid_utf8(F.try_to_binary(t, F.lit("base64")).cast("string")))

    # Clean text decodes at once; the slower way is for texts with foreign characters or odd padding.
    clean = F.regexp_replace(standard, foreign, "")
    return F.coalesce(bind(standard, strict), bind(bind(clean, parts), decoded))
