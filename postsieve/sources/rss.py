"""RSS responses to postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as fixed
from .. import schemas
from ..functions.text import company_and_title, strip, strip_tags, text, truncate
from ..operators.predicates import has_required
from .landed import position, posting

_KEEP_SPACES = {"ignoreSurroundingSpaces": "false"}


def rss_postings(landed: DataFrame, source: str = fixed.RSS, chars: int = fixed.FEED_CHARS) -> DataFrame:
    """S4. Items titled ``Company: Title``; no domain test. All feeds are one batch."""
    items = landed.select(
        "batch_seq",
        "payload_seq",
        F.posexplode(F.from_xml("payload", schemas.RSS_PAYLOAD, _KEEP_SPACES).channel.item).alias("index", "j"),
    )
    j = F.col("j")
    split = items.select("batch_seq", "payload_seq", "index", "j", company_and_title(j.title).alias("t"))
    return split.where(has_required("t.title", j.link)).select(
        *posting(
            source,
            title=strip("t.title"),
            company=strip("t.company"),
            url=text(j.link),
            description=truncate(strip_tags(j.description), chars),
        ),
        "batch_seq",
        position(F.col("index")),
    )
