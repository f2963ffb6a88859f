"""F1-F19, J4, J6, A1, X5 as queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import match
from ..functions.stamps import stamp_like
from ..functions.text import lower_tags
from ..functions.urls import domain_ok
from ..operators import predicates as p
from ..operators.joins import by_terms
from ..operators.policy import Policy, Terms, apply_policy, judged
from ..operators.ranking import split_by_score
from ..operators.report import CountedFunnel, funnel
from ..session import stage
from .base import (
    FIRST_LINE_SQL,
    contains_any_sql,
    first_line,
    netloc_sql,
    quoted,
    query,
    table,
    word_bounded_sql,
)

_MOST_SOURCES = 100
EXCLUDED = ["thre", "über", "estion", "éle", "ñ"]
SIGNALS_OFF = ["license", "cheap", "password", "und der"]
SIGNALS_ON = ["released under", "the ", " la ", "email"]
BLOCKED = ["cheap-pills.example.com", "spam-farm.example.org", "ththre.example"]
RESTRICTING = [r"(the|la)\s+(and|of|de)", r"is\s+only", r"licen[cs]e"]
OPENING = [r"mit\s+license", r"the\s+in", r"(que|le)\s+la"]
BOUND_RESTRICTING = [rf"\b{a}\b" for a in RESTRICTING]
BOUND_OPENING = [rf"\b{a}\b" for a in OPENING]
TITLES = [r"the\s+(of|to|and)", r"est", r"(der|die)", r"in"]
WEIGHTS = {"license": 4.0, "the ": 2.0, " la ": 1.5, "und": 3.0, "http": 2.5, "@": 1.0}

TITLE = FIRST_LINE_SQL


def title_ok_sql(title: str) -> str:
    return f"NOT {contains_any_sql(f'lower({title})', EXCLUDED)}"


def clean_sql(title: str, description: str) -> str:
    return f"""NOT {contains_any_sql(f"lower({title} || ' ' || {description})", SIGNALS_OFF)}"""


def signal_sql(title: str, description: str) -> str:
    return contains_any_sql(f"lower({title} || ' ' || {description})", SIGNALS_ON)


def senior_sql(title: str) -> str:
    return word_bounded_sql(title, TITLES)


def restricted_sql(description: str) -> str:
    return (
        f"(trim({description}) <> '' AND {word_bounded_sql(description, RESTRICTING)} "
        f"AND NOT {word_bounded_sql(description, OPENING)})"
    )


TITLE_OK = title_ok_sql(TITLE)
CLEAN = clean_sql(TITLE, "text")
SIGNAL = signal_sql(TITLE, "text")
SENIOR = senior_sql(TITLE)
RESTRICTED = restricted_sql("text")

TERMS = Terms(
    excluded_titles=EXCLUDED,
    on_site=SIGNALS_OFF,
    remote=SIGNALS_ON,
    restricting=BOUND_RESTRICTING,
    opening=BOUND_OPENING,
    restricting_words=(),
    senior_titles=TITLES,
    blocked_domains=BLOCKED,
)
POLICIES = [
    Policy(f"src{n}", need_clean=n % 2 == 0, need_signal=n % 3 == 0, need_senior_title=n % 5 == 0) for n in range(19)
]
_NUMBER = "CAST(substr(source, 4) AS INT)"
POLICY_SQL = f"""{TITLE_OK} AND NOT {RESTRICTED}
    AND (source = 'src19' OR {_NUMBER} % 2 <> 0 OR {CLEAN})
    AND (source = 'src19' OR {_NUMBER} % 3 <> 0 OR {SIGNAL})
    AND (source = 'src19' OR {_NUMBER} % 5 <> 0 OR {SENIOR})"""


def titled(spark, sf):
    """Documents with their first line as title."""
    return table(spark, sf, "documents").select(
        "doc_id", "source", first_line().alias("title"), F.col("text").alias("description")
    )


@query("term_exclude", f"SELECT doc_id FROM documents WHERE {TITLE_OK}")
def term_exclude(spark, sf):
    return titled(spark, sf).where(p.title_ok("title", EXCLUDED)).select("doc_id")


@query("blocked_domain_filter", f"SELECT page_id FROM pages WHERE NOT {contains_any_sql(netloc_sql('url'), BLOCKED)}")
def blocked_domain_filter(spark, sf):
    return table(spark, sf, "pages").where(domain_ok("url", BLOCKED)).select("page_id")


@query("remote_clean", f"SELECT doc_id FROM documents WHERE {CLEAN}")
def remote_clean(spark, sf):
    return titled(spark, sf).where(p.remote_clean("title", "description", SIGNALS_OFF)).select("doc_id")


@query("term_require", f"SELECT doc_id FROM documents WHERE {SIGNAL}")
def term_require(spark, sf):
    return titled(spark, sf).where(p.remote_signal("title", "description", SIGNALS_ON)).select("doc_id")


@query("two_sided_regex", f"SELECT doc_id FROM documents WHERE {RESTRICTED}")
def two_sided_regex(spark, sf):
    flag = p.residency_only("description", BOUND_RESTRICTING, BOUND_OPENING, ())
    return titled(spark, sf).where(flag).select("doc_id")


@query("relevant_title", f"SELECT doc_id FROM documents WHERE {SENIOR}")
def relevant_title(spark, sf):
    return titled(spark, sf).where(p.senior_title("title", TITLES)).select("doc_id")


@query(
    "tag_overlap_filter",
    f"""SELECT doc_id FROM documents
        WHERE list_has_any(list_transform(string_split(text, ' '), lambda t: lower(t)), ['und', 'license.', 'von', 'was'])
           OR {contains_any_sql(f"lower({TITLE})", ["est", "lead"])}""",
)
def tag_overlap_filter(spark, sf):
    rows = table(spark, sf, "documents")
    hit = p.relevant_tags_or_title(
        lower_tags(F.split("text", " ")), first_line(), ["und", "license.", "von", "was"], ["est", "lead"]
    )
    return rows.where(hit).select("doc_id")


_LOCATION_SQL = "lower(CASE WHEN c_acctbal < 500 THEN 'Worldwide' ELSE r_name || ', ' || c_mktsegment END)"


@query(
    "region_filter",
    f"""SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE NOT ({contains_any_sql(_LOCATION_SQL, ["europe", "european", "asia", "apac", "emea", "africa", "middle east"])}
          AND NOT {contains_any_sql(_LOCATION_SQL, ["americas", "worldwide", "global", "us", "canada"])})""",
)
def region_filter(spark, sf):
    places = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    rows = table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    location = F.when(F.col("c_acctbal") >= 500, F.concat_ws(", ", "r_name", "c_mktsegment"))
    return rows.where(p.region_ok(location)).select("c_custkey")


@query(
    "required_fields",
    f"SELECT doc_id FROM documents WHERE {TITLE} <> '' AND CASE WHEN source = 'src3' THEN '' ELSE source END <> ''",
)
def required_fields(spark, sf):
    company = F.when(F.col("source") != "src3", F.col("source"))
    return titled(spark, sf).where(p.has_required("title", company)).select("doc_id")


@query(
    "location_only",
    rf"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS anchor FROM pages)
        SELECT page_id, anchor FROM t
        WHERE regexp_full_match(lower(anchor), '[a-z .,\-]{{2,40}}') AND {contains_any_sql("lower(anchor)", ["th", "an", "la"])}""",
)
def location_only(spark, sf):
    anchors = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    rows = table(spark, sf, "pages").select("page_id", F.explode(anchors).alias("anchor"))
    return rows.where(p.location_only("anchor", words=["th", "an", "la"]))


_RUN = dt.datetime(2024, 1, 20, 12)


@query("recency_filter", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 3 DAY OR ts IS NULL")
def recency_filter(spark, sf):
    rows = table(spark, sf, "events")
    return rows.where(p.recent("ts", stamp_like(rows, "ts", _RUN), 3)).select("event_id")


@query(
    "attribute_filter",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
def attribute_filter(spark, sf):
    rows = table(spark, sf, "orders")
    wanted = {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"], "workplace": ["remote"]}
    return rows.where(p.attributes_match(rows, wanted)).select("o_orderkey")


@query("run_day_gate", "SELECT event_id FROM events WHERE day(ts) % 3 = 0")
def run_day_gate(spark, sf):
    return table(spark, sf, "events").where(p.gate_column(F.col("ts"))).select("event_id")


@query(
    "score_threshold",
    "SELECT event_id, value >= 3 AS kept FROM events",
)
def score_threshold(spark, sf):
    rows = table(spark, sf, "events").withColumn("score", F.floor("value"))
    kept, dropped = split_by_score(rows)
    return kept.select("event_id", F.lit(True).alias("kept")).unionByName(
        dropped.select("event_id", F.lit(False).alias("kept"))
    )


@query("lane_split", "SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'signup')")
def lane_split(spark, sf):
    return table(spark, sf, "events").where(p.in_lane("event_type", ["purchase", "signup"])).select("event_id", "event_type")


@query("policy_matrix", f"SELECT doc_id FROM documents WHERE {POLICY_SQL}")
def policy_matrix(spark, sf):
    return apply_policy(titled(spark, sf), POLICIES, TERMS, source="source").select("doc_id")


@query(
    "source_funnel",
    f"""SELECT source, count(*) AS fetched, count(*) FILTER (WHERE {POLICY_SQL}) AS kept,
               count(*) FILTER (WHERE {RESTRICTED}) AS residency_dropped, count(*) FILTER (WHERE text <> '') AS enriched
        FROM documents GROUP BY source""",
)
def source_funnel(spark, sf):
    rows = titled(spark, sf).select("*", *[F.lit("").alias(c) for c in ("company", "url", "salary", "posted")])
    return funnel(judged(rows, POLICIES, TERMS, "source"))


@query(
    "query_funnel",
    f"""SELECT source AS kind, CAST(doc_id % 7 AS INT) AS batch_seq, count(*) AS fetched, count(*) FILTER (WHERE {POLICY_SQL}) AS kept,
               count(*) FILTER (WHERE {RESTRICTED}) AS residency_dropped, count(*) FILTER (WHERE text <> '') AS enriched
        FROM documents GROUP BY ALL""",
)
def query_funnel(spark, sf):
    """A1 per kind of feed and batch, which is one query of the feed."""
    batch = (F.col("doc_id") % 7).cast("int").alias("batch_seq")
    rows = titled(spark, sf).select("*", batch, F.col("source").alias("kind"), *[F.lit("").alias(c) for c in ("company", "url", "salary", "posted")])
    return funnel(judged(rows, POLICIES, TERMS, "source"), "kind", "batch_seq")


@query(
    "term_list_anti_join",
    "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))",
)
def term_list_anti_join(spark, sf):
    terms = table(spark, sf, "benchmark").select(F.col("text").alias("term"))
    return by_terms(table(spark, sf, "documents"), terms, "text", "left_anti").select("doc_id")


@query(
    "term_list_semi_join",
    "SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))",
)
def term_list_semi_join(spark, sf):
    terms = table(spark, sf, "benchmark").select(F.col("text").alias("term"))
    return by_terms(table(spark, sf, "documents"), terms, "text", "left_semi").select("doc_id")


@query(
    "term_list_long",
    """WITH t AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS term FROM benchmark)
       SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM t WHERE length(term) > 9 AND contains(d.text, term))""",
)
def term_list_long(spark, sf):
    """J4 with many terms: the long words of the benchmark."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("term"))
    return by_terms(table(spark, sf, "documents"), words.where(F.length("term") > 9), "text", "left_semi").select("doc_id")


_HITS_SQL = " + ".join(f"CASE WHEN contains(lower(text), {quoted(t)}) THEN {w} ELSE 0 END" for t, w in WEIGHTS.items())


@query("keyword_score", f"SELECT doc_id, CAST(least(10, {_HITS_SQL}) AS DOUBLE) AS score FROM documents")
def keyword_score(spark, sf):
    return table(spark, sf, "documents").select("doc_id", match.keyword_score("text", WEIGHTS).alias("score"))


@query(
    "counted_funnel",
    f"""SELECT source, count(*) AS fetched, count(*) FILTER (WHERE {POLICY_SQL}) AS kept,
               count(*) FILTER (WHERE {RESTRICTED}) AS residency_dropped, count(*) FILTER (WHERE text <> '') AS enriched
        FROM documents GROUP BY source""",
)
def counted_funnel(spark, sf):
    """A1 in the pass that writes the judged rows. The sources are those of the table, as a run knows those of its feeds."""
    rows = titled(spark, sf).select("*", *[F.lit("").alias(c) for c in ("company", "url", "salary", "posted")])
    sources = [r.source for r in rows.select("source").distinct().limit(_MOST_SOURCES).collect() if r.source is not None]
    counted = CountedFunnel(judged(rows, POLICIES, TERMS, "source"), sources)
    return counted.funnel(stage(counted.rows.select("source", "kept", "restricted", "enriched")))
