"""The operators here as queries over the shared tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import new_folder
from . import (
    centroids, decontamination, embedding_dedup, filter_audit, language_id, line_dedup, ngram_join, packing, recurrent_lm, substring_dedup,
    token_codes, url_filters, warc,
)
from .common import sha256_hex

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


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- 8 -------------------------------------------------------------------------------------------------

LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN_WORDS_SQL = rf"regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({PLAIN_WORDS_SQL}, []) AS w FROM documents),
b AS (SELECT item_id, {PLAIN_WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, w[i : i + least(10, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT len(win) AS k FROM iw),
dw AS (
  SELECT doc_id, i, k, w[i : i + k - 1] AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lengths WHERE len(w) >= k)
),
m AS (SELECT doc_id, i, k, item_id FROM dw JOIN iw USING (win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op8_benchmark_decontamination", DECONTAMINATION_SQL)
def op8_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    index = decontamination.write_index(table(spark, sf, "documents"))
    found = decontamination.contamination(index, table(spark, sf, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        sha256_hex(F.array_join(ids, ",")).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


# --- 2, 7: texts are encoded by a library, which SQL does not have -----------------------------------------


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_token_codes")
def op2_token_codes(spark: SparkSession, sf: str) -> DataFrame:
    path, files = token_codes.write_codes(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return token_codes.read_codes(spark, path, files)


@query("op7_sequence_packing")
def op7_sequence_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json")).drop("ids")


# --- 9 -------------------------------------------------------------------------------------------------

WORDS_SQL = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
x AS (SELECT doc_id, i, w[i : i + 12] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT win, min(doc_id) AS first FROM x GROUP BY win),
r AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM x JOIN f USING (win) WHERE first < doc_id
),
k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN r USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@query("op9_substring_dedup", SUBSTRING_DEDUP_SQL)
def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", sha256_hex("kept").alias("kept_sha256"))


# --- 3 -------------------------------------------------------------------------------------------------

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT payload, max(page_id) AS last FROM p WHERE strlen(payload) >= 1000 GROUP BY payload)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN g USING (payload)
"""


@query("op3_warc", WARC_SQL)
def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write_archives(warc.page_records(table(spark, sf, "pages")), path)
    return warc.archived_pages(spark, path)


# --- 5 -------------------------------------------------------------------------------------------------

NGRAM_JOIN_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER_SQL}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i : i + least(5, len(w)) - 1] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL
),
l AS (
  SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 75 * (na.n + nb.n - o)
),
r(node, seen) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(seen) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n.n
"""


@query("op5_ngram_jaccard_join", NGRAM_JOIN_SQL)
def op5_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.classes_of(table(spark, sf, "documents"))


# --- 4 -------------------------------------------------------------------------------------------------

EMBEDDING_DEDUP_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (
  SELECT vec_id, v FROM e
  WHERE v IS NOT NULL AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0
),
l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.95
),
r(node, seen) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, min(seen) AS component_id, min(seen) = e.vec_id AS kept
FROM e LEFT JOIN n USING (vec_id) JOIN r ON r.node = e.vec_id GROUP BY e.vec_id, n
"""


@query("op4_embedding_near_dedup", EMBEDDING_DEDUP_SQL)
def op4_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf, "embeddings"))


# --- 6: patience diff is an algorithm over sequences, which SQL does not express ----------------------------


@query("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", sha256_hex(F.coalesce("kept", F.lit(""))).alias("kept_sha256"))


# --- 1: a trained model ------------------------------------------------------------------------------------


def held_out(modulus: int) -> Column:
    """Rows that nothing is learned from; rows without doc_id are none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 2, F.lit(False))


def language_model(docs: DataFrame) -> language_id.Model:
    return language_id.learn(docs.where(~held_out(4)))


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    predicted = language_id.with_language(docs.drop("lang"), language_model(docs))
    return predicted.select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score")


# --- 10: a trained model -----------------------------------------------------------------------------------


@query("op10_recurrent_lm")
def op10_recurrent_lm(spark: SparkSession, sf: str) -> DataFrame:
    scored = recurrent_lm.score(table(spark, sf, "documents"), ~held_out(7))
    return scored.select("doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# --- 11 ------------------------------------------------------------------------------------------------

URL_RULES = [
    ("org/", url_filters.ALLOW), ("example.org/es/", url_filters.BLOCK), ("example.org/en/1", url_filters.BLOCK),
    ("com/fr/", url_filters.ALLOW), ("com/de/", url_filters.BLOCK),
]


def url_rules_sql(rules: list[tuple[str, str]]) -> str:
    rows = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        host, slash, path = rule.partition("/")
        rows.append(f"{{'rule': '{rule}', 'host': '{host}', 'path': '{slash + path}', 'verdict': '{verdict}'}}")
    return "[" + ", ".join(rows) + "]"


URL_FILTERS_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
),
f AS (
  SELECT page_id, host, path, list_filter({url_rules_sql(URL_RULES)},
    lambda r: (host = r.host OR ends_with(host, '.' || r.host)) AND starts_with(path, r.path))[1] AS best
  FROM p
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, '{url_filters.ALLOW}') AS verdict FROM f
"""


@query("op11_url_filters", URL_FILTERS_SQL)
def op11_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return url_filters.judge(table(spark, sf, "pages"), url_filters.fixed_rules(spark, URL_RULES))


# --- 12 ------------------------------------------------------------------------------------------------

FILTER_ORDERS_SQL = ", ".join(f"('{''.join(o)}')" for o in permutations("ABCDE"))

FILTER_AUDIT_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
c AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT t.*, regexp_extract_all(text, '[^ 	-]+') AS words FROM t),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN least < w.doc_id THEN 'E' ELSE '' END AS failed
  FROM w JOIN c USING (text) LEFT JOIN l ON l.doc_id = w.doc_id
),
g AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
o(filter_order) AS (VALUES {FILTER_ORDERS_SQL}),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)
),
r AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN contains(failed, letter) AND translate(failed, before, '') = failed THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(failed, letter) AND translate(failed, before, '') <> failed THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(failed, letter) AND translate(failed, before, '') = failed THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(failed, letter) AND translate(failed, before, '') = failed THEN toxic ELSE 0 END) AS toxic_lost,
    sum(CASE WHEN translate(failed, before || letter, '') = failed THEN n ELSE 0 END) AS kept
  FROM g, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""


@query("op12_filter_audit", FILTER_AUDIT_SQL)
def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


# --- 13 ------------------------------------------------------------------------------------------------


def centroids_sql(rounds: int = centroids.ROUNDS) -> str:
    """The rounds one after the other; sums are divided towards minus infinity in integers."""
    nearest = """
a{r} AS MATERIALIZED (
  SELECT k, vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT k, vec_id, v.x, c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - m.x[i]) * (v.x[i] - m.x[i]))) AS d FROM v, m{r} m
  ) GROUP BY k, vec_id, x
)"""
    moved = """
s{r} AS MATERIALIZED (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i
  ) GROUP BY c
),
m{next} AS MATERIALIZED (SELECT c, coalesce(s{r}.x, m{r}.x) AS x FROM m{r} LEFT JOIN s{r} USING (c))"""
    steps = [nearest.format(r=r) + "," + moved.format(r=r, next=r + 1) for r in range(rounds)] + [nearest.format(r=rounds)]
    return f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, list_transform(e, lambda x: CAST(floor(256 * x) AS BIGINT)) AS x FROM e
  WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), x) - 1 AS c, x FROM v WHERE vec_id IS NOT NULL
  ORDER BY c LIMIT {centroids.CENTROIDS}
),{",".join(steps)}
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(list_aggregate(m{rounds}.x, 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} JOIN m{rounds} USING (c)
"""


@query("op13_centroid_clustering", centroids_sql())
def op13_centroid_clustering(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.clustering(table(spark, sf, "embeddings"))
