"""A training corpus from raw documents, in stages that are written and read again.

Each stage takes all that its predecessor kept and gives rows with the columns of ``documents``, whatever they are
named; the last gives the pieces of the packed sequences.

Edge cases: null and empty texts, and those without a letter, go in the first stage. Rows with a null doc_id cannot be
told apart by the deduplicating stages: line dedup and the n-gram join leave them as they are, as does
decontamination. Of repeated rows, and of rows with one doc_id and text, the n-gram join keeps one; rows that share a
doc_id but not the text go or stay together. Of documents that tie as the first of their group the smallest doc_id
stays. Long texts are taken whole in every stage. Empty tables give empty tables. Nulls in other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postsieve.llm import decontamination, language_id, line_dedup, ngram_join, packing
from postsieve.llm.common import free_name
from postsieve.llm.queries import language_model, table, tokenizer_file
from postsieve.session import stage

MIN_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those of which no language is likely, go."""
    language, chance = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = language_id.with_language(docs, language_model(docs), names=(language, chance))
    kept = (F.col(language) != language_id.UNKNOWN) & (F.col(chance) >= MIN_SCORE)
    return found.where(kept).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks that an earlier document has are cut out; documents of which nothing is left go."""
    lines, removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    cut = line_dedup.without_blocks(docs, counts=(lines, removed))
    left = (F.col(removed) == 0) | F.col("text").rlike(r"\S")
    chars = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return cut.where(left).withColumn("n_chars", chars).select(docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by near-equal n-gram sets the one with the smallest doc_id stays, once."""
    first = ngram_join.classes_of(docs).where("doc_id = component_id").select("doc_id").distinct()
    digest = free_name(docs, "digest")
    kept = docs.join(first, "doc_id", "left_semi").withColumn(digest, F.xxhash64("text"))
    kept = kept.dropDuplicates(["doc_id", digest]).select(docs.columns)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    index = decontamination.write_index(docs)
    found = decontamination.contamination(index, table(spark, sf_dir, "benchmark"))
    return docs.join(found.where(F.size("spans") > 0).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens with their ids."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_near),
    ("benchmark_decontamination", decontaminate),
    ("sequence_packing", pack_sequences),
]

# Training, alignment and tokenizers have no SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stage(docs)
    return docs
