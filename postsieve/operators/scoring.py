"""Scoring as tables: requests out, responses in (P19, P20, X1-X3). No call leaves the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from ..functions.responses import fallback_outcome, json_in_text, parsed_response, strict_json
from ..functions.text import strip, text, truncate
from ..schemas import EVALUATION
from ..shipping import ship_by_value

ship_by_value(__name__)

# Request layouts; ``%s`` is the caller's instruction, then the labelled fields.
FULL_REQUEST = "%s\n\nJOB:\nTitle: %s\nCompany: %s\nSalary: %s\nDescription: %s"
TITLE_REQUEST = "%s\n\nJOB:\nTitle: %s\nCompany: %s\n\n%s"


def request_text(
    instruction: str = "",
    title_instruction: str = "",
    title_closing: str = "",
    chars: int = fixed.REQUEST_CHARS,
) -> Column:
    """P20. With salary and description where there is a description, by title alone elsewhere."""
    full = F.format_string(
        FULL_REQUEST, F.lit(instruction), text("title"), text("company"), text("salary"), truncate("description", chars)
    )
    short = F.format_string(
        TITLE_REQUEST, F.lit(title_instruction), text("title"), text("company"), F.lit(title_closing)
    )
    return F.when(strip("description") != "", full).otherwise(short)


def score_requests(admitted: DataFrame, key: str = "id", **texts: str) -> DataFrame:
    """X1, first half: one request per admitted posting."""
    return admitted.select(key, request_text(**texts).alias("request"))


def one_response_per_id(responses: DataFrame, key: str = "id") -> DataFrame:
    """A posting gets one response. Should a retry have landed two, the same one is taken each time."""
    return responses.groupBy(key).agg(F.min("text").alias("text"))


def apply_responses(
    admitted: DataFrame,
    responses: DataFrame | None,
    key: str = "id",
    method: str = fixed.SCORED_METHOD,
) -> DataFrame:
    """X1, second half, and X2. Ids are unique after admission, so the join has no hot key."""
    if responses is None:
        return admitted.select("*", fallback_outcome().alias("_r")).select(*admitted.columns, "_r.*")
    told = one_response_per_id(responses, key).withColumnRenamed("text", "_text")
    return (
        admitted.join(told, key, "left")
        .withColumn("_r", parsed_response("_text", method))
        .select(*admitted.columns, "_r.*")
    )


def score_with(
    admitted: DataFrame,
    scorer: Callable[[pd.Series], pd.Series],
    key: str = "id",
    method: str = fixed.SCORED_METHOD,
    **texts: str,
) -> DataFrame:
    """X1 with a caller's function from request texts to response texts, run on the executors.

    A batch whose call raises is asked again row by row, so that only the rows that raise get no response and
    so the fallback.
    """
    columns = admitted.columns
    asked = admitted.withColumn("_request", request_text(**texts)).withColumn("_text", F.lit(None).cast("string"))

    def asked_one_by_one(requests: pd.Series) -> Iterator[str | None]:
        for k in range(len(requests)):
            try:
                yield next(iter(scorer(requests.iloc[k : k + 1])))
            except Exception:
                yield None

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                answers = list(scorer(batch["_request"]))
            except Exception:
                answers = list(asked_one_by_one(batch["_request"]))
            batch["_text"] = pd.Series(answers, index=batch.index, dtype=object)
            yield batch

    return (
        asked.mapInPandas(call, asked.schema)
        .withColumn("_r", parsed_response("_text", method))
        .select(*columns, "_r.*")
    )


# --- single evaluations ----------------------------------------------------------------------------


def request_block(
    title: Column | str = "title",
    company: Column | str = "company",
    salary: Column | str = "salary",
    url: Column | str = "url",
    description: Column | str = "description",
    chars: int = fixed.EVALUATION_CHARS,
) -> Column:
    """P19. Labelled lines; empty ones are left out, the description follows a blank line."""

    def line(label: str, c: Column | str) -> Column:
        return F.when(text(c) != "", F.concat(F.lit(label), text(c)))

    body = F.when(text(description) != "", F.concat(F.lit("\nDescription:\n"), truncate(description, chars)))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), text(title)),
        F.concat(F.lit("Company: "), text(company)),
        line("Salary: ", salary),
        line("URL: ", url),
        body,
    )


def evaluation_requests(requests: DataFrame, instruction: str = "") -> DataFrame:
    """X3, first half: the prompt of each accepted request, null for the others."""
    prompt = F.concat(F.lit(f"{instruction}\n\nJOB TO EVALUATE:\n"), request_block())
    return requests.withColumn("prompt", F.when(F.col("status").isNull(), prompt))


def evaluations(requests: DataFrame, responses: DataFrame, key: str = "request_id") -> DataFrame:
    """X3, second half: the eight answer fields, or an error text."""
    told = one_response_per_id(responses, key).withColumnRenamed("text", "_text")
    found = json_in_text("_text")
    answer = F.from_json(found, EVALUATION)
    readable = strict_json(found).isNotNull()
    error = (
        F.when(F.col("status").isNotNull(), F.col("status"))
        .when(F.col("_text").isNull(), F.lit("No response"))
        .when(found.isNull(), F.lit("No JSON in response"))
        .when(~readable, F.lit("Invalid JSON in response"))
    )
    return (
        requests.join(told, key, "left")
        .withColumn("error", error)
        .withColumn("_answer", F.when(F.col("error").isNull(), answer))
        .select(key, "_answer.*", "error")
    )
