"""Single evaluations as a batch: request bodies to prompts, responses to answers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.scoring import evaluation_requests, evaluations
from ..sources.requests import evaluation_inputs


def prompts(landed: DataFrame, instruction: str = "", key: str = "request_id") -> DataFrame:
    return evaluation_requests(evaluation_inputs(landed, key), instruction)


def answers(landed: DataFrame, responses: DataFrame, key: str = "request_id") -> DataFrame:
    return evaluations(evaluation_inputs(landed, key), responses, key)
