"""Batch scoring: requests in, responses and rejected requests out."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from gapscore.config import Config
from gapscore.operators.linear import GoalModels
from gapscore.operators.score import Dimensions, observe_usage, observed_usage, score
from gapscore.sources.requests import check_fields, rejected, usable
from gapscore.storage import local_table


class Answers(NamedTuple):
    """What becomes of requests: each is in one of the two tables."""

    responses: DataFrame
    rejected: DataFrame


def respond(requests: DataFrame, dims: Dimensions, models: GoalModels | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Responses to complete requests. Without a matched skill the score is 0. ``keep`` names columns to carry along.

    Per request this is one pass over its row: the lookups are broadcast dictionaries and no
    step regroups the requests. Requests are typed, or bodies from ``parse_bodies``.
    """
    return score(usable(requests), dims, models, zero_without_match=True, keep=keep)


def rejects(requests: DataFrame) -> DataFrame:
    """The other requests, each with ``details``: what is wrong with which field."""
    return rejected(check_fields(requests))


def answer(requests: DataFrame, dims: Dimensions, models: GoalModels | None = None) -> Answers:
    return Answers(respond(requests, dims, models), rejects(requests))


def write_responses(responses: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    responses.write.mode(mode).format(fmt).save(path)


def write_responses_with_usage(
    responses: DataFrame, path: str, config: Config, fmt: str = "parquet", mode: str = "append"
) -> DataFrame:
    """Write responses and return the usage figures (goal, scores and averages), collected in the same pass.

    Without ``collect_usage_metrics`` in the configuration there are none.
    """
    figures = "goal_used STRING, scored BIGINT, avg_score DOUBLE, avg_matched DOUBLE, avg_missing DOUBLE"
    if not config.collect_usage_metrics:
        write_responses(responses, path, fmt, mode)
        return local_table(responses.sparkSession, [], figures)
    observed, observation = observe_usage(responses, config)
    write_responses(observed, path, fmt, mode)
    return local_table(responses.sparkSession, observed_usage(observation, config), figures)


def write_answers(answers: Answers, folder: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Responses and rejected requests, in a folder each."""
    write_responses(answers.responses, f"{folder}/responses", fmt, mode)
    write_responses(answers.rejected, f"{folder}/rejected", fmt, mode)
