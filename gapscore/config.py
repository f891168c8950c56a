"""Scoring configuration: required fields, supported goals, thresholds."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

# The fields a configuration must have.
REQUIRED_FIELDS = (
    "version",
    "minimum_score_to_pass",
    "log_score_details",
    "model_goals_supported",
    "default_goal_model",
)


class ConfigError(ValueError):
    """The configuration is unreadable or incomplete."""


@dataclass(frozen=True)
class Config:
    version: str
    minimum_score_to_pass: float
    log_score_details: bool
    supported_goals: tuple[str, ...]
    default_goal: str
    # Declared switches; the extensions in operators/extensions.py read them.
    case_sensitive: bool = False
    partial_match_threshold: float = 0.8
    requests_per_minute: int = 60
    rate_limit_enabled: bool = False
    anonymize_student_data: bool = False
    collect_usage_metrics: bool = False
    store_request_history: bool = False
    alert_threshold_score: float = 0.3

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> Config:
        missing = [field for field in REQUIRED_FIELDS if field not in raw]
        if missing:
            raise ConfigError(f"Missing required config field: {', '.join(missing)}")
        matching = raw.get("skill_matching", {})
        limit = raw.get("api", {}).get("rate_limit", {})
        analytics = raw.get("analytics", {})
        return cls(
            version=str(raw["version"]),
            minimum_score_to_pass=float(raw["minimum_score_to_pass"]),
            log_score_details=bool(raw["log_score_details"]),
            supported_goals=tuple(dict.fromkeys(raw["model_goals_supported"])),
            default_goal=raw["default_goal_model"],
            case_sensitive=matching.get("case_sensitive", False),
            partial_match_threshold=matching.get("partial_match_threshold", 0.8),
            requests_per_minute=limit.get("requests_per_minute", 60),
            rate_limit_enabled=limit.get("enabled", False),
            anonymize_student_data=analytics.get("anonymize_student_data", False),
            collect_usage_metrics=analytics.get("collect_usage_metrics", False),
            store_request_history=analytics.get("store_request_history", False),
            alert_threshold_score=raw.get("notification", {}).get("alert_threshold_score", 0.3),
        )


def load_config(spark: SparkSession, path: str) -> Config:
    """Read one JSON configuration file from any file system Spark can reach."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        raise ConfigError(f"{path} is empty")
    try:
        raw = json.loads(text.value)
    except json.JSONDecodeError as error:
        raise ConfigError(f"{path} is not valid JSON: {error}") from error
    return Config.from_dict(raw)
