"""Streaming use of the stateless operators: rules, metrics, features and text work on a streaming table as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.filtering import Config, Group, Rule, apply_rules


def filter_stream(stream: DataFrame, rules: list[Rule | Group], config: Config | None = None) -> DataFrame:
    """The rows of a stream that pass the HARD rules, with their soft score: one projection, no state, any output mode."""
    if not stream.isStreaming:
        raise ValueError("not a streaming table")
    return apply_rules(stream, rules, config).where("hard_passed")
