"""Prompt and response text checks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINISHED = ("stop", "length", "eos_token", "done", "success")


def token_estimate(text: Column) -> Column:
    """A token for every four characters, rounded up."""
    return F.ceil(F.char_length(text) / 4).cast("long")


def words(text: Column) -> Column:
    trimmed = F.regexp_replace(text, "^\\s+|\\s+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "\\s+"))


def repeats_trigram(text: Column) -> Column:
    """Whether three words are followed by the same three."""


    def repeats(w: Column) -> Column:
        at = F.when(F.size(w) >= 6, F.sequence(F.lit(1), F.size(w) - 5))
        return F.exists(at, lambda i: F.slice(w, i, 3) == F.slice(w, i + 3, 3))

    # the words are bound once: inside the lambda they would be split again for each place
    return F.coalesce(F.transform(F.array(words(text)), repeats)[0], F.lit(False))


def response_warnings(text: Column, leaks: list[str] | None = None, finish: Column | None = None) -> Column:
    """Names of the failed checks, in order. An empty or blank response gets that one warning alone.

    leaks: parts of the system prompt that no response may quote, with or without their full stop; what follows ``the query was:`` is not looked at.
    """
    stripped = F.regexp_replace(text, "^\\s+|\\s+$", "")
    seen = F.substring_index(F.lower(text), "the query was:", 1)
    leaked = F.lit(False)
    for part in leaks or ():
        leaked = leaked | F.contains(seen, F.lit(part.lower().rstrip(".")))
    checks = [
        (F.contains(text, F.lit("�")), "invalid characters"),
        (F.char_length(stripped) < 10, "too short"),
        (F.char_length(text) > 10000, "too long"),
        (repeats_trigram(text), "repetition"),
        (leaked, "prompt leakage"),
    ]
    if finish is not None:
        checks.append((~F.lower(finish).isin(*FINISHED), "finish reason"))
    rest = F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in checks)))
    return F.when(text.isNull() | (text == ""), F.array(F.lit("empty"))).when(stripped == "", F.array(F.lit("whitespace only"))).otherwise(rest)
