"""Verifiers: functions over snapshots that give a score."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Verdict:
    """score from 0 to 1; what the function returned; the error it ended with, if any."""

    score: float
    result: object = None
    error: str | None = None


def score_of(result) -> float:
    """A result as a score: a number, a mapping with score or an object with one; ValueError for others."""
    if isinstance(result, Mapping) and "score" in result:
        result = result["score"]
    elif not isinstance(result, (bool, int, float)) and hasattr(result, "score"):
        result = result.score
    if not isinstance(result, (bool, int, float)):
        raise ValueError(f"no score: {type(result).__name__}")
    number = float(result)
    return 0.0 if number != number else min(1.0, max(0.0, number))


def verified(verifier: Callable, *args, **kwargs) -> Verdict:
    """The verifier's verdict on its arguments (snapshots, usually). A failed check is a score of 0 with its message."""
    try:
        result = verifier(*args, **kwargs)
        return Verdict(score_of(result), result)
    except Exception as e:
        return Verdict(0.0, None, f"{type(e).__name__}: {e}")
