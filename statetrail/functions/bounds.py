"""Argument checks shared by the query functions."""

from __future__ import annotations

import os

from ..fixed_values import SLA_HOURS


def within(name: str, value, low, high):
    """Return a number between ``low`` and ``high``, or raise ``ValueError``."""
    number = float(value)
    if not low <= number <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {value!r}")
    return number


def whole_number(name: str, value, low: int, high: int) -> int:
    """As :func:`within`, for whole numbers; ``"7"`` counts, ``7.5`` does not."""
    if isinstance(value, float) and not value.is_integer():
        raise ValueError(f"{name} must be a whole number, got {value!r}")
    return int(within(name, int(value), low, high))


def default_sla_hours() -> float:
    return float(os.environ.get("SLA_HOURS", SLA_HOURS))
