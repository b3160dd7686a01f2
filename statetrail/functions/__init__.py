from .bounds import default_sla_hours, whole_number, within
from .payload import technician, technician_id_or_name
from .times import (
    age_text,
    day_of,
    day_range,
    days_before,
    exact_average,
    hour_label,
    hour_of,
    hour_range,
    instant,
    micros_between,
    rounded,
    state_slug,
)

__all__ = [
    "age_text",
    "day_of",
    "day_range",
    "days_before",
    "default_sla_hours",
    "exact_average",
    "hour_label",
    "hour_of",
    "hour_range",
    "instant",
    "micros_between",
    "rounded",
    "state_slug",
    "technician",
    "technician_id_or_name",
    "whole_number",
    "within",
]
