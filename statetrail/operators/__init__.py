from .latest import latest_per_unit
from .lookup import LOOKUP_ROWS, bounded_rows, small
from .ranges import in_range
from .trail import ROWS_PER_TASK, Trail, trail

__all__ = [
    "LOOKUP_ROWS",
    "ROWS_PER_TASK",
    "Trail",
    "bounded_rows",
    "in_range",
    "latest_per_unit",
    "small",
    "trail",
]
