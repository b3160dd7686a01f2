from .jobs import (
    apply_signals_stream,
    current_state_stream,
    hourly_activity_stream,
    hourly_partials_stream,
    sla_alerts_stream,
    throughput_stream,
)
from .replay import OUTCOME_SCHEMA, replay_batches
from .sink import append_log_stream, last_updates, run_available, write_updates

__all__ = [
    "OUTCOME_SCHEMA",
    "append_log_stream",
    "apply_signals_stream",
    "current_state_stream",
    "hourly_activity_stream",
    "hourly_partials_stream",
    "last_updates",
    "replay_batches",
    "run_available",
    "sla_alerts_stream",
    "throughput_stream",
    "write_updates",
]
