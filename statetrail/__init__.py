"""State-log analytics on Spark."""

from .model import StateModel, seeded_dimensions
from .plans.activity import (
    daily_activity,
    hourly_activity,
    hourly_from_partials,
    throughput,
    transition_heatmap,
    workers_list,
)
from .plans.board import (
    bottleneck_bands,
    daily_rollup,
    first_reached,
    heatmap_top,
    history_classes,
    hourly_labels,
    lifecycle_progress,
    process_board,
    success_rates,
    technician_columns,
    technician_pivot,
    timeline_flags,
    unit_classes,
    zero_defaults,
)
from .plans.current import (
    bottlenecks,
    current_units,
    sla_breaches,
    state_distribution,
    technician_board,
    technician_workload,
    unit_status,
    units_now,
    worker_units,
)
from .plans.durations import avg_state_durations, state_intervals, unit_durations
from .plans.machine import (
    apply_signals,
    audit_log,
    create_units,
    observed_transitions,
    signal_outcomes,
    terminal_states,
)
from .plans.workers import worker_detail, worker_history, worker_performance
from .session import build_session, configure, shared_dir

__all__ = [
    "StateModel",
    "apply_signals",
    "audit_log",
    "avg_state_durations",
    "bottleneck_bands",
    "bottlenecks",
    "build_session",
    "configure",
    "create_units",
    "current_units",
    "daily_activity",
    "daily_rollup",
    "first_reached",
    "heatmap_top",
    "history_classes",
    "hourly_activity",
    "hourly_from_partials",
    "hourly_labels",
    "lifecycle_progress",
    "observed_transitions",
    "process_board",
    "seeded_dimensions",
    "shared_dir",
    "signal_outcomes",
    "sla_breaches",
    "state_distribution",
    "state_intervals",
    "success_rates",
    "technician_board",
    "technician_columns",
    "technician_pivot",
    "technician_workload",
    "terminal_states",
    "throughput",
    "timeline_flags",
    "transition_heatmap",
    "unit_classes",
    "unit_durations",
    "unit_status",
    "units_now",
    "worker_detail",
    "worker_history",
    "worker_performance",
    "worker_units",
    "workers_list",
    "zero_defaults",
]
