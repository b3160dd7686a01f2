from .maintain import fold_purged, mark_purged, read_live_log, rewrite_log
from .tables import (
    append_log,
    deletable,
    load_model,
    load_model_jdbc,
    purge_units,
    read_log,
    resolve_transitions,
    to_json_rows,
    update_where,
    upsert_missing,
    validate_model,
    write_json,
)

__all__ = [
    "append_log",
    "deletable",
    "fold_purged",
    "load_model",
    "load_model_jdbc",
    "mark_purged",
    "purge_units",
    "read_live_log",
    "read_log",
    "resolve_transitions",
    "rewrite_log",
    "to_json_rows",
    "update_where",
    "upsert_missing",
    "validate_model",
    "write_json",
]
