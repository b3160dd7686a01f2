"""Fields of the JSON payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import UNASSIGNED


def technician(payload: str | Column = "payload", default: str | None = UNASSIGNED,
               last_duplicate: bool = False) -> Column:
    """``tech`` of the payload; a missing key and JSON null give ``default``.

    ``get_json_object`` takes the first of duplicate keys. ``last_duplicate=True`` takes the
    last one and needs ``spark.sql.variant.allowDuplicateKeys=true``.
    """
    if last_duplicate:
        name = F.try_variant_get(F.try_parse_json(payload), "$.tech", "string")
    else:
        name = F.get_json_object(payload, "$.tech")
    return name if default is None else F.coalesce(name, F.lit(default))


def technician_id_or_name(payload: str | Column = "payload") -> Column:
    """``technician_id``, else ``tech``; an empty text counts as missing."""
    def field(path):
        return F.nullif(F.get_json_object(payload, path), F.lit(""))

    return F.coalesce(field("$.technician_id"), field("$.tech"))
