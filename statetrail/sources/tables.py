"""Reading, writing and maintaining the model tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import (
    SIGNAL_SCHEMA,
    STATE_SCHEMA,
    STORED_LOG_SCHEMA,
    TRANSITION_SCHEMA,
    UNIT_SCHEMA,
    StateModel,
)
from ..operators.lookup import LOOKUP_ROWS, small
from ..session import require_shared_dir

TABLES = {
    "state": STATE_SCHEMA,
    "signal": SIGNAL_SCHEMA,
    "transition": TRANSITION_SCHEMA,
    "sm_unit": UNIT_SCHEMA,
    "sm_log": STORED_LOG_SCHEMA,
}


def load_model(spark: SparkSession, path: str, fmt: str = "parquet",
               rows_per_task: int | None = None) -> StateModel:
    """Read the five tables from folders below ``path``; schemas are fixed, none is inferred.

    A log laid out by :func:`append_log` brings its ``day`` along, which prunes files wherever a
    query has a time range.
    """
    require_shared_dir(spark)
    tables = {}
    for name, schema in TABLES.items():
        reader = spark.read.format(fmt).schema(schema)
        if fmt == "csv":
            # JSON columns: double quotes inside a field are doubled
            reader = reader.option("header", True).option("escape", '"')
        tables[name] = reader.load(f"{path}/{name}")
    tables["sm_log"] = tables["sm_log"].withColumnRenamed("id", "log_id")
    return StateModel(*tables.values(), rows_per_task=rows_per_task)


def load_model_jdbc(spark: SparkSession, url: str, properties: Mapping[str, str],
                    schema: str = "sm", partitions: int = 64) -> StateModel:
    """Read the five tables from a live database, the two large ones in ranges of their id."""
    def read(name, key=None):
        table = f"{schema}.{name}"
        if key is None:
            return spark.read.jdbc(url, table, properties=dict(properties))
        bounds = spark.read.jdbc(
            url, f"(SELECT min({key}) AS lo, max({key}) AS hi FROM {table}) b",
            properties=dict(properties)).first()
        return spark.read.jdbc(url, table, column=key, lowerBound=bounds["lo"] or 0,
                               upperBound=(bounds["hi"] or 0) + 1, numPartitions=partitions,
                               properties=dict(properties))

    log = read("sm_log", "id").withColumnRenamed("id", "log_id")
    return StateModel(read("state"), read("signal"), read("transition"),
                      read("sm_unit", "id"), log)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row; NULL fields are kept as ``null``."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def stored_log(rows: DataFrame) -> DataFrame:
    """Log rows in the stored layout: key ``id``, and the UTC day to partition by."""
    return rows.withColumnRenamed("log_id", "id").withColumn("day", F.to_date("ts"))


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows to a table partitioned by day, so that time filters prune files.

    Rows are gathered by day first; Spark splits a large day, so that files are neither many
    and small nor written by one task.
    """
    by_day = stored_log(rows).hint("rebalance", F.col("day"))
    by_day.write.mode("append").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Read what :func:`append_log` wrote."""
    return (spark.read.schema(f"{STORED_LOG_SCHEMA}, day date").parquet(path)
            .withColumnRenamed("id", "log_id"))


def upsert_missing(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` plus those ``rows`` whose key it does not hold yet."""
    others = [name for name in rows.columns if name not in keys]
    if others:
        # of rows with one key keep the smallest, so that a recomputed task picks the same one
        one = rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row"))
        one = one.select(*keys, "_row.*")
    else:
        one = rows.select(*keys).distinct()
    fresh = one.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def update_where(df: DataFrame, condition: Column, changes: Mapping[str, Column]) -> DataFrame:
    """Change columns of the rows that meet ``condition``; others, and NULL, stay as they are."""
    return df.select(*[
        F.when(condition, changes[name]).otherwise(F.col(name)).alias(name)
        if name in changes else F.col(name)
        for name in df.columns])


def resolve_transitions(edges: DataFrame, state: DataFrame, signal: DataFrame,
                        order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turn (signal, in_state, out_state) names into ids: (resolved, unknown names, conflicts).

    Of edges with the same signal and state the first by the column ``order`` stays, or without
    such a column the one to the state with the least id. Those that lead elsewhere are returned
    as conflicts, with the state that was kept.
    """
    states = small(state.select("id", "state_name"))
    signals = small(signal.select("id", "signal_name"))
    before = states.select(F.col("id").alias("in_state_id"), F.col("state_name").alias("in_state"))
    after = states.select(F.col("id").alias("out_state_id"),
                          F.col("state_name").alias("out_state"))
    named = signals.select(F.col("id").alias("signal_id"), F.col("signal_name").alias("signal"))
    # The renaming keeps the broadcast hint of ``small``: it sits below these projections.
    looked_up = (edges.join(named, "signal", "left").join(before, "in_state", "left")
                 .join(after, "out_state", "left"))
    complete = (F.col("signal_id").isNotNull() & F.col("in_state_id").isNotNull()
                & F.col("out_state_id").isNotNull())
    first = F.struct(*([] if order is None else [F.col(order)]), "out_state_id")
    kept = (looked_up.filter(complete).groupBy("signal_id", "in_state_id")
            .agg(F.min(first).alias("_first"))
            .select("signal_id", "in_state_id", F.col("_first.out_state_id").alias("_kept")))
    resolved = kept.withColumnRenamed("_kept", "out_state_id").withColumn("details", F.lit("{}"))
    unknown = looked_up.filter(~complete).select("signal", "in_state", "out_state")
    conflicts = (looked_up.filter(complete).join(kept, ["signal_id", "in_state_id"])
                 .filter("out_state_id <> _kept")
                 .select("signal", "in_state", "out_state", F.col("_kept").alias("kept_state_id")))
    return resolved, unknown, conflicts


def purge_units(unit: DataFrame, log: DataFrame,
                ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop the units in ``ids`` (column ``unit_id``) together with their log rows."""
    # a checked number of ids spares the log its shuffle
    gone = small(ids.select("unit_id").distinct(), 10 * LOOKUP_ROWS)
    kept = unit.join(gone, unit["id"] == gone["unit_id"], "left_anti")
    return kept, log.join(gone, "unit_id", "left_anti").select(*log.columns)


def deletable(dim: DataFrame, references: Iterable[tuple[DataFrame, str]]) -> DataFrame:
    """Rows of a dimension that no ``(table, column)`` refers to."""
    for table, column in references:
        used = table.select(F.col(column).alias("id")).distinct()
        dim = dim.join(used, "id", "left_anti")
    return dim


def validate_model(model: StateModel) -> DataFrame:
    """Broken constraints as rows (check, table, key, n); an empty result is a sound model.

    Each check counts per key first, so a key that fills the table shrinks before it moves. The
    log is read three times: for its key, for its units, and for all other columns.
    """
    tables = {"state": model.state, "signal": model.signal, "transition": model.transition,
              "unit": model.unit, "log": model.log}

    def row(check, table, key, n):
        check = check if isinstance(check, Column) else F.lit(check)
        return [check.alias("check"), F.lit(table).alias("table"),
                key.cast("string").alias("key"), n.cast("long").alias("n")]

    def unique(table, *columns):
        counted = tables[table].groupBy(*columns).agg(F.count("*").alias("n"))
        return counted.filter("n > 1").select(
            *row("unique", table, F.concat_ws(",", *columns), F.col("n")))

    def refers(table, column, target):
        used = (tables[table].filter(F.col(column).isNotNull())
                .groupBy(column).agg(F.count("*").alias("n")))
        known = tables[target].select(F.col("id").alias(column))
        return used.join(known, column, "left_anti").select(
            *row("foreign_key", table, F.concat_ws("=", F.lit(column), F.col(column)),
                 F.col("n")))

    def present(table, columns):
        counted = tables[table].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        listed = counted.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("key"), F.col(c).alias("n")) for c in columns])).alias("c"))
        return listed.filter("c.n > 0").select(
            *row("not_null", table, F.col("c.key"), F.col("c.n")))

    def log_columns():
        """References and NULLs of the log's small columns, counted together in one pass."""
        targets = {"initial_state_id": "state", "final_state_id": "state", "signal_id": "signal"}
        counted = model.log.groupBy(*targets).agg(
            F.count("*").alias("n"), F.count_if(F.col("unit_id").isNull()).alias("no_unit"),
            F.count_if(F.col("ts").isNull()).alias("no_ts"))
        values = [F.struct(F.lit(c).alias("column"), F.col(c).alias("id"), F.col("n").alias("n"))
                  for c in targets]
        values += [F.struct(F.lit(c).alias("column"), F.lit(None).cast("bigint").alias("id"),
                            F.col(n).alias("n")) for c, n in (("unit_id", "no_unit"), ("ts", "no_ts"))]
        used = (counted.select(F.inline(F.array(*values))).groupBy("column", "id")
                .agg(F.sum("n").alias("n")).filter("n > 0"))
        known = None
        for column, target in targets.items():
            of = tables[target].select(F.lit(column).alias("column"), "id")
            known = of if known is None else known.unionByName(of)
        missing = F.col("id").isNull()
        lost = used.join(known, ["column", "id"], "left_anti").filter(
            ~missing | (F.col("column") != "signal_id"))
        return lost.select(*row(
            F.when(missing, "not_null").otherwise("foreign_key"), "log",
            F.concat_ws("=", F.col("column"), F.col("id")), F.col("n")))

    initial = model.state.agg(F.count_if("is_initial").alias("n")).filter("n <> 1").select(
        *row("single_initial", "state", F.lit("is_initial"), F.col("n")))

    checks = [
        unique("state", "id"), unique("state", "state_name"),
        unique("signal", "id"), unique("signal", "signal_name"),
        unique("transition", "signal_id", "in_state_id"),
        unique("unit", "id"), unique("log", "log_id"),
        refers("transition", "signal_id", "signal"),
        refers("transition", "in_state_id", "state"),
        refers("transition", "out_state_id", "state"),
        refers("log", "unit_id", "unit"),
        present("state", ["state_name", "is_initial", "is_terminal"]),
        present("signal", ["signal_name"]),
        present("transition", ["signal_id", "in_state_id", "out_state_id"]),
        present("unit", ["unit_name"]),
        log_columns(),
        initial,
    ]
    report = checks[0]
    for check in checks[1:]:
        report = report.unionByName(check)
    return report
