"""Assembly of module results into one report per ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moatlens.functions import lexicons as L


def module_rollup(parts: DataFrame, payloads: dict, statuses: dict | None = None) -> DataFrame:
    """One report per ticker: its modules in the fixed order, each with its typed payload.

    ``parts`` has one row per ticker with the columns the payload structs use
    and, per module, ``<name>_started_at`` and ``<name>_completed_at``.
    ``statuses`` gives (ok, error message) for the modules that can fail; the
    others succeed, also with empty fields. A module's struct has a field for
    every payload, null for those of other modules (left out of the JSON).
    """
    statuses = statuses or {}

    def module(name: str):
        ok, message = statuses.get(name, (F.lit(True), F.lit(None).cast("string")))
        ok = F.coalesce(ok, F.lit(False))
        return F.struct(
            F.lit(name).alias("name"), F.when(ok, "success").otherwise("error").alias("status"),
            F.col(f"{name}_started_at").alias("started_at"), F.col(f"{name}_completed_at").alias("completed_at"),
            F.when(~ok, message).alias("error_message"),
            *[F.when(F.lit(p == name), payload).alias(p) for p, payload in payloads.items()])

    modules = F.array(*[module(m) for m in L.MODULE_ORDER])
    return parts.select(F.upper("ticker").alias("ticker"), modules.alias("modules")).withColumn(
        "n_success", F.size(F.filter("modules", lambda m: m["status"] == "success")))


def module_timing(runs: DataFrame, run_key: str, module_col: str, ts: str) -> DataFrame:
    """Elapsed time per (run, module) and the run's wall time, in microseconds."""
    t = F.col(ts).cast("timestamp")
    per = runs.groupBy(run_key, module_col).agg(F.min(t).alias("started_at"), F.max(t).alias("completed_at"))
    w = Window.partitionBy(run_key)  # a row per module of the run
    wall = F.unix_micros(F.max("completed_at").over(w)) - F.unix_micros(F.min("started_at").over(w))
    return per.select(
        run_key, module_col, "started_at", "completed_at",
        (F.unix_micros("completed_at") - F.unix_micros("started_at")).alias("elapsed_us"), wall.alias("wall_us"))


def report_json(rollup: DataFrame, generated_at=None) -> DataFrame:
    """One JSON report document per ticker."""
    gen = generated_at if generated_at is not None else F.current_timestamp()
    doc = F.struct(F.col("ticker"), gen.cast("string").alias("generated_at"), F.col("modules"))
    return rollup.select("ticker", F.to_json(doc).alias("doc"))


def write_reports(rollup: DataFrame, path: str, generated_at=None) -> None:
    """One line per ticker; the commit protocol replaces the temp-then-rename dance."""
    report_json(rollup, generated_at).select("doc").write.mode("overwrite").text(path)
