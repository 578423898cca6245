"""Logical, optimized and physical plans as text."""

from __future__ import annotations

from pyspark.sql import DataFrame

MODES = ("logical", "optimized", "physical", "formatted", "cost")


def explain_text(df: DataFrame, mode: str = "logical") -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    plan = df._jdf.queryExecution()
    if mode == "logical":
        return plan.logical().toString()
    if mode == "optimized":
        return plan.optimizedPlan().toString()
    if mode == "physical":
        return plan.executedPlan().toString()
    jvm = df.sparkSession._jvm
    return plan.explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
