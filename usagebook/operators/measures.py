"""The algebra of interval-valued amounts: counts by status, bounds, and a group's own status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ("exact", "bounded", "partial", "unpriced", "unavailable")


def measure_sums(name: str) -> list[Column]:
    """Aggregates over the columns name_status, name_lower and name_upper; they add up over groups."""
    status, lower, upper = (F.col(f"{name}_{x}") for x in ("status", "lower", "upper"))
    return [*[F.count_if(status == s).alias(f"{name}_{s}_events") for s in STATUSES], F.sum(lower).alias(f"{name}_lower_sum"), F.sum(upper).alias(f"{name}_upper_sum"), F.count(lower).alias(f"{name}_lower_events"), F.count(upper).alias(f"{name}_upper_events")]


def measure_columns(name: str) -> dict[str, Column]:
    """status, lower and upper of a group from its sums. There is an upper bound only if every event that applies has one."""
    of = {s: F.col(f"{name}_{s}_events") for s in STATUSES}
    applicable = of["exact"] + of["bounded"] + of["partial"] + of["unpriced"]
    with_lower, with_upper = F.col(f"{name}_lower_events"), F.col(f"{name}_upper_events")
    status = (
        F.when(applicable == 0, "unavailable")
        .when((of["exact"] == applicable) & (with_upper == applicable), "exact")
        .when((of["exact"] + of["bounded"] == applicable) & (with_lower == applicable) & (with_upper == applicable), "bounded")
        .when(of["unpriced"] == applicable, "unpriced")
        .otherwise("partial")
    )
    return {f"{name}_status": status, f"{name}_lower": F.col(f"{name}_lower_sum"), f"{name}_upper": F.when((applicable > 0) & (with_upper == applicable), F.col(f"{name}_upper_sum"))}


def finished(df, *names: str):
    """df with each measure's sums replaced by its status and bounds."""
    for name in names:
        df = df.withColumns(measure_columns(name)).drop(*[f"{name}_{x}" for x in ("lower_sum", "upper_sum", "lower_events", "upper_events")])
    return df
