"""Patterns in action logs and impact along lineage edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.arithmetic import ratio
from tidemark.session import settle


def action_parameters(log: DataFrame, action: str, details: str) -> DataFrame:
    """(action, parameter, total, value, n): the most common value of each parameter."""
    rows = log.select(F.col(action).alias("action"), F.explode(F.col(details)).alias("parameter", "value"))
    counted = rows.groupBy("action", "parameter", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("action", "parameter").agg(
        F.sum("n").alias("total"), F.min_by("value", F.struct((-F.col("n")).alias("f"), "value")).alias("value"),
        F.max("n").alias("n"))


def action_patterns(log: DataFrame, action: str, details: str, share: float = 0.6, min_actions: int = 3,
                    default_actions: int = 5) -> DataFrame:
    """Per action type: frequency, patterns found, confidence, and default values once there are enough actions.

    ``details`` is a MAP<STRING, STRING>; parse JSON with ``from_json`` first.
    """
    sizes = log.groupBy(F.col(action).alias("action")).agg(F.count(F.lit(1)).alias("frequency"))
    top = action_parameters(log, action, details).join(sizes, "action")
    strong = (ratio(F.col("n"), F.col("total")) > share) & (F.col("frequency") >= min_actions)
    pair = F.concat(F.col("parameter"), F.lit("="), F.col("value"))
    # one entry per parameter name of the action
    return top.groupBy("action", "frequency").agg(
        F.count(F.lit(1)).alias("parameters"), F.count_if(strong).alias("patterns"),
        F.array_join(F.array_sort(F.collect_list(F.when(strong, pair))), ",").alias("common_values"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("frequency") >= default_actions, pair))), ",").alias("defaults")
    ).withColumn("confidence", F.when(F.col("frequency") >= min_actions, ratio(F.col("patterns"), F.col("parameters"))).otherwise(0.0))


def _reach(edges: DataFrame, node: str, here: str, there: str, depth: int) -> DataFrame:
    """(node, hops) reachable from ``node`` in at most ``depth`` steps."""
    links = edges.select(F.col(here).alias("here"), F.col(there).alias("there"))
    frontier = edges.sparkSession.createDataFrame([(node, 0)], "node string, hops int")
    seen = frontier
    for hop in range(1, depth + 1):
        step = (frontier.join(links, frontier["node"] == links["here"]).select(F.col("there").alias("node")).distinct()
                .join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop)))
        frontier = settle(step, "hop")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("hops > 0")


def lineage(edges: DataFrame, node: str, direction: str = "both", depth: int = 3) -> DataFrame:
    """(direction, node, hops) up and/or down the edge table (src, dst)."""
    parts = []
    if direction in ("upstream", "both"):
        parts.append(_reach(edges, node, "dst", "src", depth).withColumn("direction", F.lit("upstream")))
    if direction in ("downstream", "both"):
        parts.append(_reach(edges, node, "src", "dst", depth).withColumn("direction", F.lit("downstream")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("direction", "node", "hops")


def lineage_impact(edges: DataFrame, node: str, direction: str = "both", depth: int = 3) -> DataFrame:
    """Connected datasets, impact score (10 each, at most 100) and change risk, one row."""
    found = lineage(edges, node, direction, depth).agg(
        F.count_if(F.col("direction") == "upstream").alias("upstream"),
        F.count_if(F.col("direction") == "downstream").alias("downstream"))
    total = F.col("upstream") + F.col("downstream")
    return (found.withColumn("connected", total).withColumn("impact_score", F.least(F.lit(100), total * 10).cast("long"))
            .withColumn("risk", F.when(total > 5, "high").when(total > 2, "medium").otherwise("low")))
