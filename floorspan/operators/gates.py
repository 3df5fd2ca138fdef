"""Gates in a fixed order, and edits of a network as DataFrame rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failing(df: DataFrame, key: str, gates: list[tuple[str, Column]]) -> DataFrame:
    """(key, codes) of the rows that fail a gate; codes in the gates' order."""
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in gates]))
    return df.select(key, codes.alias("codes")).filter(F.size("codes") > 0)


def edit_network(edges: DataFrame, edits: list[tuple[str, object]]) -> DataFrame:
    """Edges after a sequence of edits: delete_node id, delete_edges condition, add_edge row, move_cost (condition, factor)."""
    for kind, what in edits:
        if kind == "delete_node":
            edges = edges.filter((F.col("from_id") != what) & (F.col("to_id") != what))
        elif kind == "delete_edges":
            edges = edges.filter(~what)
        elif kind == "add_edge":
            edges = edges.unionByName(edges.sparkSession.createDataFrame([what], edges.schema))
        elif kind == "move_cost":
            edges = edges.withColumn("cost", F.when(what[0], F.col("cost") * what[1]).otherwise(F.col("cost")))
        else:
            raise ValueError(f"unknown edit {kind}")
    return edges
