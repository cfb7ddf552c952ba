"""Following references to their end by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.session import cut, unsent


def roots(links: DataFrame, key: str = "key", up: str = "up") -> DataFrame:
    """(key, root) of a forest (key, up): each round doubles the reach, so a chain of n links takes about log n rounds.
    ``up`` that is no key itself, or that is its own, is a root; the links must hold no other cycle."""
    state = cut(links.select(F.col(key).alias("key"), F.col(up).alias("up")))
    while True:
        over = state.where("key <> up").select(F.col("key").alias("up"), F.col("up").alias("over"))
        state = cut(state.join(unsent(over), "up", "left").select("key", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")))
        if not state.where("moved").limit(1).count():
            return state.select(F.col("key").alias(key), F.col("up").alias("root"))
        state = state.select("key", "up")
