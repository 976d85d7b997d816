"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import apart
from riskloom.session import durable


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v) of each of the pairs of columns; ``rows`` are made once, and not for each of them."""
    both = [F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs]
    return rows.select(F.explode(F.array(*both)).alias("x")).select("x.u", "x.v")


def _lowest(edges: DataFrame) -> DataFrame:
    """Each (u, v) with the lowest of u's neighbours, of which there may be very many."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(apart(lowest, "u"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    met = _lowest(_each(edges, ("u", "v"), ("v", "u"))).where("v > u")
    return met.select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    met = _lowest(edges)  # u > v holds for every edge
    return _each(met, ("v", "m"), ("u", "m")).where("u > v").distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether each node has one link down, to one that has none; then nothing is left to join."""
    one = F.lit(1)
    ends = edges.select("u", one.alias("down"), F.lit(0).alias("up")).union(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("down"), one.alias("up"))
    )
    nodes = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.where("down > 1 OR (down = 1 AND up = 1)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every id in the links (u, v) that is not its component's lowest.

    Each round is written to the shared folder, so that neither lineage nor a lost executor makes
    later rounds repeat earlier ones. The rounds grow with the logarithm of the longest chain.
    """
    high, low = F.greatest("u", "v"), F.least("u", "v")
    now = edges.where("u != v").select(high.alias("u"), low.alias("v"))
    while True:
        now = durable(_small_star(_large_star(now)))
        if _only_stars(now):
            return now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
