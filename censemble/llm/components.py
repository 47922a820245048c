"""Connected components of an edge table, as DataFrame joins (large star, small star).

Edges are pairs of comparable ids; a component is named by its smallest id. Each round halves the
depth of the trees at least, and its edges are written to the shared folder, so lineage stays short
and a lost executor costs one round at most. No edge or component ever reaches the driver; only the
count and hash sum that show that a round changed nothing. A hub's edges are joined to one row, so
adaptive execution can split them.

Defined results: edges with a null end and loops are left out; repeated edges count once; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censemble.llm.bitmaps import few_files
from censemble.session import stored

ROWS_PER_FILE = 500_000


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))
    ).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours below the smallest: of all edges of a node, or of those to smaller nodes."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    joined = around.join(least, "u")
    if large:
        hung = joined.where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.least("m", "u").alias("v")
        )
    else:
        hung = joined.select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e")
        ).select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
    return hung.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """``(node, component)`` for every node that has an edge."""
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    tree = stored(
        few_files(both.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()), "edges"
    )
    last = _fingerprint(tree)
    for _ in range(most_rounds):
        if last[0] == 0:
            break
        # A round never has more edges than the one before.
        hung = _star(_star(tree, True), False).coalesce(1 + last[0] // ROWS_PER_FILE)
        tree = stored(hung, "edges")
        now = _fingerprint(tree)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return tree.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        tree.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
