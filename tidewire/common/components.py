"""Connected components of an edge table by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import scope, written

#: Edges, both ways and with a loop a node, up to which a round's labels are broadcast and written as few files.
FEW_ROWS, FEW_FILES = 200_000, 8


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", label: str = "component") -> DataFrame:
    """Rows (``node``, ``label``) for every node of ``edges``; the label is the smallest node reachable.

    Each round every node takes the smallest label among itself and its neighbours, then the label of that
    label (pointer jumping), so the number of rounds follows the logarithm of a component's diameter in the
    usual case. Where edges are few, a round shuffles them once, since labels are broadcast, and has few tasks. A round's labels are written to the shared folder, so plans stay short and a lost executor
    costs one round at most; tables of earlier rounds are deleted at the end. Nodes of any orderable type; edges with a null end are not edges. Parallel
    edges and loops are harmless; no edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    nodes = pairs.select("x", F.col("x").alias("y")).union(pairs.select("y", "y"))
    with scope(edges.sparkSession) as tables:
        both = written(pairs.union(pairs.select("y", "x")).union(nodes).distinct(), "edges")
        few = both.count() <= FEW_ROWS
        spread = F.broadcast if few else lambda df: df
        stored = lambda df: written(df.coalesce(FEW_FILES) if few else df, "labels")
        labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("c")))
        while True:
            seen = both.join(spread(labels.select(F.col("node").alias("y"), "c")), "y")
            moved = seen.groupBy(F.col("x").alias("node")).agg(F.min("c").alias("c"), F.max(F.when(F.col("x") == F.col("y"), F.col("c"))).alias("old"))
            jump = labels.select(F.col("node").alias("c"), F.col("c").alias("root"))
            new = stored(moved.join(spread(jump), "c").select("node", "old", F.least("c", "root").alias("c")))
            labels = new.select("node", "c")
            if not new.where("old <> c").limit(1).count():
                tables.keep(new)
                return labels.withColumnRenamed("c", label)
