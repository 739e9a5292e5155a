"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.session import Staging

#: Rows of a written table's file, so that few edges don't make many files.
FILE_ROWS = 100_000


def components(edges: DataFrame, staging: Staging, name: str) -> DataFrame:
    """(v, comp) for each vertex of edges (a, b), comp being the component's least vertex.

    Every round, a vertex takes the least label around it and then its label's label, so rounds
    grow with the logarithm of the longest chain for all but odd graphs. Labels are written each
    round; joins on a vertex with many edges can be split by Spark, as both sides are shuffled."""
    files = max(1, -(-2 * edges.count() // FILE_ROWS))
    keep = lambda df, table: staging.write(df.coalesce(files), table)
    both = keep(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")), f"{name}_both")
    labels = keep(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("comp")), f"{name}_0")
    k = 0
    while True:
        heard = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("m"))
        nearer = keep(labels.join(heard, "v").select("v", F.least("comp", "m").alias("comp"), F.col("comp").alias("was")), f"{name}_near_{k}")
        jump = nearer.select(F.col("v").alias("comp"), F.col("comp").alias("root"))
        after = keep(nearer.join(jump, "comp").select("v", F.col("root").alias("comp"), "was"), f"{name}_{k + 1}")
        changed = after.where("comp <> was").limit(1).count()
        staging.drop(f"{name}_near_{k}")
        staging.drop(f"{name}_{k}")
        k += 1
        labels = after.select("v", "comp")
        if not changed:
            return labels
