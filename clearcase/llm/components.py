"""Connected components of a link table, by least labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearcase.llm.common import written

#: Links that a task of a round takes at least.
LEAST = 50_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id that links reach from each linked id.

    Each round takes the least label among neighbours (one row per id and task before the shuffle), then the label of
    the label, so chains halve. Rounds are written tables, with tasks by the number of links and not by the width of
    shuffles; nothing but one count per round reaches the driver. Links that repeat, point to themselves or hold a null
    are dropped; an empty table gives an empty one.
    """
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, -(-both.count() // LEAST))

    def kept(rows: DataFrame) -> DataFrame:
        return written(rows.coalesce(tasks))

    labels = kept(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        nearer = kept(labels.join(near, "id").select("id", F.least("component", "near").alias("to"), "component"))
        over = nearer.select(F.col("id").alias("to"), F.col("to").alias("further"))
        moved = kept(nearer.join(over, "to").select("id", F.least("to", "further").alias("component"), (F.col("further") < F.col("component")).alias("changed")))
        labels = moved.select("id", "component")
        if not moved.filter("changed").limit(1).count():
            return labels
