"""Connected components of a link table by label propagation with pointer jumping, all in DataFrames.

Each round a document takes the least label of its neighbours, then the label of its label; labels only fall and end at the
least id of the component. Rounds grow with the logarithm of a component's diameter. No label or link reaches the driver
but one count a round. A hub with very many links is reduced by partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.storage import release, written


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns id, component (least id reachable) for every id in links; no links, no rows."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        last = labels
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("new"))
        # the label's own label: jump over chains
        jump = step.join(labels.select(F.col("id").alias("new"), F.col("component").alias("far")), "new", "left")
        new = written(jump.select("id", "component", F.least("new", F.coalesce("far", "new")).alias("new")), "labels")
        changed = new.filter("new <> component").limit(1).count()
        labels = new.select("id", F.col("new").alias("component"))
        labels.written_to = new.written_to
        release(links.sparkSession, last)
        if not changed:
            release(links.sparkSession, both)
            return labels
