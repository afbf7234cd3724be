"""Connected components of an undirected link table, by minimum labels with pointer jumping.

Every round is written to the shared folder; nothing but a count of changes reaches the
driver. Rounds grow with the logarithm of the longest chain.

Defined results: repeated links and links of an id with itself change nothing; links with a null
link nothing; no links give an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stash import stash


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in ``links`` (a, b): comp is the smallest id reachable."""
    links = links.filter("a is not null and b is not null")
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = stash(both.distinct(), "edges")
    if both.isEmpty():
        return both.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    label = stash(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("comp")), "label")
    while True:
        near = both.join(label.select(F.col("id").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        step = label.join(near, label["id"] == near["u"]).select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = label.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        step = step.join(jump, "comp").select("id", "old", F.least("comp", "far").alias("comp"))
        step = stash(step, "label")
        label = step.select("id", "comp")
        if step.filter("comp <> old").isEmpty():
            return label
