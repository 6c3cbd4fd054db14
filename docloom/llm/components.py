"""Connected components of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import similarity


def components(links: DataFrame) -> DataFrame:
    """tid, comp for each end of links (a, b): comp is the smallest tid of its component. No links give an empty table."""
    return similarity.components(links).select(F.col("node").alias("tid"), F.col("component").alias("comp"))
