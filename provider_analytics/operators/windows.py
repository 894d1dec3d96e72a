"""Which of many short texts occur inside which others, as an equality join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_windows(texts: DataFrame, column: str, parts: DataFrame, part: str) -> DataFrame:
    """Each row of `texts` with every different stretch of `column`, named `part`, that is as long as some `part` of the
    other frame: a row has at most as many as its length times the number of those lengths, whatever it holds. Joined
    with `parts` on equality this is containment. Empty parts, null texts and null parts are in nothing.

    The lengths travel as one array of different numbers, none above that of the longest part."""
    lengths = parts.agg(F.collect_set(F.nullif(F.length(part), F.lit(0))).alias("_lengths"))
    size = F.length(column)
    return texts.crossJoin(F.broadcast(lengths)).withColumn(  # one row
        part, F.explode(F.array_distinct(F.flatten(F.transform(
            F.filter("_lengths", lambda n: n <= size),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.col(column).substr(i, n)),
        ))))).drop("_lengths")
