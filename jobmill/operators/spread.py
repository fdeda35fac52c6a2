"""Partitions by the number of rows, so that a task's memory depends on no table's size."""

from pyspark.sql import DataFrame

#: Rows of a partition, about.
ROWS = 1 << 18


def spread(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df dealt by keys into partitions of about ROWS rows; ``rows``: how many df has at most.

    Sorts, windows and aggregates by these keys, or by more than these, follow
    without another shuffle, and so do joins of two tables dealt by the same
    keys and number. Spark's own shuffles have a set number of partitions,
    which grow with the table.
    """
    return df.repartition(max(1, -(-rows // ROWS)), *keys)
