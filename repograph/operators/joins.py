"""How joins are run whose sides grow with the repository."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(df: DataFrame) -> DataFrame:
    """df to be joined by sorting and merging, never by a broadcast.

    Spark guesses a side's size from the files it is read from. A small Parquet file of many short rows, or
    one that a scanner turns into many facts, is guessed far too small, and the driver would collect it.
    """
    return df.hint("merge")
