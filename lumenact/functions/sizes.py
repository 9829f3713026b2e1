"""Tables whose size the caller bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fetched(df: DataFrame, max_rows: int) -> DataFrame:
    """A table of at most `max_rows` rows, computed once and kept as literal rows.

    For results whose size is a parameter, such as the k chosen features;
    everything else stays a plan, and the optimizer decides what to broadcast.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        raise ValueError(f"expected at most {max_rows} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)
