"""Pluggable scorers: a user's model applied to Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_with(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], inputs: Sequence[str], out: str = "score") -> DataFrame:
    """Add ``out``: ``fn`` maps a batch of ``inputs`` to one double per row."""
    names = list(inputs)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(fn(batch[names])).astype("float64")

    return df.withColumn(out, run(F.struct(*names)))
