"""Folds over ordered rows with bounded memory.

Rows are dealt by key and sorted; a task reads its keys one after another,
batch by batch, and carries the state of the current key from batch to batch.
So a recording of any length needs the memory of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """Apply ``step(state, rows) -> (state, result)`` to each key's rows, a stretch at a time, from ``start()``; null keys are one key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            for key, rows in batch.groupby(keys, sort=False, dropna=False):
                key = tuple(None if part != part else part for part in key)  # a null key comes as NaN, which equals nothing
                if now is None or key != now:
                    now, state = key, start()
                state, result = step(state, rows)
                if len(result):
                    yield result

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
