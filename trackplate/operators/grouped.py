"""Grouped Python steps that work on Arrow batches instead of one call per group.

Rows are hash partitioned and sorted by key, so a batch holds many whole groups; only
the group cut by a batch end is carried over. Per-group cost is a numpy slice. Groups
handed to these steps are bounded by their callers (a chunk, a routed image or video).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _starts(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, group start positions) of complete groups."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        if len(b) == 0:
            continue
        if rest and not all(rest[0][k].iloc[0] == b[k].iloc[-1] for k in keys):
            b = pd.concat([*rest, b], ignore_index=True)
            rest = []
        if rest:                       # the carried group fills this whole batch
            rest.append(b)
            continue
        at = _starts(b, keys)
        if at[-1] > 0:
            yield b.iloc[:at[-1]], at[:-1]
        rest = [b.iloc[at[-1]:]]
    if rest:
        b = pd.concat(rest, ignore_index=True)
        yield b, np.array([0])


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str],
               fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """fn(rows, starts) -> rows for batches of whole groups, sorted by keys and order.

    The partition count is fixed so that small but slow Python work is not folded into
    one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartition(n, *keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        for rows, starts in whole_groups(batches, list(keys)):
            out = fn(rows, starts)
            if len(out):
                yield out

    return ordered.mapInPandas(run, schema)


def key_types(df: DataFrame, keys: Sequence[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"{k} {types[k]}" for k in keys)
