"""One pass over each key's rows in order, with a state that depends on the rows before.

Rows are dealt by key and sorted inside each partition, so a key's rows stream
through one task in batches: a key of any length takes the memory of one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def scan(df: DataFrame, keys: list[str], order: list[str], start: Callable[[tuple], Any], step: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``step(state, rows)`` for each key's rows, batch by batch, sorted by ``order``; ``start(key)`` makes a key's state, which ``step`` changes in place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            out = []
            columns = [pdf[k].to_numpy() for k in keys]
            new = np.zeros(len(pdf), bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(pdf)]
            for a, b in zip(cuts, cuts[1:]):
                rows = pdf.iloc[a:b]
                key = tuple(rows[k].iat[0] for k in keys)
                if key != now:
                    now, state = key, start(key)
                out.append(step(state, rows))
            out = [x for x in out if len(x)]
            if out:
                yield pd.concat(out, ignore_index=True)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
