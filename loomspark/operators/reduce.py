"""Order-dependent reduction of sessions: partitions sorted by session and order, one session in memory at a time.

Cheaper than one pandas call a group when sessions are many and short.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame


def reduce_sessions(rows: DataFrame, order: str, reduce_one: Callable[[list[dict]], Iterable[tuple]], schema: str, key: str = "ref") -> DataFrame:
    """Rows of schema from reduce_one(records of one session in order)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records = (dict(zip(batch.columns, r)) for batch in batches for r in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None))
        out: list[tuple] = []
        for _, session in groupby(records, key=lambda r: r[key]):
            out.extend(reduce_one(list(session)))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)
