"""Whole groups out of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: What a group gives: the places of the rows that it keeps, and further columns for them.
Kept = tuple[np.ndarray, dict[str, np.ndarray]]


def map_groups(df: DataFrame, keys: list[str], order: list[str], given: list[str], run: Callable[..., Kept], schema: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows that ``run`` keeps of each group of ``keys``, many groups to one batch.

    ``run`` gets the columns ``given`` of a group as numpy arrays, its rows in the order of ``order``. Unlike
    ``applyInPandas`` a group costs no data frame of its own, which counts where groups are very many and small. Null
    keys are equal to each other. The caller bounds the size of a group. Columns ``drop`` aren't given out.
    """
    kept_columns = [c for c in df.columns if c not in drop]

    def starts(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        new = np.zeros(batch.num_rows, dtype=bool)
        new[:1] = True
        for k in keys:
            column = batch.column(k).combine_chunks() if isinstance(batch, pa.Table) else batch.column(k)
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    def done(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = [table.column(c).to_numpy() for c in given]
        places, more = [], {}
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            index, extra = run(*[c[a:b] for c in columns])
            places.append(index + a)
            for k, v in extra.items():
                more.setdefault(k, []).append(v)
        if places:
            out = table.select(kept_columns).take(pa.array(np.concatenate(places)))
            for k, v in more.items():
                out = out.append_column(k, pa.array(np.concatenate(v)))
            yield from out.combine_chunks().to_batches()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])).size == 1 and starts(batch).size == 1:
                held.append(batch)
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            first = starts(table)
            yield from done(table, first)
            held = table.slice(int(first[-1])).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from done(table, np.append(starts(table), table.num_rows))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(over, schema)
