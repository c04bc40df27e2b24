"""Sums of arrays per key, added as arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Keys whose sums a task holds before it sends them on.
MOST_KEYS = 2048


def array_sums(rows: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, total, n): element-wise sum of an array column and its number of rows.

    Arrays of one key have one length; null arrays are left out.  Each task adds the
    arrays of its batches, so a key is sent once per task as one array, whatever its
    number of rows or elements; the parts of a key then stand together and are added as they
    stream by.
    """
    keys = list(keys)
    parts = rows.where(F.col(vector).isNotNull()).select(
        *keys, F.col(vector).cast("array<double>").alias("total"), F.lit(1).cast("long").alias("n")
    )
    schema = parts.schema
    fields = to_arrow_schema(schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            codes, named = _groups(batch, len(keys))
            lists = batch.column(len(keys))
            offsets = np.asarray(lists.offsets)
            values = np.asarray(lists.values)
            n = np.asarray(batch.column(len(keys) + 1))
            order = np.argsort(codes, kind="stable")
            edges = np.flatnonzero(np.diff(codes[order], prepend=-1))
            sizes = np.diff(offsets)
            for lo, hi in zip(edges, [*edges[1:], len(order)], strict=True):
                own = order[lo:hi]
                size = sizes[own[0]]
                if (sizes[own] != size).any():
                    raise ValueError("arrays of one key differ in length")
                total = values[offsets[own][:, None] + np.arange(size)].sum(axis=0)
                key = named[codes[own[0]]]
                if key in held:
                    held[key][0] += n[own].sum()
                    held[key][1] = held[key][1] + total
                else:
                    held[key] = [n[own].sum(), total]
            if len(held) > MOST_KEYS:
                # Sorted input may go on with its last key; all others are complete.
                last = named[codes[-1]]
                rest = {last: held.pop(last)}
                yield _batch(held, fields)
                held = rest
        if held:
            yield _batch(held, fields)

    partial = parts.mapInArrow(add, schema)
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, schema)


def _groups(batch: pa.RecordBatch, count: int) -> tuple[np.ndarray, list[tuple]]:
    """A code per row for its key, and the keys by code."""
    table = pa.Table.from_batches([batch]).select(range(count))
    names: dict[tuple, int] = {}
    rows = zip(*[c.to_pylist() for c in table.columns], strict=True) if count else [()] * batch.num_rows
    codes = np.fromiter((names.setdefault(key, len(names)) for key in rows), int, batch.num_rows)
    return codes, list(names)


def _batch(held: dict[tuple, list], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*held, strict=True)) or []
    totals = [v[1] for v in held.values()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in totals])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(totals), pa.float64()))
    arrays = [pa.array(c, f.type) for c, f in zip(columns, fields, strict=False)]
    arrays += [lists.cast(fields.field(len(arrays)).type), pa.array([int(v[0]) for v in held.values()], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, schema=fields)
