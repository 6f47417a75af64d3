"""Folds over small groups of rows in order: what depends on the rows before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def fold(rows: DataFrame, key: list[str], order: list, schema: str, of: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """of(rows of a group, in order) for each group of key, as rows of schema.

    Groups are dealt by key and sorted; a task streams through its groups and holds one at a time, so thousands of
    small groups cost no more than their rows. Groups must be small: those of a page, or of a pair of revisions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([pa.field(f.name, f.type) for f in _arrow(schema)])
        group: list[dict] = []
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if group and any(row[k] != group[0][k] for k in key):
                    out += of(group)
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_pylist(out, kinds)
        if group:
            yield pa.RecordBatch.from_pylist(of(group), kinds)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


_KINDS = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def _arrow(schema: str) -> list[pa.Field]:
    return [pa.field(name, _KINDS[kind]) for name, kind in (c.split() for c in schema.split(", "))]


def ddl(rows: DataFrame, *more: str) -> str:
    return ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), *more])
