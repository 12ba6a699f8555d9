"""Graphs that are small enough for one task, many to a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from metaloom.sources.store import cut

#: Nodes and edges of a graph that one task may hold.
GRAPH_ROWS = 500_000


def parted(rows: DataFrame, keys: list[str], bound: int) -> tuple[DataFrame, DataFrame | None]:
    """rows of graphs up to the bound, and those of larger ones, None where there are none."""
    large = cut(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > bound).drop("__n"), "large")
    if large.isEmpty():
        return rows, None
    return rows.join(large, keys, "left_anti"), rows.join(large, keys, "left_semi")


def by_group(rows: DataFrame, keys: list[str], columns: list[str], out: str, solve: Callable[[tuple, list[tuple]], Iterable[tuple]]) -> DataFrame:
    """What solve makes of the columns of each graph, with the keys. Graphs are sorted by their keys and read one after the other, many to a batch."""
    types = [rows.schema[k].dataType for k in keys]
    schema = ", ".join(f"{k} {t.simpleString()}" for k, t in zip(keys, types, strict=True)) + ", " + out
    arrow, n = to_arrow_schema(_parse_datatype_string(schema)), len(keys)

    def graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
        key, own = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and row[:n] != key:
                    yield key, own
                    own = []
                key = row[:n]
                own.append(row[n:])
        if own:
            yield key, own

    def packed(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for key, own in graphs(batches):
            for row in solve(key, own):
                found.append((*key, *row))
                if len(found) > 10_000:
                    yield packed(found)
                    found = []
        if found:
            yield packed(found)

    return rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)
