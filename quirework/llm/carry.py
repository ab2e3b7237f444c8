"""Carry columns of any name past an operator, as one struct beside its results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def name(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def map_rows(docs: DataFrame, run: Callable[[pa.StructArray], Iterator[tuple[pa.Array | None, list[pa.Array]]]], results: str, carried: list[str], read: list[str]) -> DataFrame:
    """``row`` (a struct of the carried columns) and the results of ``run`` for each row.

    ``run`` takes the columns to read as a struct array and gives pieces ``(rows, results)``, where
    ``rows`` selects rows of the batch by number.
    """
    wanted = list(dict.fromkeys([*carried, *read]))
    source = docs.select(F.struct(*(name(c).alias(f"c{i}") for i, c in enumerate(wanted))).alias("row"))
    position = {c: i for i, c in enumerate(wanted)}
    names = ["row", *(part.split()[0] for part in results.split(", "))]

    def work(batches):
        for batch in batches:
            whole = batch.column(0)
            fields = [whole.field(i) for i in range(len(wanted))]
            taken = pa.StructArray.from_arrays([fields[position[c]] for c in carried], names=[f"c{position[c]}" for c in carried])
            for rows, out in run({c: fields[position[c]] for c in read}):
                yield pa.RecordBatch.from_arrays([taken.take(rows), *out], names=names)

    inner = source.schema["row"].dataType
    kept = ", ".join(f"c{position[c]}: {inner[f'c{position[c]}'].dataType.simpleString()}" for c in carried)
    out = source.mapInArrow(work, f"row struct<{kept}>, {results}")
    return out.withColumn("row", F.struct(*(F.col(f"row.c{position[c]}").alias(c) for c in carried)))
