"""Folds over ordered rows of each group, with a small state and one pass."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, dict]], schema: str) -> DataFrame:
    """``step(state, row)`` gives the next state and an output row; states begin anew for each group.

    Groups are dealt out by key and sorted in their partition, so rows stream past and a task holds one state,
    however long a group is.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        group, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                mine = tuple(row[k] for k in keys)
                if mine != group:
                    group, state = mine, start()
                state, made = step(state, row)
                out.append(made)
            yield pa.RecordBatch.from_pylist(out, fields)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
