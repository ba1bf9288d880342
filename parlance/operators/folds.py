"""Order-dependent rules: a step function over the rows of a key, in order.

`step(state, row)` gets the state so far (None at first) and a row as a dict, and
returns the next state and the rows to emit. The same function runs over tables
(`fold`) and over streams (`parlance.streaming.sessions`), so a rule is written
once. A key's rows are taken one after the other, as the rules ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Step = Callable[[dict | None, dict], tuple[dict, list[dict]]]


def fold(rows: DataFrame, by: list[str], order: list[str], step: Step, schema: str) -> DataFrame:
    """What `step` emits over each key's rows in order; keys must not be null in `order`."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (now := tuple(row[c] for c in by)) != key:
                    key, state = now, None
                state, emitted = step(state, row)
                out += emitted
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
