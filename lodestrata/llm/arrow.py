"""Running row functions over Arrow batches with bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship

#: Rows handled at once, and bytes of output after which a batch is passed on.
SLICE = 256
FLUSH_BYTES = 4 << 20


def flat_map(df: DataFrame, schema: T.StructType, make: Callable[[], Callable]) -> DataFrame:
    """``make()`` runs once a task and returns a function from a slice (dict of lists) to an iterator of output rows (tuples)."""
    ship(df.sparkSession)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, held, weight = make(), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for row in work(batch.slice(at, SLICE).to_pydict()):
                    held.append(row)
                    weight += 64 + sum(map(_weight, row))
                    if weight >= FLUSH_BYTES:
                        yield _batch(held, target)
                        held, weight = [], 0
        if held:
            yield _batch(held, target)

    return df.mapInArrow(run, schema)


def _weight(x) -> int:
    if isinstance(x, (bytes, str)):
        return len(x)
    if isinstance(x, (list, dict)):
        return sum(map(_weight, x.values() if isinstance(x, dict) else x))
    return getattr(x, "nbytes", 0)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
