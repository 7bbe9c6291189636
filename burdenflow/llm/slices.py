"""Arrow batches handed to a pandas function some rows at a time, so a task's Python holds few texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a slice.
ROWS = 500

Frames = Iterator[pd.DataFrame]


def map_slices(df: DataFrame, function: Callable[[Frames], Frames], schema: str, rows: int = ROWS) -> DataFrame:
    """Like mapInPandas; whole numbers stay whole where some are null."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frames() -> Frames:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    yield batch.slice(at, rows).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
                pa.default_memory_pool().release_unused()

        for out in function(frames()):
            yield pa.RecordBatch.from_pandas(out, schema=kinds, preserve_index=False)

    return df.mapInArrow(run, schema)
