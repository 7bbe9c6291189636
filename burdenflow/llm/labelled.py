"""What the operators that learn from labels share: fixed folds and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burdenflow.llm.slices import ROWS


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of doc_id as text, modulo the number of folds; a null doc_id is the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """One row doc_id, label (0 or 1) for each document with a label; the larger one where rows disagree."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return known.dropna().groupBy("doc_id").agg(F.max("label").alias("label"))


def bounded(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most so many rows, chosen by a seeded hash of doc_id."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(most)


def passing(docs: DataFrame, decide: Callable[[], Callable[[list], np.ndarray]]) -> DataFrame:
    """The rows whose text is kept, untouched; decide() gives each task a function from texts to decisions."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = decide()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
                yield rows.filter(pa.array(np.asarray(keep(texts), bool)))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(chosen, docs.schema)
