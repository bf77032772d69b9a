"""A yes or no about each text as a column: texts go to Python, the rows they belong to stay where they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def flag(scan: Scan, decide: Callable[[pa.RecordBatch], pa.Array], text: Column, key: str) -> Column:
    """The decision about what a scan of batches (key, text) gives for each text, in the order of the texts."""

    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = pa.RecordBatch.from_arrays([pa.nulls(len(texts)), texts], names=[key, "text"])
            yield pa.concat_arrays([pa.array([], pa.bool_()), *(decide(found) for found in scan(iter([rows])))])

    return run(text)
