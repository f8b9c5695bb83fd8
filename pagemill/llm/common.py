"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.vectors import Bloom

#: Bits of a filter for each key, and the least and most bits as powers of two.
PER_KEY, LEAST_BITS, MOST_BITS = 16, 20, 29

#: Default for values that identify the source: the first two parts of the path.
def source_of(path: Column) -> Column:
    return F.substring_index(path, "/", 2)


def first_part(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def by_batch(df: DataFrame, schema: str, make: Callable[..., dict], *args) -> DataFrame:
    """Run ``make(columns, *args)`` on each Arrow batch of ``df``.

    ``columns`` maps names to Arrow arrays; the result maps the names of ``schema`` to arrays, lists or numpy arrays.
    Batches are bounded by Spark, so no task ever holds a whole partition.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = make({n: batch.column(i) for i, n in enumerate(batch.schema.names)}, *args)
                yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def bloom(hashes: DataFrame) -> Bloom:
    """A filter of the 64-bit hashes ``h``, built by the executors and of at most 64 MB whatever their number: it misses none, and what it lets
    pass too much, more the more hashes there are, costs its user time but changes no result."""
    bits = min(max(LEAST_BITS, int(hashes.count() * PER_KEY).bit_length()), MOST_BITS)
    places = F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("i")
    at = hashes.select(places).select(F.col("i").bitwiseAND((1 << bits) - 1).alias("i"))
    words = at.groupBy(F.shiftrightunsigned("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return Bloom(out.view(np.uint8))
