"""Text operators that work on Arrow blocks of documents inside each task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from tessera.llm import words


#: of Arrow batches between the JVM and Python; by rows alone, a batch of long texts is large on both sides
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes in this session, where nobody has set a bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, BATCH_BYTES)


def map_blocks(
    docs: DataFrame,
    text: str,
    work: Callable[[pa.RecordBatch], dict[str, pa.Array | np.ndarray]],
    fields: list[StructField],
    drop: tuple[str, ...] = (),
    most: int = words.BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with the columns that ``work`` returns for each block of rows.

    ``work`` gets a record batch with at most ``most`` bytes in the ``text``
    column (or a single row). Its columns replace columns of the same name.
    """
    small_batches(docs.sparkSession)
    new = {f.name for f in fields}
    keep = [f.name for f in docs.schema if f.name not in new and f.name not in drop]
    schema = StructType([docs.schema[c] for c in keep] + fields)
    types = {f.name: _arrow(f) for f in fields}

    def run(batches):
        for block in words.blocks(batches, text, most):
            found = work(block)
            arrays = [block.column(c) for c in keep]
            arrays += [pa.array(found[n], t) if not isinstance(found[n], pa.Array) else found[n].cast(t) for n, t in types.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *types])

    return docs.mapInArrow(run, schema)


def _arrow(field: StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one key after the other, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        edges = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if a < b:
                if held and held[-1].column(key)[0].as_py() != keys[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    """A list array from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def letters_before(data: np.ndarray) -> np.ndarray:
    """Code points before each byte place, n + 1 entries."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
