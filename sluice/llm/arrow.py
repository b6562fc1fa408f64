"""Arrow mapping with bounded batches, for the operators that run Python on executors.

A batch has BATCH_ROWS rows and about BATCH_BYTES bytes at most, but one row at least:
a text of any length goes whole. Nulls are passed on as None.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bounds put on a session that still has Spark's defaults, so that long texts fit a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_DEFAULTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(BATCH_ROWS)),
             "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", f"{BATCH_BYTES}b")}
#: Rows worked on at a time within a batch.
STEP = 256


def bound_batches(spark: SparkSession) -> None:
    for name, (default, bound) in _DEFAULTS.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, bound)


def with_columns(df: DataFrame, sources: Sequence[str], targets: dict[str, T.DataType], make: Callable[[], Callable], step: int = STEP) -> DataFrame:
    """``df`` with the columns ``targets``.

    ``make()`` runs once a task and returns a function from the lists of the source
    columns' values (of ``step`` rows at most) to as many lists as there are targets.
    Input columns named like a target are replaced.
    """
    bound_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in targets]
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, k) for n, k in targets.items()]])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(k) for k in targets.values()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = make()
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                made = do(*[batch.column(c).to_pylist() for c in sources])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in kept], *[pa.array(v, k) for v, k in zip(made, kinds)]], [*kept, *targets])

    return df.mapInArrow(work, schema)
