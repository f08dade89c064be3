"""Running Python over the columns that it needs, in Arrow batches, while a row's other columns pass through."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

import vellum.llm
from vellum.llm.common import fresh, named

#: Functions travel to the workers by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(vellum.llm)

#: Most rows and bytes of an Arrow batch: texts are long, and a batch lies in the JVM's and in a worker's memory at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(df: DataFrame) -> None:
    """Lowers the session's limits to BATCH; there is no way to set them for one operator, and lower ones a user has set stay."""
    conf = df.sparkSession.conf
    for key, most in BATCH.items():
        have = conf.get(key)
        if not (have.isdigit() and 0 < int(have) <= most):
            conf.set(key, str(most))


def batched(df: DataFrame, make: Callable[[], Callable[[list], list[tuple]]], column: str, fields: T.StructType, per_call: int = 256) -> DataFrame:
    """df with fields, whose values follow from column. make() runs once a task; what it returns maps values to tuples.

    Batches keep to BATCH and are worked on per_call rows at a time.
    """
    small_batches(df)
    names = fresh(df, *[f.name for f in fields])
    every = [f.dataType for f in (*df.schema.fields, *fields)]
    plain = T.StructType([T.StructField(f"c{i}", kind) for i, kind in enumerate(every)])
    kinds, at = [to_arrow_type(f.dataType) for f in fields], df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, per_call):
                part = batch.slice(start, per_call)
                rows = work(part.column(at).to_pylist())
                added = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=plain.names)

    # mapInArrow resolves input columns by name, which fails for names with dots
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, plain).toDF(*df.columns, *names)


def only(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[named(c) for c in columns])
