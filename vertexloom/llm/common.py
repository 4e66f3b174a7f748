"""What the operators of this subpackage share: reading tables, cutting lineage, and mapping Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker handles at once.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which the cluster shares; only where that is unset and the master is local (tests) a temporary folder is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="vertexloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that the cluster shares, and read from there from now on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a Parquet table of its own, and read from it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def hidden(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by their places, so that none clashes with what an operator adds."""
    return df.toDF(*(f"kept_{i}" for i in range(len(df.columns))))


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``limit`` bytes in the text ``column`` each, one row at least; all rows in order."""
    import pyarrow.compute as pc

    start, held = 0, 0
    for row, size in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
        if held and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str, column: str, limit: int = BATCH_BYTES) -> DataFrame:
    """``df`` mapped by ``function``, which turns a slice of rows into columns by name in the order of ``schema``. A slice has about ``limit`` bytes of text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                made = function(part)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in fields], schema=fields)

    return df.mapInArrow(mapped, schema)
