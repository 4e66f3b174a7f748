"""Packed edge records: two unsigned 32-bit integers and a 32-bit float, little-endian, twelve bytes each."""

from __future__ import annotations

import pathlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = np.dtype([("src", "<u4"), ("dst", "<u4"), ("norm", "<f4")])
#: Records of a file that one row holds while it is unpacked.
PIECE = 1 << 20


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst, norm``. Files of up to 2 GB each are read as a whole; a larger edge list is several files."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = np.frombuffer(content.as_buffer(), RECORD)
                for i in range(0, len(rows), PIECE):
                    part = rows[i : i + PIECE]
                    yield pa.RecordBatch.from_arrays([pa.array(part["src"].astype("i8")), pa.array(part["dst"].astype("i8")), pa.array(part["norm"].astype("f8"))], names=["src", "dst", "norm"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpacked, "src long, dst long, norm double")


def write_edges(edges: DataFrame, path: str) -> None:
    """Writes ``src, dst, w`` as records, one file for each task, into the folder ``path``, which executors must share.

    A file gets its name once it is whole, and a task that is run again writes the same one.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        folder = pathlib.Path(path.removeprefix("file:"))
        folder.mkdir(parents=True, exist_ok=True)
        made = folder / f".part-{part:05}.{uuid.uuid4().hex}"
        count = 0
        with open(made, "wb") as out:
            for batch in batches:
                rows = np.empty(batch.num_rows, RECORD)
                for name, column in zip(RECORD.names, ("src", "dst", "w"), strict=True):
                    rows[name] = batch.column(column).to_numpy(zero_copy_only=False)
                out.write(rows.tobytes())
                count += len(rows)
        made.rename(folder / f"part-{part:05}.bin")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([count], pa.int64())})

    edges.select("src", "dst", "w").mapInArrow(packed, "part int, n long").agg(F.sum("n")).collect()


def vertex_count(edges: DataFrame) -> int:
    return (edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or -1) + 1
